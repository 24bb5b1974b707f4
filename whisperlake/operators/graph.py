"""Channel graph, views of several collectors, sampling plans and registries."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from whisperlake.functions import age_days, explode_sockets, has_sockets, ip_reachability, net_type, recency_bin, scid_block, scid_out, scid_tx
from whisperlake.operators.components import labels


def build_graph(channels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G1: vertices (pubkey) and undirected edges (scid, src, dst, capacity), repeated edges kept."""
    edges = channels.select("scid", F.col("node_one").alias("src"), F.col("node_two").alias("dst"), F.coalesce("capacity", F.lit(0)).alias("capacity"))
    return edges.select(F.explode(F.array("src", "dst")).alias("pubkey")).distinct(), edges


def edge_features(channels: DataFrame) -> DataFrame:
    """Channels with a capacity, and how many of all lack a direction."""
    one = F.col("one_to_two").isNull() | F.col("two_to_one").isNull() if "one_to_two" in channels.columns else F.lit(False)
    return channels.agg(F.count_if(F.coalesce(F.col("capacity"), F.lit(0)) > 0).alias("with_capacity"), F.count_if(one).alias("one_sided"), F.count(F.lit(1)).alias("channels"))


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("pubkey"), "capacity")


def vertex_strength(edges: DataFrame) -> DataFrame:
    """Degree, total capacity, mean of the edges' Box-Cox normalised capacities; a self-loop counts twice.

    Edges without a capacity have no normalised one and add nothing to the mean's sum; the degree counts them.
    """
    normal = box_cox(edges, "capacity")[0]
    each = normal.select(F.explode(F.array("src", "dst")).alias("pubkey"), "capacity", "capacity_bc").groupBy("pubkey")
    each = each.agg(F.count(F.lit(1)).alias("degree"), F.sum("capacity").alias("total_capacity"), F.coalesce(F.sum("capacity_bc"), F.lit(0.0)).alias("total"))
    return each.select("pubkey", "degree", "total_capacity", (F.col("total") / F.col("degree")).alias("mean_normal_capacity"))


def box_cox(df: DataFrame, column: str, low: float = -2.0, high: float = 2.0, points: int = 17, refine: int = 3) -> tuple[DataFrame, float]:
    """(df with ``column_bc``, lambda): maximum likelihood on a grid that is refined, then standardised; input > 0.

    Each grid is one aggregation: the likelihood needs the variance of the transform and the mean of the logarithm.
    """
    x, best = F.col(column).cast("double"), 0.0
    for _ in range(refine + 1):
        grid = [low + (high - low) * k / (points - 1) for k in range(points)]
        form = lambda g: F.log(x) if abs(g) < 1e-12 else (F.pow(x, g) - 1) / g
        row = df.where(x > 0).agg(F.avg(F.log(x)).alias("m"), *(F.var_pop(form(g)).alias(f"v{k}") for k, g in enumerate(grid))).first()
        if row["m"] is None:
            return df.withColumn(f"{column}_bc", F.lit(None).cast("double")), 0.0
        value = lambda k: -0.5 * math.log(max(row[f"v{k}"], 1e-300)) + (grid[k] - 1) * row["m"]
        at = max(range(points), key=value)
        best, step = grid[at], (high - low) / (points - 1)
        low, high = best - step, best + step
    made = F.log(x) if abs(best) < 1e-12 else (F.pow(x, best) - 1) / best
    return standardize(df, f"{column}_bc", F.when(x > 0, made)), best


def standardize(df: DataFrame, name: str, value: Column) -> DataFrame:
    """(value - mean) / population deviation, beside one row of both; null where the deviation is 0."""
    stats = df.agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_dev"))
    return df.crossJoin(F.broadcast(stats)).withColumn(name, F.try_divide(value - F.col("_mean"), F.col("_dev"))).drop("_mean", "_dev")


def log_standardize(df: DataFrame, column: str, plus_one: bool = False) -> DataFrame:
    return standardize(df, f"{column}_log", F.log1p(column) if plus_one else F.when(F.col(column) > 0, F.log(column)))


def components_of(edges: DataFrame) -> DataFrame:
    """(pubkey, component, size): component is the least pubkey reachable."""
    found = labels(edges)
    sizes = found.groupBy("label").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("size"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("pubkey")).where("pubkey is not null").distinct()
    loops = ends.join(found.select(F.col("node").alias("pubkey")), "pubkey", "left_anti").select("pubkey", F.col("pubkey").alias("component"), F.lit(1).cast("long").alias("size"))
    return found.join(sizes, "label").select(F.col("node").alias("pubkey"), "component", "size").unionByName(loops)


def graph_stats(edges: DataFrame) -> DataFrame:
    """One row on size, degrees and components."""
    degree = _ends(edges).groupBy("pubkey").agg(F.count(F.lit(1)).alias("degree")).agg(F.count(F.lit(1)).alias("nodes"), F.avg("degree").alias("mean_degree"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"), F.percentile("degree", 0.5).alias("median_degree"), F.count("pubkey").alias("named"))
    found = labels(edges).groupBy("label").agg(F.count(F.lit(1)).alias("size")).agg(F.count(F.lit(1)).alias("parts"), F.sum("size").alias("linked"), F.max("size").alias("largest"))
    # a node that has only loops is a component of its own
    alone = F.col("named") - F.coalesce("linked", F.lit(0))
    counts = degree.crossJoin(found).withColumns({"components": F.col("parts") + alone, "largest": F.coalesce("largest", F.when(F.col("named") > 0, F.lit(1)).cast("long"))})
    return edges.agg(F.count(F.lit(1)).alias("edges")).crossJoin(counts.select("nodes", "mean_degree", "min_degree", "max_degree", "median_degree", "components", "largest"))


def hops_from(edges: DataFrame, sources: DataFrame, most: int = 20) -> DataFrame:
    """(source, pubkey, hops) by frontier joins from the given sources, a written table for each hop."""
    from whisperlake.plans.scratch import written

    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = front = written(sources.select(F.col("pubkey").alias("source"), "pubkey", F.lit(0).alias("hops")).distinct(), "hops")
    for k in range(1, most + 1):
        step = front.join(both, front.pubkey == both.src).select("source", F.col("dst").alias("pubkey"), F.lit(k).alias("hops")).distinct()
        front = written(step.join(seen, ["source", "pubkey"], "left_anti"), "hops")
        if front.isEmpty():
            break
        seen = written(seen.unionByName(front), "hops")
    return seen


def path_stats(edges: DataFrame, sources: DataFrame, most: int = 20) -> DataFrame:
    """One row on the distances from the given sources to what they reach in ``most`` hops: pairs, mean and largest."""
    far = hops_from(edges, sources, most).where("hops > 0")
    return far.agg(F.count(F.lit(1)).alias("pairs"), F.avg("hops").alias("mean_hops"), F.max("hops").cast("long").alias("eccentricity"))


def distinct_asns(features: DataFrame) -> DataFrame:
    """The networks that occur, and how many nodes have each."""
    return features.where("asn is not null").groupBy("asn").agg(F.count(F.lit(1)).alias("nodes"))


def annotate(vertices: DataFrame, features: DataFrame, now: int, asns: DataFrame | None = None) -> DataFrame:
    """Vertices with their scraped features; misses stay null."""
    f = features.withColumns({"net_type": net_type("sockets"), "age_days": age_days("first_seen", now)})
    out = vertices.join(f, "pubkey", "left")
    return out if asns is None else out.join(asns, "asn", "left")


def community_matrix(edges: DataFrame, membership: DataFrame, level: str = "level_0") -> DataFrame:
    """Edges between blocks, in both orders for different blocks; blocks numbered from 0 without gaps."""
    blocks = membership.select(level).distinct().withColumn("block", F.dense_rank().over(Window.orderBy(level)) - 1)  # a row for each community
    of = membership.select("pubkey", level).join(blocks, level).select("pubkey", "block")
    a = edges.join(of.select(F.col("pubkey").alias("src"), F.col("block").alias("a")), "src").join(of.select(F.col("pubkey").alias("dst"), F.col("block").alias("b")), "dst")
    pairs = a.select(F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).alias("p"))
    return pairs.groupBy(F.col("p.a").alias("block_a"), F.col("p.b").alias("block_b")).agg(F.count(F.lit(1)).alias("edges"))


def edge_scope(edges: DataFrame, membership: DataFrame, levels: tuple[str, ...] = ("level_0", "level_1", "level_2")) -> DataFrame:
    """0 inside a community, else one more than the deepest level at which the ends differ."""
    side = lambda s: membership.select(F.col("pubkey").alias(s), *(F.col(v).alias(f"{s}_{v}") for v in levels))
    both = edges.join(side("src"), "src").join(side("dst"), "dst")
    scope = F.lit(0)
    for k, v in enumerate(levels):
        scope = F.when(F.col(f"src_{v}") != F.col(f"dst_{v}"), k + 1).otherwise(scope)
    return both.select("scid", "src", "dst", scope.alias("scope"))


def communities_wide(long: DataFrame, levels: list[str]) -> DataFrame:
    """(pubkey, level, community) as one column for each level that has more than one community."""
    counts = {r["level"]: r["n"] for r in long.groupBy("level").agg(F.countDistinct("community").alias("n")).collect()}
    return long.groupBy("pubkey").pivot("level", [v for v in levels if counts.get(v, 0) > 1]).agg(F.first("community"))


def community_members(membership: DataFrame, nodes: DataFrame) -> DataFrame:
    """G12."""
    return membership.select("level_0", "pubkey").join(nodes, "pubkey", "left")


def sampling_plan(membership: DataFrame, target: int, high: float = 0.08, low: float = 0.02, level: str = "level_0") -> DataFrame:
    """Connections for each community: its expected share, less a deviation if large, more if small, at least 1."""
    sizes = membership.groupBy(level).agg(F.count(F.lit(1)).alias("size"))
    p = F.col("size") / F.col("total")
    out = sizes.crossJoin(F.broadcast(sizes.agg(F.sum("size").alias("total")))).withColumn("proportion", p).withColumn("expected", F.lit(float(target)) * p)
    out = out.withColumn("stddev", F.sqrt(F.col("expected") * (1 - F.col("proportion"))))
    count = F.when(F.col("proportion") >= high, F.round(F.col("expected") - F.col("stddev"))).when(F.col("proportion") >= low, F.round("expected")).otherwise(F.greatest(F.round(F.col("expected") + F.col("stddev")), F.lit(1.0)))
    return out.select(level, "size", "proportion", "expected", "stddev", count.cast("long").alias("connection_count"))


def assignments(mapping: DataFrame, plan: DataFrame, membership: DataFrame, nodes: DataFrame, seed: int = 0) -> DataFrame:
    """Each collector's community and its plan, with a row for each of its members that have only valid sockets, ranked from 1 in a seeded order.

    A rank is the number of members in the stretches of hashes before, plus that within the stretch, so that no task holds
    a community; one without such members has a row with nulls.
    """
    valid = explode_sockets(nodes, whole_record=True).where("valid").select("pubkey").distinct()
    able = membership.join(nodes.where(has_sockets("sockets")).select("pubkey"), "pubkey", "left_semi").join(valid, "pubkey", "left_semi")
    placed = able.select("level_0", "pubkey", F.xxhash64("pubkey", F.lit(seed)).alias("h")).withColumn("stretch", F.shiftright("h", 54))
    sizes = placed.groupBy("level_0", "stretch").agg(F.count(F.lit(1)).alias("n"))  # at most 1024 for a community
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("level_0").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("level_0", "stretch").orderBy("h", "pubkey"))
    ranked = placed.withColumn("inside", inside).join(before, ["level_0", "stretch"]).select("level_0", (F.col("before") + F.col("inside")).alias("rank"), "pubkey")
    return mapping.join(plan, "level_0").join(ranked, "level_0", "left")


def merge_nodes(views: DataFrame) -> DataFrame:
    """Each node's newest info over all collectors; ties: the collector that sorts first; no info only if none has any."""
    best = F.min_by(F.struct("last_update", "alias"), F.struct((-F.coalesce("last_update", F.lit(-1))).alias("u"), "collector"))
    return views.groupBy("pubkey").agg(best.alias("x")).select("pubkey", "x.*")


def merge_directions(views: DataFrame) -> DataFrame:
    """Each channel direction's newest copy; ties: the collector that sorts first, then the larger payload."""
    key = F.struct((-F.col("last_update")).alias("u"), "collector", *((-F.col(c)).alias(c) for c in ("fees_base", "fees_ppm", "cltv")))
    best = F.min_by(F.struct("last_update", "fees_base", "fees_ppm", "cltv"), key)
    return views.groupBy("scid", "direction").agg(best.alias("x")).select("scid", "direction", "x.*")


def merge_channels(views: DataFrame) -> DataFrame:
    """Each channel's newest time over all collectors, and the capacity of the newest copy that has one; ties: the collector that sorts first."""
    key = F.struct(F.col("capacity").isNull(), (-F.coalesce("last_update", F.lit(-1))).alias("u"), "collector")
    return views.groupBy("scid").agg(F.max("last_update").alias("last_update"), F.min_by("capacity", key).alias("capacity"))


def own_directions(views: DataFrame) -> DataFrame:
    """Each collector's newest copy of each direction."""
    key = F.struct("last_update", "fees_base", "fees_ppm", "cltv")
    return views.groupBy("collector", "scid", "direction").agg(F.max(key).alias("x")).select("collector", "scid", "direction", "x.*")


def _dealt(rows: DataFrame, key: str, most: int = 250_000) -> DataFrame:
    """Dealt by ``key`` into so many partitions that one has some ``most`` rows, however many there are; these are counted first."""
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // most + 1), key)


def graph_diff(nodes: DataFrame, directions: DataFrame) -> DataFrame:
    """Ten counters for each collector against the merged view.

    A node that a collector does not know counts as missing, and so does its info, whether or not anybody has it; what
    nobody has matches, be it a known node's info or one of the two directions of a known channel. An unknown channel
    counts as missing without its directions; a copy is stale if it differs in anything but its time of update.
    """
    # each side is dealt once, by node or by channel, so that what a task sorts doesn't grow; what all collectors know stands beside each copy
    own = _dealt(nodes.select("collector", "pubkey", "last_update", "alias"), "pubkey").groupBy("collector", "pubkey").agg(F.max(F.struct("last_update", "alias")).alias("x")).select("collector", "pubkey", "x.*")
    of = Window.partitionBy("pubkey")
    newest = of.orderBy(F.coalesce("last_update", F.lit(-1)).desc(), "collector")
    own = own.withColumns({"k": F.row_number().over(newest), "best": F.first("alias").over(newest), "any": F.max("last_update").over(of).isNotNull()})
    has, same = F.col("last_update").isNotNull(), F.col("alias").eqNullSafe(F.col("best"))
    node_counts = own.groupBy("collector").agg(
        F.count(F.lit(1)).alias("known_nodes"), F.count_if(F.col("any") & ~has).alias("lacked"), F.count_if(has & ~same).alias("stale_node_info"),
        F.count_if(has & same | ~F.col("any")).alias("matching_node_info"), F.count_if(F.col("k") == 1).alias("nodes"))
    pay = F.struct("fees_base", "fees_ppm", "cltv")
    views = _dealt(directions.select("collector", "scid", "direction", "last_update", "fees_base", "fees_ppm", "cltv"), "scid")
    mine = own_directions(views).select("collector", "scid", "direction", "last_update", pay.alias("mine"))
    way, channel = Window.partitionBy("scid", "direction"), Window.partitionBy("scid")
    # a copy is one of a collector, so that its payload breaks no more ties
    mine = mine.withColumns({"best": F.first("mine").over(way.orderBy(F.desc("last_update"), "collector")), "k": F.row_number().over(channel.orderBy("direction", "collector"))})
    mine = mine.withColumn("ways", sum(F.max((F.col("direction") == d).cast("int")).over(channel) for d in (1, 2)))
    by_channel = mine.groupBy("collector", "scid").agg(F.first("ways").alias("ways"), F.count_if(F.col("mine") != F.col("best")).alias("stale"), F.count_if(F.col("mine") == F.col("best")).alias("same"), F.count_if(F.col("k") == 1).alias("first"))
    chan_counts = by_channel.groupBy("collector").agg(
        F.count(F.lit(1)).alias("known_channels"), F.sum(F.col("ways") - F.col("stale") - F.col("same")).alias("missing_directions"), F.sum("stale").alias("stale_directions"),
        F.sum(F.col("same") + 2 - F.col("ways")).alias("matching_directions"), F.sum("first").alias("channels"))
    # what a collector lacks is the total less what it holds, so that nothing is crossed with the collectors
    counts = node_counts.join(chan_counts, "collector", "full").na.fill(0)
    every = counts.drop("nodes", "channels").crossJoin(F.broadcast(counts.agg(F.sum("nodes").alias("nodes"), F.sum("channels").alias("channels"))))
    missing = F.col("nodes") - F.col("known_nodes")
    return every.select(
        "collector", "known_nodes", missing.alias("missing_nodes"), (missing + F.col("lacked")).alias("missing_node_info"), "stale_node_info", "matching_node_info",
        "known_channels", (F.col("channels") - F.col("known_channels")).alias("missing_channels"), "missing_directions", "stale_directions", "matching_directions",
    )


def utxo_filter(channels: DataFrame, utxos: DataFrame) -> DataFrame:
    """Every channel with its funding output's state: kept, missing or spent, and its capacity if kept."""
    c = channels.withColumns({"block": scid_block("scid"), "tx": scid_tx("scid"), "vout": scid_out("scid")})
    state = F.when(F.col("spent").isNull(), "missing").when(F.col("spent"), "spent").otherwise("kept")
    return c.join(utxos, ["block", "tx", "vout"], "left").select("scid", "node_one", "node_two", state.alias("state"), F.when(state == "kept", F.col("value")).alias("capacity"))


def used_nodes(nodes: DataFrame, channels: DataFrame) -> DataFrame:
    """Nodes at an end of any of the channels."""
    return nodes.join(channels.select(F.explode(F.array("node_one", "node_two")).alias("pubkey")).distinct(), "pubkey", "left_semi")


def lists(nodes: DataFrame, channels: DataFrame) -> dict[str, DataFrame]:
    """Node list, channel list, and nodes of channels that were never announced."""
    ends = channels.select(F.explode(F.array("node_one", "node_two")).alias("pubkey")).distinct()
    return {"nodes": nodes.select("pubkey").distinct(), "channels": channels.select("scid", "node_one", "node_two"), "unannounced": ends.join(nodes, "pubkey", "left_anti")}


def reachable_split(nodes: DataFrame) -> DataFrame:
    """Each address as maybe reachable, unreachable or unparseable."""
    kind = F.when(~F.regexp_like("address", F.lit(r"^\S+:[0-9]{1,5}$")), "unparseable").when(ip_reachability("address"), "maybe_reachable").otherwise("unreachable")
    return explode_sockets(nodes).select("pubkey", "address", kind.alias("kind"))


def recency_table(nodes: DataFrame, now: int, last_seen: str = "last_update") -> DataFrame:
    """Nodes by age class, running totals from the youngest, and the share within a month."""
    order = {n: k for k, n in enumerate(["hour", "day", "week", "two_weeks", "month", "three_months", "six_months", "year", "other"])}
    each = nodes.where(F.col(last_seen).isNotNull()).groupBy(recency_bin(F.lit(now) - F.col(last_seen)).alias("age")).agg(F.count(F.lit(1)).alias("nodes"))
    rank = reduce(lambda c, x: F.when(F.col("age") == x[0], x[1]).otherwise(c), order.items(), F.lit(99))
    run = Window.orderBy("rank")  # nine rows at most
    out = each.withColumn("rank", rank).withColumn("running", F.sum("nodes").over(run))
    total = each.agg(F.sum("nodes").alias("total"), F.sum(F.when(F.col("age").isin(*list(order)[:5]), F.col("nodes")).otherwise(0)).alias("month"))
    return out.crossJoin(F.broadcast(total)).select("age", "nodes", "running", (F.col("month") * 100.0 / F.col("total")).alias("pct_within_month"))
