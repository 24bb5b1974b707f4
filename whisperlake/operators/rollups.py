"""Mergeable roll-ups (KLL and HyperLogLog sketches as binary columns) and the queries over them.

Every roll-up takes batch or streaming receipts alike; a stream needs a watermark (see ``streaming``). Quantile sketches
hold whole microseconds since 1970, so that those of different hours merge and no precision is lost.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from whisperlake.functions import epoch_diff
from whisperlake.operators.quantiles import HEAVY, percentiles

HLL_LG = 15  # 32768 registers


def _inbound(t: DataFrame, m: DataFrame, types: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    return t.where("dir = 1").join(m.where(F.col("type").isin(*types)).select("hash", "type", "orig_node", "scid"), "hash")


def _window(rows: DataFrame, width: str, *keys: str):
    return rows.withColumn("w", F.window("net_timestamp", width)).groupBy("w", *keys)


def _flat(df: DataFrame) -> DataFrame:
    return df.select(F.col("w.start").alias("bucket"), *(c for c in df.columns if c != "w"))


def peer_count_rollup(t: DataFrame) -> DataFrame:
    """Peers for each ten minutes and collector, as a sketch (a stream cannot count distinct values exactly)."""
    return _flat(_window(t.where("dir = 1"), "10 minutes", "collector").agg(F.hll_sketch_agg("peer_hash", HLL_LG).alias("peers_hll")))


def propagation_rollup(t: DataFrame, m: DataFrame, key: str = "hash", per_collector: bool = False) -> DataFrame:
    """Receipts, first times and a sketch of times for each hour and message, and collector if asked."""
    keys = [key, "type", *(["collector"] if per_collector else [])]
    out = _window(_inbound(t, m), "1 hour", *keys)
    return _flat(out.agg(F.count(F.lit(1)).alias("receipts"), F.min("net_timestamp").alias("first_seen"), F.min("orig_timestamp").alias("orig_timestamp"), F.kll_sketch_agg_bigint(F.unix_micros("net_timestamp")).alias("times")))


def message_rate_rollup(t: DataFrame, m: DataFrame) -> DataFrame:
    """C4."""
    return _flat(_window(_inbound(t, m), "10 minutes", "type").agg(F.count(F.lit(1)).alias("receipts"), F.hll_sketch_agg("hash", HLL_LG).alias("outer_hll"), F.hll_sketch_agg("inner_hash", HLL_LG).alias("inner_hll")))


def activity_rollup(t: DataFrame, m: DataFrame, entity: str) -> DataFrame:
    """C5 (orig_node, type 2) and C6 (scid, types 1 and 3): receipts and distinct messages for each hour."""
    types, keys = ((2,), ["orig_node"]) if entity == "orig_node" else ((1, 3), ["scid", "type"])
    rows = _inbound(t, m, types).where(F.col(entity).isNotNull())
    return _flat(_window(rows, "1 hour", *keys).agg(F.count(F.lit(1)).alias("receipts"), F.hll_sketch_agg("hash", HLL_LG).alias("outer_hll"), F.hll_sketch_agg("inner_hash", HLL_LG).alias("inner_hll")))


def outbound_origin_rollup(t: DataFrame, m: DataFrame) -> DataFrame:
    """First outbound time for each hour, message, collector and type."""
    rows = t.where("dir = 2").join(m.where("type in (1, 2, 3)").select("hash", "type"), "hash")
    return _flat(_window(rows, "1 hour", "hash", "collector", "type").agg(F.min("net_timestamp").alias("first_sent")))


def exact_rollup(t: DataFrame, m: DataFrame, width: str, *keys: str, types: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Receipts and exact distinct messages; not mergeable, for batch only."""
    rows = _inbound(t, m, types)
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    return _flat(_window(rows, width, *keys).agg(F.count(F.lit(1)).alias("receipts"), F.countDistinct("hash").alias("distinct_outer"), F.countDistinct("inner_hash").alias("distinct_inner")))


def refresh(build, t: DataFrame, path: str, start: str, end: str) -> None:
    """Recompute the buckets of [start, end), whole hours, and overwrite just the days they fall on.

    ``build`` makes a roll-up from receipts. The affected days are recomputed whole, as a partition is replaced whole.
    """
    first, last = F.date_trunc("day", F.lit(start).cast("timestamp")), F.date_trunc("day", F.lit(end).cast("timestamp") - F.expr("interval 1 microsecond"))
    rows = t.where((F.col("net_timestamp") >= first) & (F.col("net_timestamp") < last + F.expr("interval 1 day")))
    build(rows).withColumn("day", F.to_date("bucket")).repartition("day").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("day").parquet(path)


def ca_stats(**rollups: DataFrame) -> DataFrame:
    """Rows and range of each roll-up."""
    return reduce(DataFrame.unionByName, [r.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows"), F.min("bucket").alias("first_bucket"), F.max("bucket").alias("last_bucket")) for n, r in rollups.items()])


def _between(ca: DataFrame, start: str | None, end: str | None) -> DataFrame:
    if start is not None:
        ca = ca.where(F.col("bucket") >= F.lit(start).cast("timestamp"))
    return ca if end is None else ca.where(F.col("bucket") < F.lit(end).cast("timestamp"))


def _near(ca: DataFrame, key: str) -> DataFrame:
    """Buckets up to an hour after the first one of their message, whichever collector has that."""
    return ca.withColumn("fb", F.min("bucket").over(Window.partitionBy(key))).where(F.expr("bucket <= fb + interval 1 hour")).drop("fb")


def _quantiles(since: str, probs: tuple[float, ...], prefix: str = "") -> list[Column]:
    return [((F.kll_sketch_get_quantile_bigint("times", F.lit(p)) - F.unix_micros(since)) / F.lit(1e6)).alias(f"{prefix}p{round(p * 100):02d}") for p in probs]


def _merged(near: DataFrame, keys: list[str], probs: tuple[float, ...], receipts: str = "receipts", prefix: str = "") -> DataFrame:
    """By key: receipts, first_seen and quantiles of delay; the sketches of the buckets are merged, then asked."""
    whole = near.groupBy(*keys).agg(F.first("type").alias("type"), F.sum("receipts").alias(receipts), F.min("first_seen").alias("first_seen"), F.kll_merge_agg_bigint("times").alias("times"))
    return whole.select(*keys, "type", receipts, F.col("first_seen").alias(prefix + "first_seen"), *_quantiles("first_seen", probs, prefix))


def propagation_from_sketch(ca: DataFrame, cutoff: int, key: str = "hash", msg_type: int | None = None, start: str | None = None, end: str | None = None, probs: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Messages with at least ``cutoff`` receipts (not peers), up to two hours by whole buckets."""
    ca = _between(ca, start, end)
    ca = ca if msg_type is None else ca.where(F.col("type") == msg_type)
    return _merged(_near(ca, key), [key], probs).where(F.col("receipts") >= cutoff)


def outbound_propagation(ca_out: DataFrame, ca_in: DataFrame, cutoff: int, msg_type: int | None = None, start: str | None = None, end: str | None = None, probs: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Quantiles of delay from a message's first outbound time, over the collectors' inbound buckets that begin within an hour of it."""
    sent, got = _between(ca_out, start, end), _between(ca_in, start, end)
    if msg_type is not None:
        sent, got = sent.where(F.col("type") == msg_type), got.where(F.col("type") == msg_type)
    t0 = sent.groupBy("hash").agg(F.min("first_sent").alias("t0"))
    rows = got.join(t0, "hash").where(F.expr("first_seen >= t0 and first_seen <= t0 + interval 1 hour"))
    whole = rows.groupBy("hash", "t0").agg(F.sum("receipts").alias("total_peers"), F.kll_merge_agg_bigint("times").alias("times")).where(F.col("total_peers") >= cutoff)
    return whole.select("hash", "t0", "total_peers", *_quantiles("t0", probs))


def collector_comparison(ca: DataFrame, cutoff: int, collectors: list[str] | None = None) -> DataFrame:
    """T4: for each message and collector, its quantiles beside those of all collectors; ratio by zero is null.

    Both sides begin with the message's first bucket over all collectors: one that is later by more has no row.
    """
    near, probs = _near(ca, "hash"), (0.25, 0.5, 0.75)
    every = _merged(near, ["hash"], probs, "peers_all", "all_").where(F.col("peers_all") >= cutoff)
    own = _merged(near if collectors is None else near.where(F.col("collector").isin(collectors)), ["hash", "collector"], probs, "peers_single", "single_").drop("type")
    return own.join(every, "hash").withColumns({"diff_p50": F.col("single_p50") - F.col("all_p50"), "ratio_p50": F.try_divide("single_p50", "all_p50")})


def _hourly(t: DataFrame, m: DataFrame) -> DataFrame:
    """Inbound receipts with the hour they fall in and their microsecond."""
    return _inbound(t, m).select("hash", "inner_hash", "type", "collector", "net_timestamp", F.date_trunc("hour", "net_timestamp").alias("bucket"), F.unix_micros("net_timestamp").alias("at"))


def _nearby(rows: DataFrame, key: str) -> DataFrame:
    first = rows.groupBy(key).agg(F.min("bucket").alias("fb"))
    return rows.join(first, key).where(F.expr("bucket <= fb + interval 1 hour"))


def _exactly(rows: DataFrame, keys: list[str], since: str | None, probs: tuple[float, ...], receipts: str, t: DataFrame, heavy: int, prefix: str = "") -> DataFrame:
    """By key: receipts, first_seen (unless ``since`` is a key) and quantiles of delay as ``_merged`` has them, of the receipts themselves."""
    first = [] if since else [F.min("net_timestamp").alias("first_seen")]
    found = percentiles(rows, keys, "at", probs, first, (t.where("dir = 1").select(keys[0]), keys[:1]), heavy, disc=True)
    delays = [((F.get("p", F.lit(k)) - F.unix_micros(since or "first_seen")) / F.lit(1e6)).alias(f"{prefix}p{round(p * 100):02d}") for k, p in enumerate(probs)]
    return found.select(*keys, F.col("n").alias(receipts), *([] if since else [F.col("first_seen").alias(prefix + "first_seen")]), *delays)


def exact_propagation(t: DataFrame, m: DataFrame, cutoff: int, key: str = "hash", probs: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95), heavy: int = HEAVY) -> DataFrame:
    """T1 and T2 from receipts, for any number of them; the sketches of ``propagation_from_sketch`` are exact up to 200."""
    return _exactly(_nearby(_hourly(t, m), key), [key, "type"], None, probs, "receipts", t, heavy).where(F.col("receipts") >= cutoff)


def exact_outbound_propagation(t: DataFrame, m: DataFrame, cutoff: int, probs: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95), heavy: int = HEAVY) -> DataFrame:
    """T3 from receipts: see ``outbound_propagation``."""
    t0 = t.where("dir = 2").join(m.where("type in (1, 2, 3)").select("hash"), "hash").groupBy("hash").agg(F.min("net_timestamp").alias("t0"))
    rows = _hourly(t, m)
    begun = rows.groupBy("hash", "bucket", "collector").agg(F.min("net_timestamp").alias("f")).join(t0, "hash").where(F.expr("f >= t0 and f <= t0 + interval 1 hour")).drop("f")
    return _exactly(rows.join(begun, ["hash", "bucket", "collector"]), ["hash", "t0"], "t0", probs, "total_peers", t, heavy).where(F.col("total_peers") >= cutoff)


def exact_comparison(t: DataFrame, m: DataFrame, cutoff: int, heavy: int = HEAVY) -> DataFrame:
    """T4 from receipts: see ``collector_comparison``."""
    near, probs = _nearby(_hourly(t, m), "hash"), (0.25, 0.5, 0.75)
    every = _exactly(near, ["hash", "type"], None, probs, "peers_all", t, heavy, "all_").where(F.col("peers_all") >= cutoff)
    own = _exactly(near, ["hash", "collector"], None, probs, "peers_single", t, heavy, "single_")
    return own.join(every, "hash").withColumns({"diff_p50": F.col("single_p50") - F.col("all_p50"), "ratio_p50": F.try_divide("single_p50", "all_p50")})


def comparison_summary(comparison: DataFrame) -> DataFrame:
    """T4s: medians for each collector, in one job."""
    cols = [c for c in comparison.columns if "_p" in c]
    return comparison.groupBy("collector").agg(*(F.round(F.percentile(c, 0.5), 4).alias(c) for c in cols), F.count(F.lit(1)).alias("messages"))


def publication_delay(ca: DataFrame, key: str = "hash", msg_type: int | None = None) -> DataFrame:
    """First sight minus the creator's stamp, where not negative, and receipts; types 2 and 3, over buckets with a stamp."""
    rows = ca.where(F.col("type").isin(2, 3) if msg_type is None else (F.col("type") == msg_type) & F.col("type").isin(2, 3)).where("orig_timestamp is not null")
    each = rows.groupBy(key, "type").agg(F.min("first_seen").alias("first_seen"), F.min("orig_timestamp").alias("orig_timestamp"), F.sum("receipts").alias("total_receipts"))
    return each.where("first_seen >= orig_timestamp").select(key, "type", epoch_diff("first_seen", "orig_timestamp").alias("delay"), "total_receipts")


def _distinct(c: str) -> Column:
    return F.hll_sketch_estimate(F.hll_union_agg(c))


def message_rate_6h(ca: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Receipts for an hour and distinct messages of both kinds for each six hours and type."""
    return _between(ca, start, end).groupBy(F.window("bucket", "6 hours").start.alias("bucket6"), "type").agg((F.sum("receipts") / 6).alias("receipts_per_hour"), _distinct("outer_hll").alias("unique_outer"), _distinct("inner_hll").alias("unique_inner"))


def peer_count_from_rollup(ca: DataFrame) -> DataFrame:
    """Hourly maximum of the ten-minute estimates."""
    return ca.select("bucket", "collector", F.hll_sketch_estimate("peers_hll").alias("peers")).groupBy(F.date_trunc("hour", "bucket").alias("hour"), "collector").agg(F.max("peers").alias("peers"))


def activity_totals(ca: DataFrame, *by: str, width: str | None = None) -> DataFrame:
    """T9 (by orig_node), T9b and T9c (width 1 day; T9c over type 3), T10 (scid and type, width 12 hours)."""
    keys = [F.window("bucket", width).start.alias("bucket")] if width else []
    return ca.groupBy(*keys, *by).agg(F.sum("receipts").alias("receipts"), _distinct("outer_hll").alias("outer"), _distinct("inner_hll").alias("inner"))


def top_n_series(series: DataFrame, n: int = 10) -> DataFrame:
    """Of each type, the series of the ``n`` scids with most receipts, ties by scid."""
    totals = series.groupBy("type", "scid").agg(F.sum("receipts").alias("r"))
    top = totals.withColumn("k", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("r"), "scid"))).where(F.col("k") <= n)
    return series.join(top.select("type", "scid"), ["type", "scid"], "left_semi")


def outer_inner_ratio(daily: DataFrame, tail: float | None = None) -> DataFrame:
    """Mean over days with an inner message of outer to inner updates (type 3) of each scid; with ``tail``, only means from there on, and their log10."""
    out = daily.where(F.col("inner") > 0).groupBy("scid").agg(F.avg(F.try_divide("outer", "inner")).alias("mean_ratio"), F.count(F.lit(1)).alias("days_active"))
    return out if tail is None else out.where(F.col("mean_ratio") >= tail).withColumn("log10_ratio", F.log10("mean_ratio"))


def scid_comparison(ca: DataFrame, top_n: int = 25, min_messages: int = 10) -> DataFrame:
    """Distinct announcements beside distinct updates of each scid; most messages first, ties by scid."""
    per_type = ca.groupBy("scid", "type").agg(_distinct("outer_hll").alias("messages"))
    each = per_type.groupBy("scid").agg(*(F.coalesce(F.sum(F.when(F.col("type") == k, F.col("messages"))), F.lit(0)).alias(n) for k, n in ((1, "announcements"), (3, "updates"))), F.sum("messages").alias("total"))
    return each.where(F.col("total") >= min_messages).orderBy(F.desc("total"), "scid").limit(top_n)


def lookup(t: DataFrame, m: DataFrame, messages: DataFrame, now: str, interval: str = "3 days", scid: int | None = None, node: str | None = None, msg_type: int | None = None, newest: bool = False) -> DataFrame:
    """Inbound receipts of a channel's or node's messages, newest first; ``newest``: one for each collector."""
    if (scid is None) == (node is None):
        raise ValueError("one of scid and node is needed")
    kind = msg_type or (3 if scid is not None else 2)
    wanted = m.where((F.col("type") == kind) & (F.col("scid") == scid if scid is not None else F.col("orig_node") == node)).select("hash", "type", "size")
    until = F.lit(now).cast("timestamp")
    rows = t.where((F.col("dir") == 1) & (F.col("net_timestamp") <= until) & (F.col("net_timestamp") > until - F.expr(f"interval {interval}"))).join(wanted, "hash").join(messages, "hash")
    out = rows.select("collector", "net_timestamp", "row_inc", "hash", "type", "size", "raw", "peer")
    if newest:
        out = out.groupBy("collector").agg(F.max_by(F.struct(*out.columns[1:]), F.struct("net_timestamp", "row_inc")).alias("x")).select("collector", "x.*")
    return out
