"""Summaries over raw receipts and metadata: all directions and types unless stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from whisperlake.functions import epoch_diff, type_name
from whisperlake.operators.quantiles import HEAVY, percentiles

CONVERGENCE = {"p0_1": 0.001, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99_9": 0.999}


def _with_total(df: DataFrame, total: DataFrame) -> DataFrame:
    """Beside a frame of exactly one row: both sides stay distributed, no one-partition window."""
    return df.crossJoin(F.broadcast(total))


def convergence_delay_summary(t: DataFrame, min_share: float = 0.5, probs: dict[str, float] = CONVERGENCE, heavy: int = HEAVY) -> DataFrame:
    """Mean, over messages whose receipts reach ``min_share`` of all peers, of each percentile of delay after the first."""
    peers = t.agg(F.countDistinct("peer_hash").alias("peers"))
    # delays relative to the first are percentiles of the times minus the least one, so that one grouping gives all
    rows = t.select("hash", F.unix_micros("net_timestamp").alias("us"))
    every = percentiles(rows, ["hash"], "us", list(probs.values()), [F.min("us").alias("t0"), F.count(F.lit(1)).alias("receipts")], heavy=heavy).withColumnRenamed("p", "q")
    wide = _with_total(every, peers).where(F.col("receipts") >= min_share * F.col("peers"))
    each = wide.select("receipts", F.transform("q", lambda x: (x - F.col("t0")) / F.lit(1e6)).alias("p"))
    return each.agg(
        *(F.avg(F.get("p", F.lit(k))).alias(f"avg_{n}") for k, n in enumerate(probs)), F.count(F.lit(1)).alias("messages"), F.avg("receipts").alias("avg_total_peers")
    )


def total_size_max_peers(t: DataFrame, m: DataFrame) -> DataFrame:
    return m.agg(F.sum("size").alias("total_size")).crossJoin(t.agg(F.countDistinct("peer_hash").alias("max_peers")))


def type_proportions(m: DataFrame) -> DataFrame:
    each = m.groupBy("type").agg(F.countDistinct("hash").alias("messages"))
    total = m.agg(F.countDistinct("hash").alias("total"))
    return _with_total(each, total).select("type", type_name("type", "unknown").alias("type_name"), "messages", (F.col("messages") * 100.0 / F.col("total")).alias("pct"))


def _hours() -> Column:
    return epoch_diff("last_ts", "first_ts") / 3600


def _span(t: DataFrame) -> DataFrame:
    return t.agg(F.min("net_timestamp").alias("first_ts"), F.max("net_timestamp").alias("last_ts"))


def unique_rate(t: DataFrame) -> DataFrame:
    one = t.agg(F.countDistinct("hash").alias("unique_messages"), F.min("net_timestamp").alias("first_ts"), F.max("net_timestamp").alias("last_ts")).withColumn("hours", _hours())
    return one.withColumns({"per_hour": F.try_divide("unique_messages", "hours"), "per_minute": F.try_divide(F.col("unique_messages"), F.col("hours") * 60)})


def peers_per_message(t: DataFrame) -> DataFrame:
    """How many messages have how many receipts."""
    sizes = t.groupBy("hash").agg(F.count(F.lit(1)).alias("receipts")).groupBy("receipts").agg(F.count(F.lit(1)).alias("messages"))
    return _with_total(sizes, sizes.agg(F.sum("messages").alias("total"))).select("receipts", "messages", F.round(F.col("messages") * 100.0 / F.col("total"), 2).alias("pct"))


def entity_frequency(m: DataFrame, entity: str, top: int | None = None) -> DataFrame:
    """Metadata rows of each scid or orig_node with their share; the ``top`` largest if asked for, ties by the entity."""
    each = m.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.count(F.lit(1)).alias("messages"))
    out = _with_total(each, each.agg(F.sum("messages").alias("total"))).select(entity, "messages", (F.col("messages") * 100.0 / F.col("total")).alias("pct"))
    return out.orderBy(F.desc("messages"), entity).limit(top) if top else out


def scid_update_summary(t: DataFrame, m: DataFrame) -> DataFrame:
    """Four figures on channel updates, as metric and value."""
    rows = t.where("orig_timestamp is not null").join(m.where("type = 3 and scid is not null").select("hash", "scid"), "hash")
    each = rows.groupBy("scid").agg(F.countDistinct("hash").alias("messages"), F.countDistinct("orig_timestamp").alias("stamps"))
    one = each.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("stamps") > 1).alias("many"), F.round(F.avg("messages"), 2).alias("mean"), F.max("stamps").alias("most"))
    return one.select(F.expr("stack(4, 'scids', cast(n as double), 'scids_with_updates', cast(many as double), 'mean_messages', mean, 'max_timestamps', cast(most as double)) as (metric, value)"))


def rates_by_type(t: DataFrame, m: DataFrame) -> DataFrame:
    each = t.join(m.select("hash", "type"), "hash").groupBy("type").agg(F.count(F.lit(1)).alias("receipts"), F.countDistinct("hash").alias("unique_messages"))
    out = _with_total(each, _span(t)).withColumn("hours", _hours())
    rate = lambda c, per: F.try_divide(F.col(c), F.col("hours") * per)
    return out.select("type", type_name("type", "other", (1, 2, 3)).alias("type_name"), "receipts", "unique_messages", rate("receipts", 1).alias("receipts_per_hour"), rate("receipts", 60).alias("receipts_per_minute"), rate("unique_messages", 1).alias("unique_per_hour"), rate("unique_messages", 60).alias("unique_per_minute"))


def active_peers(t: DataFrame, width: str = "15 minutes") -> DataFrame:
    w = t.groupBy(F.window("net_timestamp", width).alias("w")).agg(F.countDistinct("peer_hash").alias("peers"))
    return w.select(F.col("w.start").alias("interval_start"), F.col("w.end").alias("interval_end"), "peers")


def ping_pong_pairs(t: DataFrame, m: DataFrame, first_only: bool = False) -> DataFrame:
    """Inbound pongs with the peer's last outbound ping before them, by arrival; ``first_only``: one pong for a ping.

    A window carries the ping forward: one sort for each peer, where a self-join would meet every pair.
    """
    rows = t.join(m.where("type in (4, 5)").select("hash", "type"), "hash").where("(type = 4 and dir = 2) or (type = 5 and dir = 1)")
    ping = F.when(F.col("type") == 4, F.struct(F.col("row_inc").alias("ping_row"), F.col("net_timestamp").alias("ping_ts")))
    back = Window.partitionBy("peer").orderBy("row_inc").rowsBetween(Window.unboundedPreceding, -1)
    pairs = rows.withColumn("ping", F.last(ping, ignorenulls=True).over(back)).where("type = 5 and ping is not null")
    out = pairs.select("peer", "ping.ping_row", F.col("row_inc").alias("pong_row"), epoch_diff("net_timestamp", "ping.ping_ts").alias("response_seconds"))
    if first_only:
        out = out.groupBy("peer", "ping_row").agg(F.min(F.struct("pong_row", "response_seconds")).alias("x")).select("peer", "ping_row", "x.*")
    return out


def ping_pong_stats(pairs: DataFrame) -> DataFrame:
    """Percentiles to 6 places; interpolated ties of microseconds round up."""
    probs = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    each = pairs.groupBy("peer").agg(F.count(F.lit(1)).alias("pairs"), F.percentile("response_seconds", F.array(*map(F.lit, probs.values()))).alias("p"))
    return each.select("peer", "pairs", *(F.round(F.get("p", F.lit(k)) + 1e-8, 6).alias(n) for k, n in enumerate(probs)))
