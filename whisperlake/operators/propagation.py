"""How fast and how far messages spread, exactly, from receipts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whisperlake.functions import type_name
from whisperlake.operators.quantiles import HEAVY, percentiles

PROBS = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


#: Delays up to a ceiling of days, in microseconds.
SPAN = 1 << 40


def _spread(p: str = "p") -> list[Column]:
    """Percentiles of microseconds, in seconds."""
    return [(F.get(p, F.lit(k)) / F.lit(1e6)).alias(n) for k, n in enumerate(PROBS)]


def _micros(end: str, start: str) -> Column:
    return F.unix_micros(end) - F.unix_micros(start)


def _types(m: DataFrame, msg_type: int | None) -> DataFrame:
    return m.where(F.col("type").isin(1, 2, 3) if msg_type is None else F.col("type") == msg_type)


def propagation(t: DataFrame, m: DataFrame, fs: DataFrame, msg_type: int | None = None, peer_cutoff: int = 100, ceiling: str = "1 hour", exact: bool = False, heavy: int = HEAVY) -> DataFrame:
    """Per message: peers (inbound receipts up to ``ceiling`` after the first sight) and percentiles of their delay.

    Messages of more than ``heavy`` receipts get theirs by refined histograms, so that none is held in one task's memory.
    """
    peers = F.countDistinct("peer") if exact else F.approx_count_distinct("peer", 0.02)
    rows = t.where("dir = 1").join(_types(m, msg_type).select("hash", "type"), "hash").join(fs, "hash").where(F.expr(f"net_timestamp <= first_seen + interval {ceiling}"))
    rows = rows.select("hash", "type", "first_seen", "peer", _micros("net_timestamp", "first_seen").alias("delay"))
    each = percentiles(rows, ["hash", "type", "first_seen"], "delay", list(PROBS.values()), [peers.alias("peers")], (t.select("hash"), ["hash"]), heavy, SPAN)
    return each.where(F.col("peers") >= peer_cutoff).select("hash", "type", "first_seen", "peers", *_spread())


def summarize_delay(messages: DataFrame, *by: str) -> DataFrame:
    """Medians over messages, to 4 places; one row, or one for each value of ``by``."""
    return messages.groupBy(*by).agg(*(F.round(F.percentile(n, 0.5), 4).alias(n) for n in PROBS), F.count(F.lit(1)).alias("messages"), F.percentile("peers", 0.5).cast("long").alias("median_peers"))


def propagation_by_type(t: DataFrame, m: DataFrame, fs: DataFrame, **options) -> DataFrame:
    """Summaries for all types and for each, from one pass: grouped by type and by a copy of every row under "all"."""
    each = propagation(t, m, fs, **options)
    labelled = each.select("*", F.explode(F.array(F.lit("all"), type_name("type"))).alias("label"))
    return summarize_delay(labelled, "label")


def delay_boxes(**summaries: DataFrame) -> DataFrame:
    """One row for each labelled summary that is not empty."""
    return reduce(DataFrame.unionByName, [s.where("p50 is not null").select(F.lit(n).alias("label"), *PROBS) for n, s in summaries.items()])


def originated(t: DataFrame, m: DataFrame, owned: DataFrame, msg_type: int | None = None) -> DataFrame:
    """Outbound receipts that their collector itself originated: of its channels, or of its own node."""
    rows = t.where("dir = 2").join(_types(m, msg_type).select("hash", "type", "orig_node", "scid"), "hash")
    own = owned.select("collector", "scid").distinct().withColumn("is_own", F.lit(True))
    gate = F.when(F.col("type") == 2, F.col("orig_node") == F.col("collector")).otherwise(F.col("is_own"))
    return rows.join(own, ["collector", "scid"], "left").where(F.coalesce(gate, F.lit(False)))


def origination(t: DataFrame, m: DataFrame, owned: DataFrame, msg_type: int | None = None) -> DataFrame:
    return originated(t, m, owned, msg_type).groupBy(F.to_date("net_timestamp").alias("day"), "type", "collector").agg(F.count(F.lit(1)).alias("receipts"), F.countDistinct("hash").alias("distinct_outer"), F.countDistinct("inner_hash").alias("distinct_inner"))


def distinct_outbound(t: DataFrame, m: DataFrame) -> DataFrame:
    rows = t.where("dir = 2").join(_types(m, None).select("hash", "type"), "hash")
    return rows.groupBy(F.to_date("net_timestamp").alias("day"), "type").agg(*(F.countDistinct(c).alias(f"distinct_{c}") for c in ("hash", "inner_hash", "collector")))


def _origins(t: DataFrame, m: DataFrame, fs: DataFrame, owned: DataFrame, msg_type: int | None) -> DataFrame:
    pairs = originated(t, m, owned, msg_type).select("hash", F.col("collector").alias("owner")).distinct()
    return pairs.join(fs.withColumnRenamed("first_seen", "t0"), "hash")


def _elsewhere(t: DataFrame, origins: DataFrame, ceiling: str) -> DataFrame:
    """Inbound receipts at other collectors within the ceiling; an origin without any keeps one row of nulls."""
    r = t.where("dir = 1").select("hash", F.col("collector").alias("receiver"), F.col("net_timestamp").alias("receipt_time"))
    on = [origins.hash == r.hash, F.col("receiver") != F.col("owner"), F.col("receipt_time") >= F.col("t0"), F.col("receipt_time") <= F.expr(f"t0 + interval {ceiling}")]
    return origins.join(r, on, "left").select(origins.hash, "owner", "t0", "receiver", "receipt_time", _micros("receipt_time", "t0").alias("delay"))


def originated_propagation(t: DataFrame, m: DataFrame, fs: DataFrame, owned: DataFrame, msg_type: int | None = None, cutoff: int = 10, ceiling: str = "1 hour", heavy: int = HEAVY) -> DataFrame:
    """One row on the messages that reach at least ``cutoff`` collectors other than an owner of theirs."""
    rows = _elsewhere(t, _origins(t, m, fs, owned, msg_type), ceiling).where("receiver is not null")
    reach = rows.groupBy("hash").agg(F.countDistinct("receiver").alias("reach")).where(F.col("reach") >= cutoff)
    # one group of all rows, which therefore may be of any size; without rows it still has one of nulls
    far = percentiles(rows.join(reach, "hash").select(F.lit(0).alias("all"), "delay"), ["all"], "delay", list(PROBS.values()), sized=(t.where("dir = 1").select("hash"), []), heavy=heavy, span=SPAN)
    delays = far.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_receipts"), F.first("p").alias("p"))
    counts = reach.agg(F.count(F.lit(1)).alias("qualifying_messages"), F.percentile("reach", 0.5).alias("median_reach"))
    return counts.crossJoin(delays).select("qualifying_messages", "total_receipts", "median_reach", *_spread())


def fanout(t: DataFrame, m: DataFrame, fs: DataFrame, owned: DataFrame, msg_type: int | None = None, cutoff: int = 5, ceiling: str = "1 hour") -> DataFrame:
    """Per day of first sight and owner; owners whose messages got nowhere keep zeros and null percentiles."""
    rows = _elsewhere(t, _origins(t, m, fs, owned, msg_type), ceiling).withColumn("day", F.to_date("t0"))
    each = rows.groupBy("day", "owner", "hash").agg(F.countDistinct("receiver").alias("reach"))
    counts = each.groupBy("day", "owner").agg(F.count(F.lit(1)).alias("originated"), F.count_if(F.col("reach") >= cutoff).alias("qualifying"))
    far = percentiles(rows, ["day", "owner"], "delay", list(PROBS.values()), [F.countDistinct("receiver").alias("receivers"), F.count("receipt_time").alias("receipts")], (t.where("dir = 1").select("hash"), []), span=SPAN)
    return counts.join(far, ["day", "owner"]).select("day", "owner", "originated", "qualifying", "receivers", "receipts", *_spread())
