"""Rates, peer counts and activity of nodes and channels over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whisperlake.functions import time_bucket


def message_rate(t: DataFrame, m: DataFrame, width: str = "1 hour") -> DataFrame:
    rows = t.where("dir = 1").select("hash", "inner_hash", "net_timestamp").join(m.where("type in (1, 2, 3)").select("hash", "type"), "hash")
    return rows.groupBy(time_bucket(width).alias("bucket"), "type").agg(F.count(F.lit(1)).alias("receipts"), F.countDistinct("hash").alias("distinct_outer"), F.countDistinct("inner_hash").alias("distinct_inner"))


def series_mean(series: DataFrame, value: str = "receipts", by: str = "type") -> DataFrame:
    return series.groupBy(by).agg(F.avg(value).alias("mean"))


def peer_count_10m(t: DataFrame) -> DataFrame:
    return t.where("dir = 1").groupBy(time_bucket("10 minutes").alias("bucket"), "collector").agg(F.countDistinct("peer_hash").alias("peers"))


def peer_count_hourly(counts: DataFrame) -> DataFrame:
    """Hourly maximum of ten-minute counts."""
    return counts.groupBy(F.date_trunc("hour", "bucket").alias("hour"), "collector").agg(F.max("peers").alias("peers"))


def peer_count_total(hourly: DataFrame) -> DataFrame:
    """The hourly series and its sum over collectors under "total", from one grouping."""
    return hourly.select("hour", F.explode(F.array("collector", F.lit("total"))).alias("collector"), "peers").groupBy("hour", "collector").agg(F.sum("peers").alias("peers"))


def entity_counts(t: DataFrame, m: DataFrame, msg_type: int, entity: str, per_day: bool = True) -> DataFrame:
    """Distinct inner messages of a type for each entity, each day or over the whole range; inbound receipts."""
    rows = t.where("dir = 1").select("hash", "inner_hash", "net_timestamp").join(m.where((F.col("type") == msg_type) & F.col(entity).isNotNull()).select("hash", entity), "hash")
    keys = [F.to_date("net_timestamp").alias("day")] if per_day else []
    return rows.groupBy(*keys, entity).agg(F.countDistinct("inner_hash").alias("messages"))


def avg_daily_active(daily: DataFrame, entity: str) -> DataFrame:
    """Mean over the days on which the entity was active, to 1 place."""
    return daily.groupBy(entity).agg(F.round(F.avg("messages"), 1).alias("avg_daily"))


def avg_daily_range(total: DataFrame, entity: str, days: int) -> DataFrame:
    """Total over all days of the range, to 2 places."""
    return total.select(entity, F.round(F.col("messages") / days, 2).alias("avg_daily"))


#: Lower and upper edges; None is open.
THRESHOLDS = [(1, 1), (1, 10), (10, 100), (100, 1000), (1000, None)]


def bucket_counts(df: DataFrame, count_col: str, thresholds: list[tuple[float, float | None]] = THRESHOLDS) -> DataFrame:
    """Entities and sums by bucket: the first includes its lower edge, later ones do not; empty ones stay; below: dropped."""
    edge, c = None, F.lit(None).cast("int")
    for k, (lo, hi) in reversed(list(enumerate(thresholds))):
        above = F.col(count_col) >= lo if k == 0 else F.col(count_col) > (thresholds[k - 1][1])
        c = F.when(above & (F.lit(True) if hi is None else F.col(count_col) <= hi), k).otherwise(c)
    spark = df.sparkSession
    edge = spark.createDataFrame([(k, float(lo), None if hi is None else float(hi)) for k, (lo, hi) in enumerate(thresholds)], "bucket int, low double, high double")
    found = df.select(c.alias("bucket"), F.col(count_col).cast("double").alias("v")).where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    total = found.agg(F.sum("s").alias("total"))
    out = edge.join(found, "bucket", "left").crossJoin(F.broadcast(total))
    pct = F.when(F.coalesce("total", F.lit(0.0)) == 0, 0.0).otherwise(F.round(F.coalesce("s", F.lit(0.0)) * 100 / F.col("total"), 1))
    return out.select("bucket", "low", "high", F.coalesce("n", F.lit(0)).alias("entity_count"), F.coalesce("s", F.lit(0.0)).alias("message_sum"), pct.alias("message_pct"))
