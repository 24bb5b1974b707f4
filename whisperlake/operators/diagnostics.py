"""Small listings about the tables and the collectors' registry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rows_per_day(t: DataFrame, days: int = 21) -> DataFrame:
    """The last ``days`` days that have receipts."""
    return t.groupBy(F.to_date("net_timestamp").alias("day")).agg(F.count(F.lit(1)).alias("receipts")).orderBy(F.desc("day")).limit(days)


def archive_listing(log: DataFrame) -> DataFrame:
    """D2."""
    return log.orderBy("range_start", "range_table")


def first_seen_window(fs: DataFrame, start: str, end: str, limit: int | None = 30_000) -> DataFrame:
    """D3: hashes first seen strictly inside the window, earliest first; with ``limit=None`` all of them."""
    inside = fs.where((F.col("first_seen") > F.lit(start).cast("timestamp")) & (F.col("first_seen") < F.lit(end).cast("timestamp")))
    rows = inside.select(F.hex("hash").alias("hash_hex"), "first_seen").orderBy("first_seen", "hash_hex")
    return rows if limit is None else rows.limit(limit)


def receipts_for_hash(t: DataFrame, key: int, start: str, end: str, limit: int | None = 1000) -> DataFrame:
    rows = t.where((F.col("hash") == key) & (F.col("net_timestamp") >= F.lit(start).cast("timestamp")) & (F.col("net_timestamp") < F.lit(end).cast("timestamp")))
    rows = rows.orderBy("net_timestamp", "row_inc")
    return rows if limit is None else rows.limit(limit)


def shares(counts: DataFrame, value: str) -> DataFrame:
    """A table of counts with each row's share of their sum in percent, worked out anew, largest first."""
    total = counts.agg(F.sum(value).alias("_total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("pct", F.try_divide(F.col(value) * 100.0, F.col("_total"))).drop("_total").orderBy(F.desc(value))


def frequency_bins(counts: DataFrame, edges: list[float], value: str, weight: str | None = None, cap: bool = False) -> DataFrame:
    """Right-closed bins, the first one with its lower edge; sums ``weight`` or counts rows.

    With ``cap`` values over the last edge are left out, else they have a bin of their own, numbered last.
    """
    b = F.lit(None if cap else len(edges) - 1).cast("int")
    for k in range(len(edges) - 2, -1, -1):
        b = F.when(F.col(value) <= edges[k + 1], k).otherwise(b)
    b = F.when(F.col(value) >= edges[0], b)
    return counts.select(b.alias("bin"), (F.col(weight) if weight else F.lit(1)).alias("w")).where("bin is not null").groupBy("bin").agg(F.sum("w").alias("total"))


def status(heartbeats: DataFrame, registered: DataFrame) -> DataFrame:
    """One row: current and target peers, collectors online and offline, and the ids of the latter."""
    live = heartbeats.groupBy("uuid").agg(F.max_by(F.struct("peers", "target"), "ts").alias("x")).select("uuid", "x.*")
    every = registered.select("uuid").join(live, "uuid", "left")
    return every.agg(F.coalesce(F.sum("peers"), F.lit(0)).alias("peers"), F.coalesce(F.sum("target"), F.lit(0)).alias("target"), F.count("peers").alias("online"), F.count_if(F.col("peers").isNull()).alias("offline"), F.array_sort(F.collect_list(F.when(F.col("peers").isNull(), F.col("uuid")))).alias("offline_ids"))


def registry_audit(registry: DataFrame, mapping: DataFrame, communities: DataFrame) -> DataFrame:
    """(check, subject, n): duplicate ids, sockets used twice, mapped ids without an entry, communities without a
    collector, and collectors for each host. registry(uuid, host, port), mapping(uuid, community), communities(community, size)."""
    row = lambda df, name, subject, n="n": df.select(F.lit(name).alias("check"), F.col(subject).cast("string").alias("subject"), F.col(n).cast("long").alias("n"))
    count = lambda *c: registry.groupBy(*c).agg(F.count(F.lit(1)).alias("n"))
    return reduce(DataFrame.unionByName, [
        row(count("uuid").where("n > 1"), "duplicate_id", "uuid"),
        row(count("host", "port").where("n > 1").withColumn("s", F.concat_ws(":", "host", "port")), "socket_conflict", "s"),
        row(mapping.join(registry, "uuid", "left_anti").withColumn("n", F.lit(1)), "unknown_id", "uuid"),
        row(communities.join(mapping, "community", "left_anti"), "uncovered_community", "community", "size"),
        row(count("host"), "collectors_on_host", "host"),
    ])
