"""Reading and writing the tables, and the jobs of their life cycle. Paths may be on any file system that Spark reads."""

from __future__ import annotations

import datetime as dt
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from whisperlake.plans.files import delete, exists, one_slash, qualified, size_of
from whisperlake.sources.json_array import read_json_array
from whisperlake.sources.keyed import insert_if_absent, read_keyed

TABLES = ("timings", "metadata", "message_first_seen")
COMPANIONS = ("messages", "metadata", "message_hashes", "message_first_seen")


def day_path(root: str, table: str, day: dt.date) -> str:
    return f"{root}/{table}/{day:%Y/%m/%d}/{table}_{day:%Y-%m-%d}.parquet"


def load_range(spark: SparkSession, root: str, end: dt.date, days: int, tables: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    """The daily files of ``days`` days back from ``end``, a view for each table; missing days are warned of."""
    out = {}
    for table in tables:
        paths = [day_path(root, table, end - dt.timedelta(days=k)) for k in range(days)]
        found = [p for p in paths if exists(spark, p)]
        for p in sorted(set(paths) - set(found)):
            warnings.warn(f"no file {p}", stacklevel=2)
        if found:
            out[table] = spark.read.parquet(*found)
            out[table].createOrReplaceTempView(table)
    return out


def append_timings(df: DataFrame, path: str) -> None:
    """Every receipt, by day, sorted by time within each file."""
    df.withColumn("day", F.to_date("net_timestamp")).repartition("day").sortWithinPartitions("net_timestamp").write.mode("append").option("compression", "zstd").partitionBy("day").parquet(path)


def _range(df: DataFrame, column: str, day: dt.date) -> DataFrame:
    return df.where((F.col(column) >= F.lit(day).cast("timestamp")) & (F.col(column) < F.lit(day + dt.timedelta(days=1)).cast("timestamp")))


#: What Spark says of a file that is there and is no whole Parquet file, or of a folder without one.
BROKEN = ("is not a Parquet file", "CANNOT_READ_FILE_FOOTER", "UNABLE_TO_INFER_SCHEMA", "Could not read footer", "is not a valid Parquet")


def export_once(df: DataFrame, path: str, sort: str | None = None) -> tuple[str, int, int]:
    """(path, rows, bytes) of the export at ``path``; one that reads well is kept, a broken one is made anew."""
    spark = df.sparkSession
    if exists(spark, path):
        try:
            return path, spark.read.parquet(path).count(), size_of(spark, path)
        except Exception as e:
            if not any(x in str(e) for x in BROKEN):
                raise  # the store may be out of reach, which says nothing about the file
            warnings.warn(f"{path} is made anew: {type(e).__name__}", stacklevel=2)
            delete(spark, path)
    rows = df.sortWithinPartitions(sort) if sort else df
    rows.write.option("compression", "zstd").parquet(path)
    return path, spark.read.parquet(path).count(), size_of(spark, path)


def export_day(t: DataFrame, day: dt.date, root: str) -> tuple[str, int, int]:
    """The receipts of one day, midnight to midnight."""
    return export_once(_range(t, "net_timestamp", day), day_path(root, "timings", day), "net_timestamp")


def export_companion(df: DataFrame, fs: DataFrame, table: str, day: dt.date, root: str, key: str = "hash") -> tuple[str, int, int]:
    """The rows whose hash was first seen on the day, with that time."""
    seen = _range(fs, "first_seen", day)
    rows = seen if table == "message_first_seen" else df.join(seen.withColumnRenamed("hash", key), key)
    return export_once(rows, day_path(root, table, day))


LOG = "range_start timestamp, range_end timestamp, range_table string, archived_at timestamp, row_count long, file_path string, file_size_bytes long"


def record_archive(spark: SparkSession, log: str, day: dt.date, table: str, done: tuple[str, int, int], now: dt.datetime) -> None:
    """One row for a range and table; the first one stays."""
    start = dt.datetime.combine(day, dt.time())
    insert_if_absent(spark.createDataFrame([(start, start + dt.timedelta(days=1), table, now, done[1], done[0], done[2])], LOG), log, ["range_start", "range_end", "range_table"])


def pending_ranges(t: DataFrame, log: DataFrame, after_days: int, now: dt.datetime) -> DataFrame:
    """Closed days older than ``after_days`` that have receipts and no log row, oldest first."""
    days = t.select(F.date_trunc("day", "net_timestamp").alias("range_start")).distinct().where(F.col("range_start") + F.expr("interval 1 day") <= F.lit(now - dt.timedelta(days=after_days)))
    return days.join(log.where("range_table = 'timings'").select("range_start"), "range_start", "left_anti").orderBy("range_start")


def missing_companions(log: DataFrame, companions: tuple[str, ...] = COMPANIONS) -> DataFrame:
    """Of each archived range, the companions without a log row."""
    ranges = log.where("range_table = 'timings'").select("range_start", F.explode(F.array(*map(F.lit, companions))).alias("range_table"))
    return ranges.join(log.select("range_start", "range_table"), ["range_start", "range_table"], "left_anti").orderBy("range_start", "range_table")


def file_rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_path, parquet_rows, file_bytes) of exports, by one job over all of them: no column is read, so that rows are counted by the footers.

    One that is not there, is broken, or holds no rows counts as -1. That a path exists is asked of its store first, so
    that a store out of reach is an error and not a verdict.
    """
    whole = {qualified(spark, p): p for p in paths if exists(spark, p)}
    named = spark.createDataFrame([(q, p) for q, p in whole.items()], "folder string, file_path string")
    every = spark.createDataFrame([(p,) for p in paths], "file_path string")
    if not whole:
        return every.select("file_path", F.lit(-1).cast("long").alias("parquet_rows"), F.lit(-1).cast("long").alias("file_bytes"))
    rows = spark.read.schema("row_inc long").option("ignoreCorruptFiles", True).parquet(*whole.values())
    # an export is a folder of files, or one file
    files = rows.groupBy(one_slash(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_size").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    parent = F.regexp_replace("file", "/[^/]*$", "")
    each = files.join(F.broadcast(named), (F.col("folder") == parent) | (F.col("folder") == F.col("file"))).groupBy("file_path").agg(F.sum("n").alias("parquet_rows"), F.sum("size").alias("part_bytes"))
    sizes = spark.createDataFrame([(p, size_of(spark, p)) for p in whole.values()], "file_path string, file_bytes long")
    found = each.join(sizes, "file_path").select("file_path", "parquet_rows", "file_bytes")
    return every.join(found, "file_path", "left").na.fill(-1, ["parquet_rows", "file_bytes"])


def retention_verify(t: DataFrame, log: DataFrame, after_days: int, now: dt.datetime) -> DataFrame:
    """For old archived days, whether live rows, logged rows and rows in the file agree, and bytes too; see ``file_rows``."""
    spark = t.sparkSession
    old = log.where((F.col("range_table") == "timings") & (F.col("range_end") <= F.lit(now - dt.timedelta(days=after_days))))
    files = file_rows(spark, [r["file_path"] for r in old.select("file_path").distinct().collect()])  # a path for each archived day
    live = t.groupBy(F.date_trunc("day", "net_timestamp").alias("range_start")).agg(F.count(F.lit(1)).alias("db_rows"))
    out = old.join(live, "range_start", "left").join(files, "file_path", "left").withColumn("db_rows", F.coalesce("db_rows", F.lit(0)))
    good = (F.col("db_rows") == F.col("row_count")) & (F.col("row_count") == F.col("parquet_rows")) & (F.col("file_size_bytes") == F.col("file_bytes"))
    return out.select("range_start", "range_end", "db_rows", F.col("row_count").alias("log_rows"), "parquet_rows", "file_bytes", "file_path", F.coalesce(good, F.lit(False)).alias("verified"))


def retention_apply(verdict: DataFrame, timings_path: str, deletion_log: str, now: dt.datetime, dry_run: bool = True) -> list[dt.datetime]:
    """Drop the verified days' partitions and log each; a dry run only names them."""
    spark, gone = verdict.sparkSession, []
    for r in verdict.where("verified").orderBy("range_start").collect():
        gone.append(r["range_start"])
        if not dry_run:
            insert_if_absent(spark.createDataFrame([(*r[:6], r["file_path"], now)], "range_start timestamp, range_end timestamp, db_rows long, log_rows long, parquet_rows long, file_bytes long, file_path string, dropped_at timestamp"), deletion_log, ["range_start", "range_end"])
            delete(spark, f"{timings_path}/day={r['range_start']:%Y-%m-%d}")
    return gone


def compact_traffic(m: DataFrame, fs: DataFrame) -> DataFrame:
    """One row for each outer hash of types 1 to 3, by first sight."""
    return m.where("type in (1, 2, 3)").join(fs, "hash").select("first_seen", "hash", "inner_hash", "type", "size", "orig_node", "scid").orderBy("first_seen", "hash")


def full_export(tables: dict[str, DataFrame], root: str, rows_per_file: int = 3_932_160) -> None:
    """S15."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").parquet(f"{root}/{name}")


def incremental_sync(t: DataFrame, keyed: dict[str, DataFrame], root: str, cutoff: dt.datetime) -> None:
    """Receipts after the last sync up to ``cutoff``, keyed tables by insert-if-absent, then the state."""
    spark, state = t.sparkSession, f"{root}/_sync_state"
    last = spark.read.parquet(state).where("table_name = 'timings'").agg(F.max("last_synced_ts")).first()[0] if exists(spark, state) else None
    rows = t.where(F.col("net_timestamp") <= F.lit(cutoff))
    rows = rows if last is None else rows.where(F.col("net_timestamp") > F.lit(last))
    # a run that failed before its state was written is replaced by the next one, which begins at the same time
    since = "start" if last is None else f"{last:%Y%m%dT%H%M%S%f}"
    rows.withColumn("since", F.lit(since)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("since").parquet(f"{root}/timings")
    for name, df in keyed.items():
        insert_if_absent(df, f"{root}/{name}", "hash")
    spark.createDataFrame([("timings", cutoff)], "table_name string, last_synced_ts timestamp").write.mode("append").parquet(state)


def write_csv(df: DataFrame, path: str, by: str | None = None) -> None:
    """With a header; a folder for each value of ``by``."""
    w = df.write.mode("overwrite").option("header", True)
    (w.partitionBy(by) if by else w).csv(path)


def read_csv_typed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Any record that does not fit fails the read."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def write_graph_json(frames: dict[str, DataFrame], root: str, now: dt.datetime) -> str:
    """Compressed JSON in a folder named by the minute."""
    path = f"{root}/{now:%Y%m%dT%H%M}"
    for name, df in frames.items():
        df.write.mode("overwrite").option("compression", "gzip").json(f"{path}/{name}")
    return path


def read_socket_samples(spark: SparkSession, path: str) -> DataFrame:
    """Five tab-separated fields; comments and malformed rows are skipped."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f")).where(F.size("f") == 5)
    rows = lines.select(F.col("f")[0].try_cast("long").alias("epoch"), F.col("f")[1].alias("uuid"), F.col("f")[2].try_cast("int").alias("local_port"), F.col("f")[3].alias("remote_ip"), F.col("f")[4].try_cast("int").alias("remote_port"))
    return rows.where("epoch is not null and local_port is not null and remote_port is not null")


def region_lookup(nodes: DataFrame, path: str, iso: str = "iso_code") -> DataFrame:
    """Nodes with the region of their country, from a tab-separated table (iso_code, region)."""
    regions = nodes.sparkSession.read.schema("iso_code string, region string").option("sep", "\t").option("header", True).csv(path)
    return nodes.join(regions.withColumnRenamed("iso_code", iso), iso, "left")


def merge_append_json(spark: SparkSession, paths: list[str], schemas: list[str]) -> DataFrame:
    """Several node lists as one; columns that a list lacks are null."""
    first, *rest = (read_json_array(spark, p, s) for p, s in zip(paths, schemas))
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first
