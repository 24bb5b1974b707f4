"""Tables of one row for each key: hash buckets, and a Bloom filter of each bucket's keys for every batch that was added.

A table is a folder ``key_batch=B/key_bucket=N`` of Parquet files, and ``_filters`` beside them with pages of bits. A key
belongs to one bucket and to one page of its filters, by its hash. Keys spread over all files by hash, so ranges of them
prune nothing; what a batch must be compared with is found by asking the filters, which are some ten bits a key, and only
the folders whose filter says maybe are opened. A batch's filter is written before its rows: rows without a filter cannot
be, and a filter without rows, after a failure, opens nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from whisperlake.plans.files import delete, exists

#: Buckets of a table, pages of a bucket's filter for one batch, bits of a page (those of Spark's bitmaps), bits set for a key.
BUCKETS, PAGES, PAGE_BITS, PROBES = 16, 64, 32_768, 4
PARTS = ("key_batch", "key_bucket")


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def _page(keys: list[str]) -> Column:
    return F.pmod(F.shiftright(F.xxhash64(*keys), 20), F.lit(PAGES)).cast("int")


def _probes(keys: list[str]) -> Column:
    """Places in the page, from another hash."""
    h = F.xxhash64(F.lit(7), *keys)
    return F.array(*(F.pmod(F.shiftright(h, 15 * k), F.lit(PAGE_BITS)) for k in range(PROBES)))


def _set(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) > 0


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a keyed table, without the columns of its layout."""
    return spark.read.parquet(path).drop(*PARTS)


def segments_to_open(new: DataFrame, path: str, keys: list[str]) -> list[tuple[str, int]]:
    """The (batch, bucket) folders that may hold a key of ``new``, as their filters tell; at most the table's number of folders."""
    spark = new.sparkSession
    filters = spark.read.parquet(f"{path}/_filters")
    asked = new.select(_bucket(keys).alias("key_bucket"), _page(keys).alias("page"), _probes(keys).alias("probes"))
    maybe = asked.join(filters, ["key_bucket", "page"]).where(F.forall("probes", lambda p: _set(F.col("bits"), p)))
    found = maybe.select(*PARTS).distinct().collect()
    return sorted((r["key_batch"], r["key_bucket"]) for r in found)


def absent(new: DataFrame, path: str, keys: list[str]) -> tuple[DataFrame, int]:
    """The rows of ``new`` whose key the table at ``path`` lacks, and how many of its folders were opened to tell."""
    spark = new.sparkSession
    folders = [p for p in (f"{path}/key_batch={b}/key_bucket={k}" for b, k in segments_to_open(new, path, keys)) if exists(spark, p)]
    if not folders:
        return new, 0
    held = spark.read.option("basePath", path).parquet(*folders).select(*keys)
    safe = [F.col(f"new.{k}").eqNullSafe(F.col(f"held.{k}")) for k in keys]
    return new.alias("new").join(held.alias("held"), safe, "left_anti"), len(folders)


def insert_if_absent(df: DataFrame, path: str, key: str | list[str]) -> int:
    """Append the rows whose key is not there yet; of equal keys in ``df`` any one; null is a key like others.

    Returns how many folders of the table were read.
    """
    keys = [key] if isinstance(key, str) else key
    spark = df.sparkSession
    new, opened = df.dropDuplicates(keys).persist(), 0
    if exists(spark, f"{path}/_filters"):
        fresh, opened = absent(new, path, keys)
    else:
        fresh = new
    _append(fresh, path, keys)
    new.unpersist()
    return opened


def _append(rows: DataFrame, path: str, keys: list[str]) -> None:
    batch = f"b-{uuid.uuid4().hex}"
    placed = rows.withColumn("key_batch", F.lit(batch)).withColumn("key_bucket", _bucket(keys))
    placed = placed.repartition("key_bucket").persist()
    bits = placed.select(*PARTS, _page(keys).alias("page"), F.explode(_probes(keys)).alias("place"))
    filters = bits.groupBy(*PARTS, "page").agg(F.bitmap_construct_agg("place").alias("bits"))
    filters.coalesce(1).write.mode("append").option("compression", "zstd").parquet(f"{path}/_filters")
    placed.sortWithinPartitions("key_bucket", *keys).write.mode("append").option("compression", "zstd").partitionBy(*PARTS).parquet(path)
    placed.unpersist()


def compact(spark: SparkSession, path: str, key: str | list[str]) -> None:
    """All batches as one, so that a key meets one filter; a run that failed half-way left rows twice, which this one drops."""
    keys = [key] if isinstance(key, str) else key
    old = sorted({r["key_batch"] for r in spark.read.parquet(f"{path}/_filters").select("key_batch").distinct().collect()})
    if len(old) < 2:
        return
    rows = spark.read.parquet(path).where(F.col("key_batch").isin(old)).drop(*PARTS).dropDuplicates(keys)
    _append(rows, path, keys)
    kept = spark.read.parquet(f"{path}/_filters").where(~F.col("key_batch").isin(old)).collect()  # one batch's: BUCKETS x PAGES rows at most
    for b in old:
        delete(spark, f"{path}/key_batch={b}")
    spark.createDataFrame(kept, spark.read.parquet(f"{path}/_filters").schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/_filters")
