"""Exact distinct counts that merge: dictionary ids, and bitmaps of them for each bucket.

Values get dense numbers in the order in which they were first seen, so that those of a stretch of time share pages of
32,768 numbers. A roll-up holds a page of bits for each bucket, key and page that occurs; counts over any buckets are the
bits of the pages' unions, which Spark merges before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whisperlake.plans.scratch import written


def dictionary(values: DataFrame, value: str, at: str) -> DataFrame:
    """(value, id): each value once; ids ascend with the first ``at`` and are dense within a partition of a range of time. Null has no id."""
    first = values.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(at).alias("_at"))
    placed = first.repartitionByRange("_at").sortWithinPartitions("_at", value)
    return written(placed.select(value, F.monotonically_increasing_id().alias("id")), "dictionary")


def extend(known: DataFrame, values: DataFrame, value: str, at: str) -> DataFrame:
    """The dictionary with the values that it lacks, numbered from beyond its last id on."""
    new = dictionary(values.join(known, value, "left_anti"), value, at)
    top = known.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("top"))
    # a fresh page, and a fresh range of partitions
    return known.unionByName(new.crossJoin(F.broadcast(top)).select(value, ((F.shiftright("top", 33) + 1) * F.lit(1 << 33) + F.col("id")).alias("id")))


def bitmap_rollup(rows: DataFrame, ids: DataFrame, value: str, width: str, *keys: str, at: str = "net_timestamp") -> DataFrame:
    """(bucket, keys, page, bits, receipts): the values of each bucket and key as pages; rows without a value are counted on page -1."""
    met = rows.join(ids, value, "left")
    bucket = F.window(at, width).start.alias("bucket")
    page, place = F.coalesce(F.bitmap_bucket_number("id"), F.lit(-1)).alias("page"), F.bitmap_bit_position(F.coalesce("id", F.lit(0)))
    each = met.groupBy(bucket, *keys, page).agg(F.bitmap_construct_agg(place).alias("bits"), F.count(F.lit(1)).alias("receipts"))
    return each.withColumn("bits", F.when(F.col("page") >= 0, F.col("bits")))


def distinct_counts(rollup: DataFrame, *by: str | Column) -> DataFrame:
    """(by, receipts, distinct): over whatever buckets the roll-up holds, exactly."""
    pages = rollup.groupBy(*by, "page").agg(F.bitmap_or_agg("bits").alias("bits"), F.sum("receipts").alias("receipts"))
    names = [c for c in pages.columns if c not in ("page", "bits", "receipts")]
    bits = F.when(F.col("page") >= 0, F.bitmap_count("bits")).otherwise(F.lit(0))
    return pages.groupBy(*names).agg(F.sum("receipts").alias("receipts"), F.sum(bits).alias("distinct"))
