"""One large JSON array of objects, read by many tasks.

The file is read as text whose records end at closing braces, which Spark splits by byte ranges. Whether a piece begins
inside of a string, and how deep, depends on all before it: each range sums its quotes and brackets, a scan over the ranges
carries both, and each piece gets them from its range and from the pieces before it there. A closing brace that brings the
depth back to that of the array ends an object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PLACE = ["file", "block"]


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, piece): the text up to each closing brace, in order within its range of bytes."""
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("piece"))


def _carried(rows: DataFrame, column: str, name: str) -> DataFrame:
    """With the sum of ``column`` over all pieces before, as ``name``: of the ranges before by a scan over their sums, of the pieces before within the range."""
    sums = rows.groupBy(*PLACE).agg(F.sum(column).alias("_sum"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = sums.select(*PLACE, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*PLACE).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(sums, PLACE).withColumn(name, F.col("_before") + F.coalesce(F.sum(column).over(inside), F.lit(0))).drop("_before")


def _count(text: Column, of: str) -> Column:
    return F.length(text) - F.length(F.translate(text, of, ""))


def objects(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, text): the objects of each file's array, or of several arrays behind one another, as text, numbered from 0 in their order."""
    rows = pieces(spark, path).withColumn("bare", F.regexp_replace("piece", r"\\.", ""))
    rows = _carried(rows.withColumn("quotes", _count(F.col("bare"), '"')), "quotes", "quotes_before")
    # every other part between quotes is outside of strings
    outside = F.concat_ws("", F.filter(F.split("bare", '"'), lambda x, k: (k + F.col("quotes_before")) % 2 == 0))
    closes = (F.col("quotes_before") + F.col("quotes")) % 2 == 0  # the brace that ends the piece is not in a string
    rows = rows.withColumn("depth", _count(outside, "{[") - _count(outside, "]}") - closes.cast("int")).withColumn("closes", closes)
    rows = _carried(rows.drop("bare", "quotes", "quotes_before"), "depth", "depth_before")
    # the last piece is what follows the last brace: the end of the array, or an object that was cut off
    last = rows.groupBy("file").agg(F.max(F.struct("block", "at")).alias("last"))
    ends = F.col("closes") & (F.col("depth_before") + F.col("depth") == 1) & (F.struct("block", "at") < F.col("last"))
    rows = rows.join(last, "file")
    rows = _carried(rows.withColumn("ends", ends.cast("int")), "ends", "number")
    whole = rows.groupBy("file", "number").agg(F.max("ends").alias("ended"), F.array_sort(F.collect_list(F.struct("block", "at", "piece"))).alias("parts"))  # an object's pieces
    text = F.concat(F.array_join(F.transform("parts", lambda p: p["piece"]), "}"), F.lit("}"))
    return whole.where("ended = 1").select("file", "number", F.regexp_replace(text, r"^[\s\[\],]+", "").alias("text"))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of an array, or of several files' arrays, with the fields of ``schema``; what an object lacks is null.

    An empty array gives no rows, and so does text that is no array of objects. One that is cut off loses its last object.
    """
    return objects(spark, path).select(F.from_json("text", schema).alias("o")).select("o.*")
