"""Files and folders on any file system that Spark reaches."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def size_of(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, path)
    return fs.getContentSummary(p).getLength()


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of its store, and one slash behind that, as ``one_slash`` gives it."""
    fs, p = _fs(spark, path)
    return re.sub(SLASHES, ":/", fs.makeQualified(p).toUri().toString())


#: Behind a scheme, where stores and Spark differ in their number.
SLASHES = "(?<!/):/+"


def one_slash(c: Column) -> Column:
    return F.regexp_replace(c, SLASHES, ":/")
