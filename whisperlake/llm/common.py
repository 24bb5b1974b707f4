"""What several operators share: reading a table, null texts, batches of bounded size."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from whisperlake.plans.scratch import ship_package

#: What Spark hands to Python at once; texts are long, so that the bytes bound the memory of a worker, whatever the rows.
ARROW_ROWS, ARROW_BYTES = 2048, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Ready the session for functions that get texts in batches; the two settings stay, as plans are made lazily."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) with any further columns asked for."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in pieces whose ``text`` is at most so many bytes, but for a longer single text."""
    for b in batches:
        sizes = pc.binary_length(b.column("text")).to_pylist()
        at = size = 0
        for k, n in enumerate(sizes):
            if size and size + n > most_bytes:
                yield b.slice(at, k - at)
                at, size = k, 0
            size += n
        if at < len(sizes):
            yield b.slice(at)


def slot_bits(slots: DataFrame, bits: int) -> np.ndarray:
    """A table of 2**``bits`` bits in which those of ``slots`` (slot long) are set: of one size, however many rows there are."""
    words = slots.groupBy(F.shiftright("slot", 5).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1, cast(slot & 31 as int))")).alias("bits"))
    found = words.toArrow()  # 8 bytes for each 32 bits that hold any
    out = np.zeros(1 << bits - 5, np.uint32)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint32)
    return out


def held(slots: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of the slots are set in the table."""
    return bits[slots >> 5] >> (slots & 31).astype(np.uint32) & np.uint32(1) > 0


#: Keys that more than one row in HEAVY_SHARE has are fewer than HEAVY_SHARE, whatever the input.
HEAVY_ROWS, HEAVY_SHARE = 10_000, 100_000


def join_counted(rows: DataFrame, keyed: DataFrame, key: list[str], n: str, total: int, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Inner equi join of ``rows`` with ``keyed``, whose column ``n`` counts the rows of each key, of ``total``.

    Keys of more than ``heavy_rows`` rows and of more than one row in HEAVY_SHARE meet their rows by a broadcast of that
    bounded number of keys, so that no task gets all rows of one; the others are joined on the key.
    """
    heavy = F.col(n) > max(heavy_rows, total // HEAVY_SHARE)
    many = F.broadcast(keyed.where(heavy))
    return rows.join(many, key).unionByName(rows.join(many, key, "left_anti").join(keyed.where(~heavy), key))


def crc_fold(column: str = "doc_id", of: int = 5) -> Column:
    """crc32 of the id as text, modulo ``of``: 0 is held out."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(of)


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
