"""Structured Streaming: decoding line batches, splitting them into tables, roll-ups and state."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from whisperlake.functions import empty_to_null, message_hash, micros_to_ts, type_code
from whisperlake.operators.refresh import log_touched
from whisperlake.sources.keyed import insert_if_absent
from whisperlake.streaming.metrics import observed, write_metrics

FIELDS = 11


def decode_lines(batches: DataFrame, mode: str = "permissive", column: str = "value") -> DataFrame:
    """Payloads of lines joined by semicolons, decoded; ``error`` names what is wrong with a line, else it is null.

    ``mode="failfast"`` stops at the first bad line.
    """
    p = batches.select(F.explode(F.split(column, ";")).alias("line")).select("line", F.split("line", ",", -1).alias("f"))
    at = lambda k: F.get("f", F.lit(k))
    rows = p.select(
        "line", F.size("f").alias("n"), micros_to_ts(at(0)).alias("net_timestamp"), at(1).alias("peer"), type_code(at(2)).cast("smallint").alias("type"),
        F.when(at(3) == "inbound", 1).when(at(3) == "outbound", 2).cast("smallint").alias("dir"), at(4).try_cast("int").alias("size"), at(5).try_cast("decimal(20,0)").alias("inner_hash"),
        at(6).alias("raw"), empty_to_null(at(7)).alias("send"), empty_to_null(at(8)).alias("orig_node"), empty_to_null(at(9)).alias("scid_text"), at(10).alias("collector"),
    ).withColumns({"orig_timestamp": micros_to_ts("send"), "scid": F.col("scid_text").try_cast("decimal(20,0)")})
    most = F.lit("18446744073709551615").cast("decimal(20,0)")
    wide = lambda c: (F.col(c) < 0) | (F.col(c) > most)
    checks = {
        "fields": F.col("n") != FIELDS, "net_timestamp": F.col("net_timestamp").isNull(), "type": F.col("type").isNull(), "dir": F.col("dir").isNull(),
        "size": F.col("size").isNull() | ~F.col("size").between(0, 65535), "inner_hash": F.col("inner_hash").isNull() | wide("inner_hash"),
        "orig_timestamp": F.col("send").isNotNull() & F.col("orig_timestamp").isNull(), "scid": F.col("scid_text").isNotNull() & (F.col("scid").isNull() | wide("scid")),
    }
    error = F.coalesce(*(F.when(bad, name) for name, bad in checks.items()))
    rows = rows.withColumn("error", error).withColumns({"hash": message_hash("raw"), "peer_hash": message_hash("peer")})
    if mode == "failfast":
        rows = rows.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("bad line: "), "line")).cast("string")))
    return rows.drop("n", "send", "scid_text")


#: Bits of a row number for the place in a micro-batch: 16,384 partitions of 67 million rows, then the batch.
PART_BITS, ROW_BITS = 14, 26


def row_number(batch: int) -> Column:
    """A number that grows from batch to batch, and within one with the rows' order over its partitions."""
    at = F.monotonically_increasing_id()
    part, row = F.shiftright(at, 33), at.bitwiseAND(F.lit((1 << 33) - 1))
    fine = (part < 1 << PART_BITS) & (row < 1 << ROW_BITS)
    number = F.lit(batch << PART_BITS + ROW_BITS) + F.shiftleft(part, ROW_BITS) + row
    return F.when(fine, number).otherwise(F.raise_error(F.lit("a micro-batch is too large to number")).cast("long"))


def split_tables(rows: DataFrame, batch: int = 0) -> dict[str, DataFrame]:
    """S3; ``row_inc`` orders receipts by batch, then by time."""
    good = rows.where("error is null")
    return {
        "messages": good.select("hash", "raw"),
        "timings": good.orderBy("net_timestamp").select("net_timestamp", row_number(batch).alias("row_inc"), "hash", "inner_hash", "collector", "peer", "dir", "peer_hash", "orig_timestamp"),
        "metadata": good.select("hash", "inner_hash", "type", "size", "orig_node", "scid"),
        "message_hashes": good.select(F.col("hash").alias("outer_hash"), "inner_hash"),
    }


def ingest(batches: DataFrame, root: str, checkpoint: str, once: bool = True, interval: str = "5 seconds") -> StreamingQuery:
    """S2 to S5 as one query: receipts are appended by day, keyed tables by insert-if-absent, bad lines set aside; K6: what each batch observed goes to ``metrics``, the steps that it touched to ``log``.

    A batch that is run again after a failure appends its receipts under the same batch number, which replaces the first
    try; the keyed tables are idempotent as they are.
    """

    def write(df: DataFrame, batch: int) -> None:
        began = time.monotonic()
        rows, seen = observed(decode_lines(df))
        rows = rows.persist()
        parts = split_tables(rows, batch)
        receipts = parts["timings"].withColumn("day", F.to_date("net_timestamp")).withColumn("batch", F.lit(batch))
        receipts.sortWithinPartitions("net_timestamp").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "day").parquet(f"{root}/timings")
        for name, key in (("messages", "hash"), ("metadata", "hash"), ("message_hashes", "outer_hash")):
            insert_if_absent(parts[name], f"{root}/{name}", key)
        rows.where("error is not null").select("line", "error", F.lit(batch).alias("batch")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{root}/quarantine")
        log_touched(parts["timings"], batch, f"{root}/log")
        write_metrics(df.sparkSession, seen, batch, time.monotonic() - began, f"{root}/metrics")
        rows.unpersist()

    w = batches.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=interval)).start()


def first_seen(t: DataFrame) -> DataFrame:
    """K2: the earliest receipt of each message; one grouping does what a loop over days would."""
    return t.where("hash is not null").groupBy("hash").agg(F.min("net_timestamp").alias("first_seen"))


def update_first_seen(t: DataFrame, path: str, now: str, lookback: str = "1 day") -> None:
    """K1: messages of the last day that the table lacks; what is there stays."""
    recent = t.where(F.col("net_timestamp") > F.lit(now).cast("timestamp") - F.expr(f"interval {lookback}"))
    insert_if_absent(first_seen(recent), path, "hash")


def dedupe_stream(messages: DataFrame, lateness: str = "1 hour", key: str = "hash", at: str = "net_timestamp") -> DataFrame:
    """K3: one row for each key within the watermark."""
    return messages.withWatermark(at, lateness).dropDuplicatesWithinWatermark([key])


def rollup_stream(build, t: DataFrame, path: str, checkpoint: str, lateness: str = "3 hours") -> StreamingQuery:
    """C1 to C7 as a stream: ``build`` makes a roll-up of receipts; a bucket is written when the watermark passes it."""
    out = build(t.withWatermark("net_timestamp", lateness))
    return out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def warmup_filter(t: DataFrame, connections: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """K4: without receipts from a peer whose connection began less than ``delay`` before."""
    c = connections.select(F.col("collector").alias("c"), F.col("peer").alias("p"), "started")
    young = (F.col("collector") == F.col("c")) & (F.col("peer") == F.col("p")) & (F.col("net_timestamp") >= F.col("started")) & (F.col("net_timestamp") < F.expr(f"started + interval {delay}"))
    return t.join(c, young, "left_anti")


def liveness(heartbeats: DataFrame, now: str, expiry: str = "600 seconds") -> DataFrame:
    """K5: each collector's latest heartbeat, if not older than ``expiry``."""
    rest = [c for c in heartbeats.columns if c != "collector"]
    last = heartbeats.groupBy("collector").agg(F.max_by(F.struct(*rest), "ts").alias("x")).select("collector", "x.*")
    return last.where(F.col("ts") >= F.lit(now).cast("timestamp") - F.expr(f"interval {expiry}"))


def batch_rates(t: DataFrame, width: str = "600 seconds", at: str = "net_timestamp") -> DataFrame:
    """K6: receipts by window; a stream needs a watermark first."""
    return t.groupBy(F.window(at, width).start.alias("bucket")).agg(F.count(F.lit(1)).alias("receipts"))
