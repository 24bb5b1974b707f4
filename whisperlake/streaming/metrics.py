"""Rates of a running query: what its batches observed, and what Spark reports of its progress, written as they come."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Of each micro-batch of an ingest, by name.
OBSERVED = {"lines": "count(1)", "bad": "count(error)", "first_ts": "min(net_timestamp)", "last_ts": "max(net_timestamp)", "bytes": "coalesce(sum(length(line)), 0)"}
SHAPE = "lines long, bad long, first_ts timestamp, last_ts timestamp, bytes long, seconds double, batch long"


def observed(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """Decoded lines that count themselves as they are first read."""
    seen = Observation()
    return rows.observe(seen, *(F.expr(c).alias(n) for n, c in OBSERVED.items())), seen


def write_metrics(spark: SparkSession, seen: Observation, batch: int, seconds: float, path: str) -> None:
    """One row for the batch; one that is run again replaces it."""
    got = seen.get
    row = spark.createDataFrame([(*(got[n] for n in OBSERVED), seconds, batch)], SHAPE)
    row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def rates(metrics: DataFrame) -> DataFrame:
    """Lines and bytes a second of each batch, and the share of bad lines."""
    return metrics.select("batch", "lines", "bad", F.try_divide("lines", "seconds").alias("lines_per_s"), F.try_divide("bytes", "seconds").alias("bytes_per_s"), F.try_divide("bad", "lines").alias("bad_share"))


class ProgressWriter(StreamingQueryListener):
    """Appends a row for each progress report of the session's queries: rows, rates, watermark and state.

    Reports come on a thread of their own; they are kept until ``flush`` or until ``every`` of them have come.
    """

    SHAPE = "id string, name string, batch long, at timestamp, input_rows long, input_per_s double, processed_per_s double, watermark string, state_rows long"

    def __init__(self, spark: SparkSession, path: str, every: int = 20):
        self._spark, self._path, self._every, self._rows = spark, path, every, []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = json.loads(event.progress.json)
        rate = lambda k: float(p[k]) if isinstance(p.get(k), int | float) else None
        at = dt.datetime.fromisoformat(p["timestamp"].replace("Z", "+00:00"))
        self._rows.append((p["id"], p.get("name"), p["batchId"], at, p["numInputRows"], rate("inputRowsPerSecond"), rate("processedRowsPerSecond"), p.get("eventTime", {}).get("watermark"), sum(s["numRowsTotal"] for s in p.get("stateOperators", []))))
        if len(self._rows) >= self._every:
            self.flush()

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.flush()

    def flush(self) -> None:
        rows, self._rows = self._rows, []
        if rows:
            self._spark.createDataFrame(rows, self.SHAPE).coalesce(1).write.mode("append").parquet(self._path)
