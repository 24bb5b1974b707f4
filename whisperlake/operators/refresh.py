"""Roll-ups kept up to date in steps of two hours: only the steps that receipts touched are made anew."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from whisperlake.plans.files import exists

STEP = 7200


def step_of(at: str) -> Column:
    """The number of the two hours that a time falls into."""
    return F.floor(F.unix_micros(at) / (STEP * 1_000_000)).cast("long")


def log_touched(rows: DataFrame, batch: int, log: str) -> None:
    """The steps that a batch of receipts falls into; a batch that is run again replaces its own rows."""
    steps = rows.where("net_timestamp is not null").select(step_of("net_timestamp").alias("step")).distinct()
    steps.withColumn("batch", F.lit(batch)).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{log}/touched")


def pending(spark: SparkSession, log: str) -> DataFrame:
    """(step, batch) that were touched and not refreshed since."""
    touched = spark.read.schema("step long, batch long").parquet(f"{log}/touched")
    if not exists(spark, f"{log}/done"):
        return touched
    return touched.join(spark.read.schema("step long, batch long").parquet(f"{log}/done"), ["step", "batch"], "left_anti")


def refresh_touched(build: Callable[[DataFrame], DataFrame], t: DataFrame, path: str, log: str, at_once: int = 12, most: int | None = None) -> list[int]:
    """Make the pending steps anew from all their receipts, oldest first, ``at_once`` in a job; returns them.

    ``build`` makes a roll-up, whose buckets lie within a step, from receipts. Folders of other steps are not written. What
    is done is noted after each job, so that a run that failed, or was told to do ``most`` steps, is taken up by the next.
    """
    spark = t.sparkSession
    due = pending(spark, log)
    rows = due.groupBy("step").agg(F.collect_set("batch").alias("batches")).orderBy("step")
    todo = (rows.limit(most) if most else rows).collect()  # steps of two hours
    for k in range(0, len(todo), at_once):
        part = todo[k : k + at_once]
        steps = [r["step"] for r in part]
        at = lambda s: dt.datetime(1970, 1, 1) + dt.timedelta(seconds=s * STEP)
        # the range prunes files, the steps choose within it
        near = t.where((F.col("net_timestamp") >= F.lit(at(steps[0]))) & (F.col("net_timestamp") < F.lit(at(steps[-1] + 1)))).where(step_of("net_timestamp").isin(steps))
        made = build(near).withColumn("step", step_of("bucket"))
        made.repartition("step").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("step").parquet(path)
        done = [(r["step"], b) for r in part for b in r["batches"]]
        spark.createDataFrame(done, "step long, batch long").coalesce(1).write.mode("append").parquet(f"{log}/done")
    return [r["step"] for r in todo]
