"""Exact percentiles of groups of any size.

``percentile`` keeps every distinct value of a group in one task's memory. Here groups of more rows than ``heavy`` are
looked at apart: their values are counted in a histogram of a fixed number of cells, summed before the shuffle, so that a
cell is known for each rank asked for; the rows of those cells are counted again in finer cells, until a cell is one value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups beyond so many rows are refined, or beyond one row in SHARE of all if that is more, so that they are fewer than
#: SHARE whatever the input; cells of a histogram.
HEAVY, SHARE, CELLS = 1_000_000, 400_000, 4096


def percentiles(rows: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], more: Sequence[Column] = (), sized: tuple[DataFrame, list[str]] | None = None, heavy: int = HEAVY, span: int = 1 << 42, disc: bool = False) -> DataFrame:
    """(keys, n, p array<double>, more): rows of each group, its percentiles of ``value`` (whole numbers), interpolated as
    ``percentile`` does, or with ``disc`` the least values that reach them, and the aggregates ``more``.

    Null values do not count and a group of nulls has a null array; null keys are a group. ``sized`` names rows that are
    cheaper to count, at least as many for each group, and some of the keys, or none: groups that agree on these are refined
    together where their rows are many. The count is a job of its own. ``span``
    bounds the difference of the largest and the least value of a heavy group and so the number of passes; a larger one is
    an error.
    """
    keys = list(keys)
    counted, by = sized if sized else (rows, keys)
    found_at = F.array(*(F.expr(f"percentile_disc({p}) within group (order by `{value}`)") for p in probs)) if disc else F.percentile(value, F.array(*map(F.lit, probs)))
    plain = lambda r: r.groupBy(*keys).agg(F.count(value).alias("n"), F.when(F.count(value) > 0, found_at.cast("array<double>")).alias("p"), *more)
    sizes = counted.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    most = sizes.agg(F.greatest(F.lit(heavy), F.coalesce(F.sum("_n") / SHARE, F.lit(0))).alias("_most"))
    found = sizes.crossJoin(F.broadcast(most)).where("_n > _most").select(*by, "_n").collect()  # fewer than SHARE rows, mostly none
    if not found:
        return plain(rows)
    if not by:
        return _refined(rows, keys, value, probs, more, span, disc)
    kinds = ", ".join(f"`{k}` {counted.schema[k].dataType.simpleString()}" for k in by)
    large = F.broadcast(rows.sparkSession.createDataFrame([tuple(r)[:-1] for r in found], kinds))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"h.{k}")) for k in by]
    light, dense = (rows.alias("r").join(large.alias("h"), same, how) for how in ("left_anti", "left_semi"))
    return plain(light).unionByName(_refined(dense, keys, value, probs, more, span, disc))


def _refined(dense: DataFrame, keys: list[str], value: str, probs: Sequence[float], more: Sequence[Column], span: int, disc: bool = False) -> DataFrame:
    ends = dense.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).cast("long").alias("low"), F.max(value).cast("long").alias("high"))
    rows = dense.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("long").alias("_v"))
    # (keys, n, rank, low, before): a rank's cell begins at low, and so many values are less
    place = (lambda p: F.greatest(F.ceil(p * F.col("n")), F.lit(1)) - 1) if disc else (lambda p: p * (F.col("n") - 1))
    at = F.transform(F.array(*map(F.lit, probs)), lambda p: place(p).cast("double"))
    ranks = F.array_distinct(F.flatten(F.transform(at, lambda x: F.array(F.floor(x).cast("long"), F.ceil(x).cast("long")))))
    fits = F.when(F.col("high") - F.col("low") < F.lit(span), F.col("low")).otherwise(F.raise_error(F.lit("values of a group lie further apart than span")).cast("long"))
    want = ends.where("n > 0").select(*keys, "n", F.explode(ranks).alias("rank"), fits.alias("low"), F.lit(0).cast("long").alias("before"))
    width = span
    while width > 1:
        width = -(-width // CELLS)
        cells = want.select(*keys, "low").distinct()
        met = rows.join(F.broadcast(cells), _equal(rows, cells, keys)).select(*(rows[k] for k in keys), "low", F.floor((F.col("_v") - F.col("low")) / width).cast("long").alias("cell"))
        counts = met.where(F.col("cell").between(0, CELLS - 1)).groupBy(*keys, "low", "cell").agg(F.count(F.lit(1)).alias("c"))
        upto = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*keys, "low").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)))
        found = want.alias("w").join(upto.alias("u"), [F.col(f"w.{k}").eqNullSafe(F.col(f"u.{k}")) for k in (*keys, "low")])
        hit = found.where((F.col("rank") >= F.col("before") + F.col("upto") - F.col("c")) & (F.col("rank") < F.col("before") + F.col("upto")))
        want = hit.select(*(F.col(f"w.{k}").alias(k) for k in keys), "n", "rank", (F.col("w.low") + F.col("cell") * width).alias("low"), (F.col("before") + F.col("upto") - F.col("c")).alias("before"))
    values = want.groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "low"))).alias("m"))  # two ranks for each probability
    low, high = (lambda x: F.element_at("m", F.floor(x).cast("long"))), (lambda x: F.element_at("m", F.ceil(x).cast("long")))
    each = F.transform(at, lambda x: F.when(F.floor(x) == F.ceil(x), low(x).cast("double")).otherwise((F.ceil(x) - x) * low(x) + (x - F.floor(x)) * high(x)))
    found = values.select(*keys, each.alias("p"))
    every = dense.groupBy(*keys).agg(F.count(value).alias("n"), *more).alias("e")
    joined = every.join(found.alias("f"), [F.col(f"e.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys] or F.lit(True), "left")
    names = [c for c in every.columns if c not in (*keys, "n")]
    return joined.select(*(F.col(f"e.{k}").alias(k) for k in keys), F.col("e.n").alias("n"), F.col("f.p").alias("p"), *(F.col(f"e.{c}").alias(c) for c in names))


def _equal(rows: DataFrame, cells: DataFrame, keys: list[str]):
    return [rows[k].eqNullSafe(cells[k]) for k in keys] or F.lit(True)
