"""Connected components: by alternating large-star and small-star steps (Kiveris et al., 2014), and by contraction in random orders
(Bögeholz et al., 2020), of which each round has a fraction of the vertices of the one before, so that long graphs cost little more than wide ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whisperlake.plans.scratch import written


def components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that occurs in an edge; component is the smallest node reachable.

    Every round is grouping by minimum, then an equi join that Spark can split where a node has very many
    neighbours. Nothing is gathered on the driver but a row count and a checksum. Null ends and self-loops are
    dropped (a node that has only self-loops therefore gets no row); repeated edges count once; an empty input gives
    no rows.
    """
    e = (
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    e = written(e, "edges")
    before = _mark(e)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.withColumnRenamed("m", "v"))
            .distinct()
        )
        e = written(small, "edges")
        after = _mark(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(roots)


def _mark(e: DataFrame) -> tuple[int, int]:
    row = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"] or 0


def labels(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, label) for every node that occurs in an edge to another; nodes have one label if they reach each other, a node of theirs.

    Each round, every node goes over to the first of itself and its neighbours in the round's own random order, and from
    there to that node's first. What it leaves are edges between fewer nodes; the rounds' steps are put together at the end.
    """
    u, v = F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v")
    e = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).select(u, v).distinct()
    e, steps = written(e, "edges"), []
    while not e.isEmpty():
        if len(steps) == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        placed = lambda c: F.struct(F.xxhash64(c, F.lit(len(steps))).alias("h"), F.col(c).alias("node"))
        both = e.select("u", placed("v").alias("v")).unionByName(e.select(F.col("v").alias("u"), placed("u").alias("v")))
        first = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("v", placed("u"))["node"].alias("p"))
        onward = first.select(F.col("u").alias("p"), F.col("p").alias("q"))
        step = written(first.join(onward, "p").select("u", F.col("q").alias("p")), "steps")
        ends = e.join(step.withColumnRenamed("p", "a"), "u").join(step.select(F.col("u").alias("v"), F.col("p").alias("b")), "v")
        e = written(ends.where("a != b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
        steps.append(step)
    if not steps:
        return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    found = steps.pop()
    while steps:
        later = found.select(F.col("u").alias("p"), F.col("p").alias("q"))
        found = written(steps.pop().join(later, "p", "left").select("u", F.coalesce("q", "p").alias("p")), "labels")
    return found.select(F.col("u").alias("node"), F.col("p").alias("label"))
