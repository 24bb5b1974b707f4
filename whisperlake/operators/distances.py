"""Distances over a whole graph: how many pairs lie within so many hops, exactly and by sketches (HyperBall), and the exact diameter.

The exact number is quadratic by nature: a search from every vertex. Sources are dealt to tasks, over a graph of at most
``HELD`` edges that all tasks share (``held``): long components of narrow layers are counted layer by layer, in time in
proportion to their length, the others by searches from 512 vertices at a time, a bit for each; larger graphs are searched by joins, a
bounded batch of sources at a time. HyperBall keeps a sketch of the vertices within t hops of each vertex; the ball of t + 1 hops is the union of the
neighbours' balls, which is one join along the edges and one merge of sketches. The diameter is searched by sweeps, each
the distances from one vertex: they bound every vertex's eccentricity from both sides, and end the search as soon as no
vertex can lie further from any other than two that were found.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from whisperlake.operators.components import labels
from whisperlake.operators.held import WORDS, graph_of
from whisperlake.plans.scratch import ship_package, written

#: So many edges of 8 bytes a graph may have to be shared with all tasks (128 MB)
HELD = 1 << 24
#: From so many vertices at most a task counts pairs at once
SOURCES = 1 << 14
#: So many pairs of a source and a vertex are kept at once where a graph is searched by joins
PAIRS = 100_000_000
#: So many sweeps of the search for the diameter go side by side
SIDE = 8


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst) in both directions, once each, without loops and missing ends."""
    e = edges.where("src is not null and dst is not null and src != dst").select("src", "dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def neighbourhood(edges: DataFrame, lg: int = 12, most: int = 256) -> DataFrame:
    """(hops, pairs): about how many ordered pairs of vertices, each with itself too, lie within so many hops; up to where the number stops growing.

    Sketches have 2**``lg`` registers (a relative error of some 1 / 2**(lg/2)), and are exact while balls are small.
    ``most`` rounds at most: a graph of a larger diameter is an error. A graph without edges has no rows.
    """
    spark, links = edges.sparkSession, written(both_ways(edges), "links")
    balls = written(links.groupBy(F.col("src").alias("pubkey")).agg(F.hll_sketch_agg("src", lg).alias("ball")), "balls")
    size = lambda b: b.agg(F.sum(F.hll_sketch_estimate("ball"))).first()[0] or 0
    sizes = [size(balls)]
    while sizes[-1]:
        if len(sizes) > most:
            raise RuntimeError(f"the number of pairs still grows after {most} hops")
        pulled = links.join(balls, links.src == balls.pubkey).select(F.col("dst").alias("pubkey"), "ball")
        balls = written(balls.unionByName(pulled).groupBy("pubkey").agg(F.hll_union_agg("ball").alias("ball")), "balls")
        sizes.append(size(balls))
        if sizes[-1] <= sizes[-2]:
            sizes.pop()
            break
    return spark.createDataFrame([(k, int(n)) for k, n in enumerate(sizes) if n], "hops long, pairs long")


def _held(links: DataFrame) -> tuple[int, Broadcast]:
    """How many vertices there are, and the edges by their numbers (in order of names), shared with all tasks; for ``links`` as of ``both_ways`` with at most ``HELD`` edges."""
    spark = links.sparkSession
    ship_package(spark)
    names = links.select(F.col("src").alias("pubkey")).distinct().withColumn("id", (F.row_number().over(Window.orderBy("pubkey")) - 1).cast("int"))
    names = written(names, "names")
    ids = lambda c: names.select(F.col("pubkey").alias(c), F.col("id").alias(f"{c}_id"))
    rows = links.where("src < dst").join(ids("src"), "src").join(ids("dst"), "dst").select("src_id", "dst_id").toArrow()
    return names.count(), spark.sparkContext.broadcast((rows["src_id"].to_numpy(), rows["dst_id"].to_numpy()))


def exact_neighbourhood(edges: DataFrame) -> DataFrame:
    """(hops, pairs): how many ordered pairs of vertices, each with itself too, lie within so many hops; up to where the number stops growing.

    A graph without edges has no rows.
    """
    spark, links = edges.sparkSession, written(both_ways(edges), "links")
    total = links.count() // 2
    if total == 0:
        return spark.createDataFrame([], "hops long, pairs long")
    if total > HELD:
        counts = _pairs_by_joins(links)
    else:
        size, shared = _held(links)
        tasks = 4 * spark.sparkContext.defaultParallelism
        units = min(-(-size // (64 * WORDS)), max(tasks, -(-size // SOURCES)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for unit in batch["id"].to_pylist():
                    counts = graph_of(shared).counts(size * unit // units, size * (unit + 1) // units)
                    hops = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_pydict({"hops": hops, "pairs": counts[hops]})

        dealt = spark.range(0, units, 1, min(units, tasks))
        counts = dealt.mapInArrow(run, "hops long, pairs long").groupBy("hops").agg(F.sum("pairs").alias("pairs"))
    return counts.select("hops", F.sum("pairs").over(Window.orderBy("hops")).alias("pairs"))  # a row for each hop


def _pairs_by_joins(links: DataFrame) -> DataFrame:
    """(hops, pairs) at just so many hops; the sources in batches of some ``PAIRS`` pairs, a written table for each hop of a batch."""
    vertices = written(links.select(F.col("src").alias("pubkey")).distinct(), "vertices")
    size = vertices.count()
    batches = -(-size * size // PAIRS)
    counts: dict[int, int] = {}
    for batch in range(batches):
        own = vertices.where(F.pmod(F.xxhash64("pubkey"), F.lit(batches)) == batch)
        for k, front in enumerate(_fronts(links, own)):
            counts[k] = counts.get(k, 0) + front.count()
    return links.sparkSession.createDataFrame(sorted(counts.items()), "hops long, pairs long")


def distance_summary(near: DataFrame, share: float = 0.9) -> DataFrame:
    """One row from (hops, pairs): pairs that reach each other, their mean distance, and the hops within which ``share`` of them lie, interpolated."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("hops", "pairs"))), lambda x: x["pairs"].cast("double"))  # a row for each hop
    one = near.agg(rows.alias("n")).where("size(n) > 0").withColumn("own", F.col("n")[0]).withColumn("all", F.element_at("n", -1) - F.col("own"))
    steps = F.transform(F.sequence(F.lit(1), F.size("n") - 1), lambda k: k * (F.get("n", k) - F.get("n", k - 1)))
    total = F.aggregate(F.when(F.size("n") > 1, steps).otherwise(F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + x)
    aim = F.lit(share) * F.element_at("n", -1)
    k = F.array_position(F.transform("n", lambda x: x >= aim), True).cast("int") - 1
    below = F.get("n", k - 1)
    effective = F.when(k <= 0, F.lit(0.0)).otherwise(k - 1 + (aim - below) / (F.get("n", k) - below))
    return one.select(F.col("all").cast("long").alias("pairs"), F.try_divide(total, F.col("all")).alias("mean_hops"), effective.alias("effective_diameter"))


def _fronts(edges: DataFrame, sources: DataFrame) -> Iterator[DataFrame]:
    """For 0, 1, 2, ... hops the written (source, pubkey) just so many hops apart; ``edges`` as of ``both_ways``."""
    front, before = written(sources.select(F.col("pubkey").alias("source"), "pubkey"), "hops"), None
    while not front.isEmpty():
        yield front
        step = front.join(edges, front.pubkey == edges.src).select("source", F.col("dst").alias("pubkey")).distinct()
        # a neighbour is one hop nearer, as near, or new: only the last two tables can hold it
        known = front if before is None else front.unionByName(before)
        front, before = written(step.join(known, ["source", "pubkey"], "left_anti"), "hops"), front


def hops_from(edges: DataFrame, source: str, most: int = 100_000) -> DataFrame:
    """(pubkey, hops) of all that ``source`` reaches; ``edges`` as of ``both_ways``; a written table for each hop, which is joined along the edges."""
    seen = []
    for k, front in enumerate(_fronts(edges, edges.where(F.col("src") == source).select(F.col("src").alias("pubkey")).distinct())):
        if k > most:
            raise RuntimeError(f"vertices lie beyond {most} hops")
        seen.append(front.select("pubkey", F.lit(k).alias("hops")))
    return reduce(DataFrame.unionByName, seen)


def _swept(found: DataFrame) -> DataFrame:
    """(pubkey, low, high): bounds of eccentricities from (source, e, pubkey, hops), e being the source's own."""
    h, e = F.col("hops"), F.col("e")
    return found.groupBy("pubkey").agg(F.max(F.greatest(h, e - h)).alias("near"), F.min(e + h).alias("far"))


def _bounds_held(size: int, shared: Broadcast, spark: SparkSession) -> DataFrame:
    """(pubkey, degree, low, high) of the places of the largest component, with the bounds of a sweep from the end that its layers are counted from."""
    tasks = spark.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch["id"].to_pylist():
                graph = graph_of(shared)
                first, last = graph.main()
                a, n = graph.edge[first], graph.edge[last] - graph.edge[first]
                place = np.arange(a + n * part // tasks, a + n * (part + 1) // tasks)
                hops, e = np.searchsorted(graph.edge[first : last + 1], place, "right") - 1, last - first - 1
                rows = {"pubkey": place, "degree": np.diff(graph.start)[place], "low": np.maximum(hops, e - hops), "high": e + hops}
                yield pa.RecordBatch.from_pydict({k: v.astype(np.int32) for k, v in rows.items()})

    return spark.range(0, tasks, 1, tasks).mapInArrow(run, "pubkey int, degree int, low int, high int")


def _sweeps_held(shared: Broadcast, spark: SparkSession, sources: list[int]) -> DataFrame:
    """(source, e, pubkey, hops) of the places that each source reaches, a task for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch["id"].to_pylist():
                layers = list(graph_of(shared).layers(np.array([sources[k]])))
                for start in range(0, len(layers), 1024):
                    some = layers[start : start + 1024]
                    hops = np.repeat(np.arange(start, start + len(some), dtype=np.int32), [len(x) for x in some])
                    yield pa.RecordBatch.from_pydict({"source": np.full(len(hops), sources[k], np.int32), "e": np.full(len(hops), len(layers) - 1, np.int32), "pubkey": np.concatenate(some).astype(np.int32), "hops": hops})

    return spark.range(0, len(sources), 1, len(sources)).mapInArrow(run, "source int, e int, pubkey int, hops int")


def _furthest_held(shared: Broadcast, spark: SparkSession, sources: list[int]) -> int:
    """The most hops that any of these places has to another, by searches from 64 * ``WORDS`` at once."""
    groups = -(-len(sources) // (64 * WORDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch["id"].to_pylist():
                yield pa.RecordBatch.from_pydict({"hops": [len(graph_of(shared).pairs(np.array(sources[k::groups]))) - 1]})

    return spark.range(0, groups, 1, groups).mapInArrow(run, "hops long").agg(F.max("hops")).first()[0]


def diameter(edges: DataFrame, most_sweeps: int = 1000) -> DataFrame:
    """One row on the largest component (ties: the least name): its vertices, exact diameter, and the sweeps that it took.

    After a sweep from v of eccentricity e, a vertex d hops away has one from max(d, e - d) to e + d. The next sweeps go
    from the vertices that may be the most eccentric and from those that may be the least (ties: more edges, then the
    least name), side by side if tasks can hold the graph, else in turn. In a graph that tasks hold, the last
    64 * ``WORDS`` * ``SIDE`` vertices that may still lie further from one are searched from side by side, so many at once
    as one sweep. A graph without edges has no row.
    """
    spark, links = edges.sparkSession, written(both_ways(edges), "links")
    shape = "vertices long, diameter long, sweeps long"
    total = links.count() // 2
    if total == 0:
        return spark.createDataFrame([], shape)
    if total <= HELD:
        size, shared = _held(links)
        bounds, sweeps = written(_bounds_held(size, shared, spark), "bounds"), 1
    else:
        shared, links = None, _largest(links)
        bounds = links.groupBy(F.col("src").alias("pubkey")).agg(F.count(F.lit(1)).alias("degree")).select("pubkey", "degree", F.lit(0).alias("low"), F.lit(1 << 30).alias("high"))
        bounds, sweeps = written(bounds, "bounds"), 0
    known, turn = bounds.agg(F.count(F.lit(1)).alias("n"), F.max("low").alias("best")).first(), 0
    vertices, best = known["n"], known["best"]
    while sweeps < most_sweeps:
        able = bounds.where(F.col("high") > best)
        left = able.count()
        if left == 0:
            return spark.createDataFrame([(vertices, best, sweeps)], shape)
        if shared and left <= 64 * WORDS * SIDE:
            last = sorted(r["pubkey"] for r in able.select("pubkey").collect())
            return spark.createDataFrame([(vertices, max(best, _furthest_held(shared, spark, last)), sweeps + -(-left // (64 * WORDS)))], shape)
        k = SIDE // 2 if shared else 1
        wide, narrow = (able.orderBy(by, F.desc("degree"), "pubkey").limit(k).select("pubkey") for by in (F.desc("high"), F.asc("low")))
        chosen = wide.unionByName(narrow) if k > 1 else narrow if turn % 2 else wide
        starts = sorted({r["pubkey"] for r in chosen.collect()})
        if shared:
            swept = _sweeps_held(shared, spark, starts)
        else:
            far = written(hops_from(links, starts[0]), "sweep")
            swept = far.select(F.lit(starts[0]).alias("source"), F.lit(far.agg(F.max("hops")).first()[0]).alias("e"), "pubkey", "hops")
        tight = bounds.join(_swept(swept), "pubkey").select("pubkey", "degree", F.greatest("low", "near").alias("low"), F.least("high", "far").alias("high"))
        bounds = written(tight, "bounds")
        best = max(best, bounds.agg(F.max("low")).first()[0])
        sweeps, turn = sweeps + len(starts), turn + 1
    raise RuntimeError(f"the diameter is not settled after {most_sweeps} sweeps")


def _largest(links: DataFrame) -> DataFrame:
    """The edges of the largest component (ties: the least name), of ``links`` as of ``both_ways``."""
    named = written(labels(links), "classes")
    main = named.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).orderBy(F.desc("n"), "least").first()
    own = named.where(F.col("label") == main["label"]).select(F.col("node").alias("src"))
    return written(links.join(own, "src", "left_semi"), "links")
