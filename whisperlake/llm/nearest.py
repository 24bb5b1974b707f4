"""Approximate nearest neighbours by largest inner product, in vantage-point trees, one for each shard.

Vectors are lengthened by one coordinate so that all have the length of the longest, and queries by a zero: the nearest
vector to a lengthened query is then that with the largest product, and the triangle inequality holds. A small tree over
a bounded sample deals all vectors into regions; a region of more than a shard's vectors is several shards. Each shard
is a vantage-point tree with leaves of some vectors. A query first asks one shard of its own region; the product of the
last neighbour found there is its threshold everywhere else, so that regions, branches and leaves whose distance bound,
times ``factor``, lies beyond the threshold's distance are left out. With factor one nothing nearer can be among them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from whisperlake.llm.common import join_counted, small_batches
from whisperlake.plans.scratch import written

SLACK = 1e-9  # relative rounding of distances
SHARD, QUERIES, LEAF, FIT = 8192, 4096, 128, 4096


class Tree:
    """A vantage-point tree over the rows of ``x``, all of length ``most`` once lengthened; ``order`` are the rows as leaves hold them.

    A node has a vantage row, and its two children the range of their rows' distances to it; equal rows need no bound.
    """

    def __init__(self, x: np.ndarray, most: float, leaf: int):
        self.most = most
        self.vantage, self.low, self.high, self.child = [-1], [[0.0, 0.0]], [[0.0, 0.0]], [-1]
        self.begin, self.end = [0], [len(x)]
        self.order = np.arange(len(x))
        last = np.sqrt(np.maximum(0, most * most - (x * x).sum(axis=1)))
        todo = [0]
        while todo:
            node = todo.pop()
            a, b = self.begin[node], self.end[node]
            if b - a <= leaf:
                continue
            own = self.order[a:b]
            far = lambda v: np.sqrt(np.maximum(0, 2 * most * most - 2 * (x[own] @ x[v] + last[own] * last[v])))
            v = own[int(far(own[0]).argmax())]  # a row at the edge splits best
            d = far(v)
            by, half = np.argsort(d, kind="stable"), (b - a) // 2
            if d[by[-1]] == d[by[0]]:
                continue
            self.order[a:b] = own[by]
            d = d[by]
            self.vantage[node], self.child[node] = int(v), len(self.child)
            self.low[node], self.high[node] = [float(d[0]), float(d[half])], [float(d[half - 1]), float(d[-1])]
            for side in (slice(a, a + half), slice(a + half, b)):
                todo.append(len(self.child))
                for own_list, value in ((self.vantage, -1), (self.low, [0.0, 0.0]), (self.high, [0.0, 0.0]), (self.child, -1), (self.begin, side.start), (self.end, side.stop)):
                    own_list.append(value)

    def route(self, x: np.ndarray, points: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The leaf of each point: on the nearer side of the middle between the two children's ranges."""
        tail = np.sqrt(np.maximum(0, self.most * self.most - (x * x).sum(axis=1)))
        node = np.zeros(len(points), np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            n, own = todo.pop()
            if self.child[n] < 0:
                node[own] = n
                continue
            d = self._far(x, tail, n, points[own], last[own])
            inside = d < self.cut(n)
            todo += [(self.child[n], own[inside]), (self.child[n] + 1, own[~inside])]
        return node

    def cut(self, n: int) -> float:
        return (self.high[n][0] + self.low[n][1]) / 2

    def _far(self, x: np.ndarray, tail: np.ndarray, n: int, points: np.ndarray, last: np.ndarray) -> np.ndarray:
        v, norms = self.vantage[n], (points * points).sum(axis=1) + last * last
        return np.sqrt(np.maximum(0, norms + self.most * self.most - 2 * (points @ x[v] + last * tail[v])))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, each added up from the first component to the last."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def reach(norms: np.ndarray, most: float, least: np.ndarray) -> np.ndarray:
    """Distance of a lengthened query to vectors of length ``most`` whose product is ``least``."""
    with np.errstate(invalid="ignore", over="ignore"):
        return np.sqrt(np.maximum(0, norms + most * most - 2 * least)) * (1 + SLACK) + SLACK * most


def search(tree: Tree, x: np.ndarray, ids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int, factor: float, scale: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, row, product) of the k rows with the largest products of ``least`` or more, ties to smaller ids; how many products were taken.

    ``tree`` stands on ``x / scale``; products are those of the rows as given.
    """
    small, asks = x / scale, q / scale
    norms, rest, none = (asks * asks).sum(axis=1), np.sqrt(np.maximum(0, tree.most * tree.most - (small * small).sum(axis=1))), np.zeros(len(q))
    slack = 1e-12 * tree.most * np.sqrt(norms) * scale * scale
    least, taken = least.copy(), 0
    found = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
    todo = [(0, np.arange(len(q)), np.zeros(len(q)))]
    while todo:
        n, own, bound = todo.pop()
        near = bound * factor <= reach(norms[own], tree.most, least[own] / scale / scale)
        own, bound = own[near], bound[near]
        if not len(own):
            continue
        if tree.child[n] >= 0:
            d = tree._far(small, rest, n, asks[own], none[own])
            sides = [np.maximum(bound, np.maximum(d - tree.high[n][s], tree.low[n][s] - d)) for s in (0, 1)]
            inside = d < tree.cut(n)
            c = tree.child[n]  # the nearer side of each query is looked at first, so it goes last
            todo += [(c, own[~inside], sides[0][~inside]), (c + 1, own[inside], sides[1][inside]), (c, own[inside], sides[0][inside]), (c + 1, own[~inside], sides[1][~inside])]
            continue
        rows = tree.order[tree.begin[n] : tree.end[n]]
        for at in range(0, len(rows), 4 * LEAF):  # a leaf of equal distances may be long
            part = rows[at : at + 4 * LEAF]
            taken += len(own) * len(part)
            a, b = np.nonzero(q[own] @ x[part].T >= (least[own] - slack[own])[:, None])
            a, b = own[a], part[b]
            exact = products(q[a], x[b])
            good = exact >= least[a]
            a, b, exact = a[good], b[good], exact[good]
            if not len(a):
                continue
            touched = np.zeros(len(q), bool)
            touched[a] = True
            old = touched[found[0]]
            qs, rs, ps = (np.concatenate([f[old], v]) for f, v in zip(found, (a, b, exact)))
            order = np.lexsort((ids[rs], -ps, qs))
            qs, rs, ps = qs[order], rs[order], ps[order]
            first = np.flatnonzero(np.diff(qs, prepend=-1))
            place = np.arange(len(qs)) - np.repeat(first, np.diff([*first, len(qs)]))
            full = place == k - 1
            least[qs[full]] = np.maximum(least[qs[full]], ps[full])
            keep = place < k
            found = [np.concatenate([f[~old], v[keep]]) for f, v in zip(found, (qs, rs, ps))]
    return *found, taken


def _fine(c: Column) -> Column:
    """No null, not empty, not zero, and all components finite."""
    real = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return c.isNotNull() & (F.size(c) > 0) & real & F.exists(c, lambda v: v != 0)


def nearest(vectors: DataFrame, chosen: Column, k: int = 20, factor: float = 1.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` (vec_id, embedding) that ``chosen`` holds for, its k nearest others.

    ``factor`` over one leaves out more, at some loss. Equal vectors are searched once, under their k + 1 smallest ids,
    which are all that can be among any k nearest. Vectors that are null, empty, zero or hold null or non-finite
    components take no part; vectors of different lengths never meet; equal products go by vec_id, null last; a row is
    left out of its own neighbours once, so that rows which repeat a vec_id are neighbours; an empty table gives no rows;
    other columns are not read.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    key = ["h1", "h2"]
    kind = vectors.schema["vec_id"].dataType.simpleString()
    plain = F.transform(F.col("embedding").cast("array<double>"), lambda v: v + F.lit(0.0))  # -0 is 0
    rows = vectors.where(_fine(F.col("embedding"))).select("vec_id", chosen.alias("asks"), plain.alias("v"))
    rows = written(rows.select("*", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")), "vectors")
    by = Window.partitionBy(*key).orderBy(F.asc_nulls_last("vec_id"))
    few = rows.withColumn("n", F.row_number().over(by)).where(F.col("n") <= k + 1)  # limited before the shuffle too
    every = F.transform(F.array_sort(F.collect_list(F.struct("n", "vec_id"))), lambda s: s["vec_id"])
    groups = few.groupBy(*key).agg(F.first("v").alias("v"), every.alias("ids"))
    asks = rows.where(F.coalesce("asks", F.lit(False))).groupBy(*key).agg(F.count(F.lit(1)).alias("askers"))
    groups = written(groups.join(asks, key, "left").withColumn("dim", F.size("v")), "groups")
    # a row for each length of vectors
    sizes = groups.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count("askers").alias("asking"), F.max(F.array_max(F.transform("v", F.abs))).alias("scale")).collect()
    found = None
    for s in sizes:
        some = _found(groups.where(F.col("dim") == s["dim"]), s["dim"], s["n"], s["asking"], s["scale"], k, factor, kind)
        found = some if found is None else found.unionByName(some)
    if found is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    by = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), F.asc_nulls_last(F.col("ids")[0]))
    best = found.withColumn("n", F.row_number().over(by)).where(F.col("n") <= k + 1)
    one = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("less"), i.isNull().alias("unknown"), i.alias("vec_id"), ((F.col("q1") == F.col("h1")) & (F.col("q2") == F.col("h2"))).alias("own")))
    lists = best.select("q1", "q2", one.alias("one")).groupBy("q1", "q2").agg(F.slice(F.array_sort(F.flatten(F.collect_list("one"))), 1, k + 1).alias("near"))
    lists = written(lists.withColumnsRenamed({"q1": "h1", "q2": "h2"}).join(groups.select(*key, "askers"), key), "lists")
    queries = rows.where(F.coalesce("asks", F.lit(False))).select("vec_id", *key)
    both = join_counted(queries, lists, key, "askers", queries.count())
    own = F.expr("array_position(transform(near, s -> s.own and s.vec_id <=> vec_id), true)").cast("int")
    others = F.when(own > 0, F.concat(F.slice("near", F.lit(1), F.greatest(own - 1, F.lit(0))), F.slice("near", F.greatest(own + 1, F.lit(1)), F.lit(k + 1)))).otherwise(F.col("near"))
    each = both.select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("at", "s"))
    return each.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("s")["vec_id"].alias("vec_id"), (-F.col("s")["less"]).alias("score"))


def _found(groups: DataFrame, dim: int, n: int, asking: int, scale: float, k: int, factor: float, kind: str) -> DataFrame:
    """(q1, q2, h1, h2, ids, score): each asking vector's k + 1 best of every shard that it looks at, for vectors of one length."""
    matrix = lambda col: col.values.to_numpy(zero_copy_only=False)[col.offsets[0].as_py() : col.offsets[-1].as_py()].reshape(-1, dim)
    most = float(np.sqrt(groups.select(F.aggregate("v", F.lit(0.0), lambda a, v: a + (v / F.lit(scale)) * (v / F.lit(scale))).alias("s")).agg(F.max("s")).first()[0])) * (1 + SLACK)
    sample = groups.select("v", "h1", "h2").orderBy("h1", "h2").limit(FIT).collect()
    fit = np.array([r["v"] for r in sample]) / scale
    top = Tree(fit, most, max(8, -(-len(fit) // max(1, -(-n // SHARD)))))

    def lengthened(x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, most * most - (x * x).sum(axis=1)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("v")) / scale
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(top.route(fit, x, lengthened(x)).astype(np.int32))], [*b.schema.names, "leaf"])

    shape = f"h1 long, h2 long, v array<double>, ids array<{kind}>, askers long"
    placed = written(groups.select("h1", "h2", "v", "ids", "askers").mapInArrow(place, shape + ", leaf int"), "placed")
    # a row for each leaf of the bounded tree
    pieces = {r["leaf"]: -(-r["n"] // SHARD) for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    pieces_of = F.create_map(*(F.lit(v) for pair in pieces.items() for v in pair))
    placed = placed.withColumn("piece", F.pmod("h1", F.element_at(pieces_of, F.col("leaf"))).cast("int"))

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("h1", "ascending"), ("h2", "ascending")]).combine_chunks()
        x = matrix(t.column("v").chunk(0)) if t.column("v").num_chunks else np.empty((0, dim))
        one = lambda v, kind: pa.array([v], kind)
        hashes = np.stack([t.column(c).to_numpy() for c in ("h1", "h2")])
        return pa.table([t.column("leaf")[:1], t.column("piece")[:1], one(hashes.tobytes(), pa.binary()), one(x.tobytes(), pa.binary()), one(t.column("ids").to_pylist(), pa.list_(t.schema.field("ids").type))], ["leaf", "piece", "hashes", "rows", "ids"])

    shards = placed.select("leaf", "piece", "h1", "h2", "v", "ids").groupBy("leaf", "piece").applyInArrow(pack, f"leaf int, piece int, hashes binary, rows binary, ids array<array<{kind}>>")
    shards = written(shards, "shards")

    def asked(queries: DataFrame, places) -> DataFrame:
        """Rows of a shard and a block of queries: (leaf, piece, block, q1, q2, v, least)."""
        blocks = max(1, -(-asking // QUERIES))
        sent = queries.mapInArrow(places, "q1 long, q2 long, v array<double>, least double, leaf int, only int").withColumn("block", F.pmod("q2", F.lit(blocks)).cast("int"))

        def pack_queries(t: pa.Table) -> pa.Table:
            t = t.combine_chunks()
            one = lambda v: pa.array([v.tobytes()], pa.binary())
            return pa.table([*(t.column(c)[:1] for c in ("leaf", "only", "block")), one(np.stack([t.column(c).to_numpy() for c in ("q1", "q2")])), one(matrix(t.column("v").chunk(0))), one(t.column("least").to_numpy())], ["leaf", "only", "block", "queries", "vectors", "least"])

        packed = sent.groupBy("leaf", "only", "block").applyInArrow(pack_queries, "leaf int, only int, block int, queries binary, vectors binary, least binary")
        every = F.sequence(F.lit(0), F.element_at(pieces_of, F.col("leaf")) - 1)
        return packed.withColumn("piece", F.explode(F.when(F.col("only") >= 0, F.array("only")).otherwise(every))).join(shards, ["leaf", "piece"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                x = np.frombuffer(r["rows"]).reshape(-1, dim)
                q = np.frombuffer(r["vectors"]).reshape(-1, dim)
                hashes, names = np.frombuffer(r["hashes"], np.int64).reshape(2, -1), np.frombuffer(r["queries"], np.int64).reshape(2, -1)
                first = np.array([np.iinfo(np.int64).max if i[0] is None else i[0] for i in r["ids"]])
                tree = Tree(x / scale, most, LEAF)
                a, c, p, _ = search(tree, x, first, q, np.frombuffer(r["least"]), k + 1, factor, scale)
                ids = pa.array([r["ids"][v] for v in c], b.schema.field("ids").type.value_type)
                yield pa.RecordBatch.from_arrays([*(pa.array(v) for v in (names[0][a], names[1][a], hashes[0][c], hashes[1][c])), ids, pa.array(p)], ["q1", "q2", "h1", "h2", "ids", "score"])

    out = f"q1 long, q2 long, h1 long, h2 long, ids array<{kind}>, score double"

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("v")) / scale
                leaf = top.route(fit, x, np.zeros(len(x)))
                only = [h % pieces[f] if f in pieces else -1 for f, h in zip(leaf.tolist(), b.column("h1").to_pylist())]
                some = pa.array([o >= 0 for o in only])
                made = pa.RecordBatch.from_arrays([b.column("h1"), b.column("h2"), b.column("v"), pa.array(np.full(len(x), -np.inf)), pa.array(leaf.astype(np.int32)), pa.array(only, pa.int32())], ["q1", "q2", "v", "least", "leaf", "only"])
                yield made.filter(some)

    queries = placed.where("askers > 0").select("h1", "h2", "v")
    by = Window.partitionBy("q1", "q2").orderBy(F.desc("score"))
    last = asked(queries, home).mapInArrow(run, out).withColumn("n", F.row_number().over(by)).where(F.col("n") == k + 1)
    least = written(last.select(F.col("q1").alias("h1"), F.col("q2").alias("h2"), F.col("score").alias("least")), "least")
    known = queries.join(least, ["h1", "h2"], "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))

    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = lengthened(fit)
        for b in batches:
            if not b.num_rows:
                continue
            x, low = matrix(b.column("v")) / scale, b.column("least").to_numpy() / scale / scale
            far = reach((x * x).sum(axis=1), most, low)
            leaves, whose, todo = [], [], [(0, np.arange(len(x)), np.zeros(len(x)))]
            while todo:
                node, own, bound = todo.pop()
                near = bound * factor <= far[own]
                own, bound = own[near], bound[near]
                if not len(own):
                    continue
                if top.child[node] < 0:
                    if node in pieces:
                        leaves.append(np.full(len(own), node))
                        whose.append(own)
                    continue
                gap = top._far(fit, tail, node, x[own], np.zeros(len(own))) - top.cut(node)  # rows were dealt at the cut
                todo += [(top.child[node], own, np.maximum(bound, gap)), (top.child[node] + 1, own, np.maximum(bound, -gap))]
            if whose:
                take = pa.array(np.concatenate(whose))
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in ("h1", "h2", "v", "least")), pa.array(np.concatenate(leaves).astype(np.int32)), pa.array(np.full(len(take), -1, np.int32))], ["q1", "q2", "v", "least", "leaf", "only"])

    return asked(known, regions).mapInArrow(run, out)

