"""Embedding near-duplicates by PCA-ordered tiled comparison with suffix-norm bounds.

Vectors are scaled to length 1 and turned onto principal axes, largest variance first; a turn keeps every product. A tree
of cuts along the leading axes deals them into tiles. Two tiles are compared only if the boxes around their leading
coordinates come as close as two vectors of the threshold's cosine may be. A comparison adds up the products of the
leading dimensions first. The rest of a product is at most the product of the two suffix norms, so a pair stops as soon
as its sum and that bound stay below the threshold. What is left is decided by the cosine of the vectors as they were
given, in double precision and always in one order of summation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whisperlake.llm.common import join_counted, small_batches
from whisperlake.operators.components import components
from whisperlake.plans.scratch import written

SLACK = 1e-5  # rounding of the single-precision bounds
BOX = 8  # leading axes that tiles are cut by and that bound their distance


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    most = np.abs(rows).max(axis=1, keepdims=True)
    rows = rows / most
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def local_roots(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """Smallest position reachable, for positions 0..n-1 and the links given."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[src], root[dst])
        np.minimum.at(root, root[src], low)
        np.minimum.at(root, root[dst], low)
        root = root[root]
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            return root


def pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray, least: float, steps: tuple[int, ...], rows: int = 256, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in a and b, unit vectors, of the pairs with product >= least; ``most`` pairs at a time are decided."""
    x, y = (a @ axes).astype(np.float32), (b @ axes).astype(np.float32)
    rest = lambda v, k: np.sqrt(np.maximum(0, (v[:, k:] ** 2).sum(axis=1)))
    tails_a, tails_b = [rest(x, k) for k in steps], [rest(y, k) for k in steps]
    first = steps[0]
    for at in range(0, len(a), rows):
        to = min(at + rows, len(a))
        sums = x[at:to, :first] @ y[:, :first].T
        every_i, every_j = np.nonzero(sums + np.outer(tails_a[0][at:to], tails_b[0]) >= least - SLACK)
        for k in range(0, len(every_i), most):
            i, j = every_i[k : k + most], every_j[k : k + most]
            part, done = sums[i, j], first
            for n, ta, tb in zip(steps[1:], tails_a[1:], tails_b[1:]):
                part = part + np.einsum("ij,ij->i", x[at + i, done:n], y[j, done:n])
                alive = part + ta[at + i] * tb[j] >= least - SLACK
                i, j, part, done = i[alive], j[alive], part[alive], n
            good = np.einsum("ij,ij->i", a[at + i], b[j]) >= least
            yield at + i[good], j[good]


class Cuts:
    """A tree of cuts along the leading axes, each in the middle of the longest side of what it cuts; leaves are numbered."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.axis, self.value, self.below = [-1], [0.0], [0]
        parts = [(0, points)]
        while len(parts) < leaves:
            k = max(range(len(parts)), key=lambda k: len(parts[k][1]))
            node, own = parts[k]
            if len(own) < 2 or not (np.ptp(own, axis=0) > 0).any():
                break
            axis = int(np.ptp(np.quantile(own, (0.05, 0.95), axis=0), axis=0).argmax())
            if np.ptp(own[:, axis]) == 0:
                axis = int(np.ptp(own, axis=0).argmax())
            value = float(np.median(own[:, axis]))
            high = own[:, axis] >= value
            if high.all():
                value = float(own[own[:, axis] > value, axis].min())
                high = own[:, axis] >= value
            self.axis[node], self.value[node], self.below[node] = axis, value, len(self.axis)
            for side in (~high, high):
                self.axis.append(-1)
                self.value.append(0.0)
                self.below.append(0)
                part = (len(self.axis) - 1, own[side])
                if side is high:
                    parts.append(part)
                else:
                    parts[k] = part

    def __call__(self, points: np.ndarray) -> np.ndarray:
        axis, value, below = np.array(self.axis), np.array(self.value), np.array(self.below)
        node = np.zeros(len(points), np.int64)
        while (moving := axis[node] >= 0).any():
            at = np.flatnonzero(moving)
            own = node[at]
            node[at] = below[own] + (points[at, axis[own]] >= value[own])
        return node


def near_duplicates(vectors: DataFrame, least: float = 0.95, tile: int = 8192, fit_rows: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding).

    Null or zero vectors and those with null or non-finite components have no links. Equal vectors, told by a hash of 128
    bits, are merged first and counted by their number. The axes are fitted on at most ``fit_rows`` vectors, those of the
    least hashes; every vector is compared, and the axes decide only how soon a comparison stops. Vectors of different
    lengths never link. Repeated rows link with each other; a repeated vec_id gets a row for each, rows with a null one
    link too; an empty table gives no rows; other columns are not read.
    """
    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"
    kind = np.dtype("<f4" if single else "<f8")
    element = "float" if single else "double"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("embedding")
            flat, off = col.values.to_numpy(zero_copy_only=False).astype(kind), col.offsets.to_numpy()
            flat = flat + kind.type(0)  # -0 is 0
            whole = [flat[x:y] if ok and y > x and np.isfinite(flat[x:y]).all() and flat[x:y].any() else None for x, y, ok in zip(off, off[1:], col.is_valid().to_pylist())]
            raw = [None if v is None else v.tobytes() for v in whole]
            hashes = [(None, None) if v is None else divmod(xxhash.xxh3_128_intdigest(v), 1 << 64) for v in raw]
            sign = lambda k: pa.array([None if h[k] is None else h[k] - (1 << 63) for h in hashes], pa.int64())
            dim = pa.array([None if v is None else len(v) for v in whole], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), dim, sign(0), sign(1), pa.array(raw, pa.binary())], ["vec_id", "dim", "h1", "h2", "raw"])

    small_batches(vectors.sparkSession)
    # a null component is not finite, and so is NaN
    fine = F.transform(F.col("embedding").cast(f"array<{element}>"), lambda v: F.coalesce(v, F.lit(float("nan")).cast(element)))
    rows = written(vectors.select("vec_id", fine.alias("embedding")).mapInArrow(digest, "vec_id long, dim int, h1 long, h2 long, raw binary"), "vectors")
    key = ["dim", "h1", "h2"]
    # a null id is told apart from every other by the rows' hashes, as links are between vectors
    groups = written(rows.where("raw is not null").groupBy(*key).agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first("raw").alias("raw")).withColumn("node", F.monotonically_increasing_id()), "groups")
    dims = sorted(r["dim"] for r in groups.select("dim").distinct().collect())  # a row for each length of vectors
    parts = [_linked(groups.where(F.col("dim") == d), d, kind, least, tile, fit_rows) for d in dims]
    none = rows.where("raw is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not parts:
        return none
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = written(found, "links")
    classes = components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    placed = groups.select(*key, "node", "copies", "least_id").join(counts, "node", "left").join(classes, "node", "left").withColumn("class", F.coalesce("component", "node"))
    placed = written(placed.select(*key, "copies", "least_id", "class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    # a class of one vector needs no look at others
    named = placed.join(placed.groupBy("class").agg(F.min("least_id").alias("component_id")), "class").select(*key, "copies", "n_links", "component_id")
    both = join_counted(rows.where("raw is not null").select("vec_id", *key), named, key, "copies", rows.count())
    component = F.coalesce("component_id", "vec_id")
    every = both.select("vec_id", F.col("n_links").cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
    return every.unionByName(none)


def _linked(groups: DataFrame, dim: int, kind: np.dtype, least: float, tile: int, fit_rows: int) -> DataFrame:
    """(node, links, root): for each pair of tiles, how many vectors each node links with, and its local root."""
    sample = groups.select("raw", "h1", "h2").orderBy("h1", "h2").limit(fit_rows).collect()
    fit = unit(np.frombuffer(b"".join(r["raw"] for r in sample), kind).reshape(-1, dim))
    axes = np.linalg.svd(fit - fit.mean(axis=0), full_matrices=True)[2].T if len(fit) > 1 else np.eye(dim)
    steps = tuple(sorted({max(1, dim // 4), max(1, dim // 2), dim}))
    box = min(BOX, dim)
    n = groups.count()
    cuts = Cuts(fit @ axes[:, :box], max(1, min(-(-n // tile), max(1, len(fit) // 4))))
    names = [f"x{k}" for k in range(box)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unit(np.frombuffer(b"".join(b.column("raw").to_pylist()), kind).reshape(-1, dim)) @ axes[:, :box] if b.num_rows else np.empty((0, box))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", "copies", "h1", "raw")), pa.array(cuts(x)), *(pa.array(v) for v in x.T)], ["node", "copies", "h1", "raw", "leaf", *names])

    placed = groups.select("node", "copies", "h1", "raw").mapInArrow(place, "node long, copies long, h1 long, raw binary, leaf long, " + ", ".join(f"{c} double" for c in names))
    placed = written(placed, "placed")
    # a leaf of more than a tile is several tiles, by the vectors' hashes: a row for each leaf of the bounded tree
    sizes = F.broadcast(placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / tile).cast("long").alias("pieces")))
    placed = placed.join(sizes, "leaf").withColumn("tile", F.shiftleft(F.col("leaf"), 32) + F.pmod("h1", "pieces"))

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        x = np.stack([t.column(c).to_numpy() for c in names])
        one = lambda v, k: pa.array([v], k)
        raw = [t.column("node").to_numpy().tobytes(), t.column("copies").to_numpy().tobytes(), b"".join(t.column("raw").to_pylist())]
        return pa.table([t.column("tile")[:1], one(x.min(axis=1), pa.list_(pa.float64())), one(x.max(axis=1), pa.list_(pa.float64())), *(one(r, pa.binary()) for r in raw)], ["tile", "low", "high", "nodes", "copies", "vectors"])

    blocks = placed.select("tile", "node", "copies", "raw", *names).groupBy("tile").applyInArrow(pack, "tile long, low array<double>, high array<double>, nodes binary, copies binary, vectors binary")
    blocks = written(blocks, "tiles")
    # boxes closer than the threshold's distance share a stretch of the first axis, that wide, or have neighbouring ones
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-6
    stretch = lambda c: F.floor(F.element_at(c, 1) / reach)
    edges = blocks.select("tile", "low", "high").withColumn("bin", F.explode(F.sequence(stretch("low"), stretch("high") + 1)))
    other = edges.select(F.col("tile").alias("b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"), "bin")
    gap = F.transform(F.arrays_zip("low", "high", "low_b", "high_b"), lambda v: F.greatest(v["low"] - v["high_b"], v["low_b"] - v["high"], F.lit(0.0)))
    met = edges.join(other, "bin").where(F.col("tile") <= F.col("b")).where(F.aggregate(gap, F.lit(0.0), lambda s, v: s + v * v) <= reach * reach)
    partners = met.select(F.col("tile").alias("a"), "b").distinct()
    sides = partners.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("tile"))
    dealt = sides.join(blocks.drop("low", "high"), "tile")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("tile")
        nodes, copies = (np.concatenate([np.frombuffer(x, np.int64) for x in t.column(c).to_pylist()]) for c in ("nodes", "copies"))
        vectors = [unit(np.frombuffer(x, kind).reshape(-1, dim)) for x in t.column("vectors").to_pylist()]
        own, offset = len(vectors) == 1, 0 if len(vectors) == 1 else len(vectors[0])
        links, src, dst = np.zeros(len(nodes), np.int64), [], []
        for i, j in pairs(vectors[0], vectors[-1], axes, least, steps):
            if own:
                i, j = i[i < j], j[i < j]
            j = j + offset
            if len(i):
                links += np.bincount(i, copies[j], len(nodes)).astype(np.int64) + np.bincount(j, copies[i], len(nodes)).astype(np.int64)
                root = local_roots(i, j, len(nodes))
                moved = np.flatnonzero(root != np.arange(len(nodes)))
                src.append(moved)
                dst.append(root[moved])
        root = local_roots(np.concatenate(src), np.concatenate(dst), len(nodes)) if src else np.arange(len(nodes))
        some = links > 0
        return pa.table({"node": nodes[some], "links": links[some], "root": nodes[root[some]]})

    return dealt.groupBy("a", "b").applyInArrow(run, "node long, links long, root long")
