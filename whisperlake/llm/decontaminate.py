"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

An item is a multiset of five-word shingles (of all its words, where it has fewer) with a 64-bit SimHash; its size is the
number of its shingles. A window of a document has as many shingles as an item. A window at similarity LEAST to an item
of one size shares a certain number of shingles with items of that size. A table of bits, of one length whatever the
benchmark's, tells which windows may, and only these get a fingerprint. Fingerprints are cut into 11 blocks. Two within
21 bits agree in a block but for one bit at most, so an equi join of the windows' blocks with the items' blocks and their
one-bit neighbours proposes every item within RADIUS of a window. What is proposed is verified by the weighted Jaccard
similarity of the shingle multisets. Windows of equal contents are searched once.

A fingerprint of few distinct shingles lies on the edge of many bits, so that a similar window may be far from it. Items
of which less than PLAIN of the shingles are distinct are proposed to every candidate window that shares a shingle with
them, which is exact; ``radius=None`` does so for all items.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whisperlake.llm.common import held, slot_bits, small_batches, texts
from whisperlake.llm.wordhash import WordHashes, mix64
from whisperlake.plans.scratch import written

WIDTH, RADIUS, LEAST, PLAIN = 5, 20, 0.8, 0.75
BLOCKS = [(k * 6, 6) for k in range(9)] + [(54, 5), (59, 5)]  # first bit and length of each
SLOT_BITS = 26  # of the table of bits, which takes 8 MB


def window_prints(shingles: np.ndarray, size: int, most: int = 1 << 14) -> np.ndarray:
    """SimHash of every run of ``size`` shingles: a bit is 1 if set in over half of them. ``most`` bounds what is held at once."""
    out = []
    for a in range(0, len(shingles) - size + 1, max(most, size)):
        part = shingles[a : a + max(most, size) + size - 1]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
        out.append(np.packbits(2 * (sums[size:] - sums[:-size]) > size, axis=1, bitorder="little").view(np.uint64).ravel())
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two multisets of shingles: sum of the lesser counts over sum of the greater."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    least = int(np.minimum(n[i], m[j]).sum())
    return least / (len(a) + len(b) - least)


def shared_at_least(a: int, b: int) -> int:
    """How many shingles multisets of sizes a and b at similarity LEAST share at least."""
    return math.ceil(LEAST * (a + b) / (1 + LEAST) - 1e-9)


def of_size(shingles: np.ndarray, size: int) -> np.ndarray:
    """Slots of the pairs of shingle and item size; size 0 stands for any."""
    with np.errstate(over="ignore"):
        return (mix64(shingles + np.uint64(size) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def item_rows(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, width, size, print, shingles) of every row of ``benchmark`` with words; ``item`` tells rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist()):
                words = WordHashes(text)
                if len(words):
                    s = words.shingles(WIDTH)
                    rows.append((i, min(WIDTH, len(words)), len(s), int(window_prints(s, len(s)).view(np.int64)[0]), s.tobytes()))
            yield _batch(rows, ITEM)

    small_batches(benchmark.sparkSession)
    found = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, _ddl(ITEM))
    return written(found.withColumn("item", F.monotonically_increasing_id()), "items")


ITEM = {"item_id": "long", "width": "int", "size": "int", "print": "long", "shingles": "binary"}
WINDOW = {"row": "long", "doc_id": "long", "text_hash": "long", "start": "int", "words": "int", "width": "int", "size": "int", "print": "long", "content": "long", "shingles": "binary"}
_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}


def _ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in columns.items())


def _batch(rows: list[tuple], columns: dict[str, str]) -> pa.RecordBatch:
    cols = [*zip(*rows)] if rows else [()] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, t in zip(cols, columns.values())], [*columns])


def slots_of(items: DataFrame) -> np.ndarray:
    """The bits that the items' shingles set, for any size and for their own: SLOT_BITS say how many, whatever the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.empty(0, np.int64)]
            for size, raw in zip(b.column("size").to_pylist(), b.column("shingles").to_pylist()):
                s = np.unique(np.frombuffer(raw, np.uint64))
                found += [of_size(s, 0), of_size(s, size)]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)))], ["slot"])

    return slot_bits(items.select("size", "shingles").mapInArrow(run, "slot long"), SLOT_BITS)


def candidate_windows(shingles: np.ndarray, size: int, bits: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """First shingles of the windows for items of ``size`` that may reach LEAST; ``hits``: shingles that some item may hold."""
    own = min(size, len(shingles))
    need = shared_at_least(own, size)
    if need > own or len(hits) < need:
        return np.empty(0, np.int64)
    at = hits[held(of_size(shingles[hits], size), bits)]
    if len(at) < need:
        return np.empty(0, np.int64)
    # a window with enough hits has one within its first shingles, so only their neighbourhoods count
    starts = np.unique((at[:, None] - np.arange(own - need + 1)).ravel())
    starts = starts[(starts >= 0) & (starts <= len(shingles) - own)]
    return starts[np.searchsorted(at, starts + own) - np.searchsorted(at, starts) >= need]


def windows(docs: DataFrame, sizes: list[tuple[int, int]], bits: np.ndarray) -> DataFrame:
    """WINDOW rows: of each document, the candidate windows for items of each (width, size), equal contents once, the first."""
    by_width = {w: [m for v, m in sizes if v == w] for w, _ in sizes}
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, table = TaskContext.get().partitionId() << 33, shared.value
        for b in batches:
            rows: list[tuple] = []
            for doc, h, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text_hash", "text"))):
                row, words = row + 1, WordHashes(text)
                for w, own_sizes in by_width.items():
                    if len(words) < w:
                        continue
                    s = words.shingles(w)
                    hits = np.flatnonzero(held(of_size(s, 0), table))
                    for m in own_sizes if len(hits) else ():
                        starts = candidate_windows(s, m, table, hits)
                        if not len(starts):
                            continue
                        size = min(m, len(s))
                        content = words.span_hash(starts, starts + size + w - 1)
                        first = np.sort(np.unique(content, return_index=True)[1])
                        starts, content = starts[first], content[first]
                        edge = np.append(np.flatnonzero(np.diff(starts, prepend=-2) > 1), len(starts))
                        prints = np.concatenate([window_prints(s[starts[x] : starts[y - 1] + size], size) for x, y in zip(edge, edge[1:])]).view(np.int64)
                        for a, c, p in zip(starts.tolist(), content.tolist(), prints.tolist()):
                            rows.append((row, doc, h, a, size + w - 1, w, m, p, c, s[a : a + size].tobytes()))
            yield _batch(rows, WINDOW)

    hashed = texts(docs, F.xxhash64("text").alias("text_hash"))
    return written(hashed.mapInArrow(run, _ddl(WINDOW)), "windows")


def _block(first: int, length: int) -> str:
    return f"cast(shiftrightunsigned(print, {first}) & {(1 << length) - 1}L as int)"


def blocks(prints: DataFrame, neighbours: bool) -> DataFrame:
    """``prints`` with (block, value) of its fingerprint, a row for each block, and for each one-bit neighbour if asked for."""
    found = []
    for k, (first, length) in enumerate(BLOCKS):
        for flip in [0, *(1 << j for j in range(length))] if neighbours else [0]:
            found.append(f"struct({k} as block, {_block(first, length)} ^ {flip} as value)")
    return prints.select("*", F.expr(f"inline(array({', '.join(found)}))"))


def sharing(contents: DataFrame, items: DataFrame, plain: float | None) -> DataFrame:
    """Pairs of one width and size that share a shingle, of the items that are below ``plain`` in distinct shingles, or of all."""

    def distinct(keep: str, all_sizes: bool):
        names = {"long": pa.int64(), "int": pa.int32()}
        shape = {"width": "int", "size": "int", **({"print": "long", "content": "long"} if keep == "content" else {"item": "long"}), "shingle": "long"}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [np.unique(np.frombuffer(x, np.uint64)) for x in b.column("shingles").to_pylist()]
                if not all_sizes:
                    found = [x if len(x) < plain * n else x[:0] for x, n in zip(found, b.column("size").to_pylist())]
                at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]), pa.int64())
                flat = np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(at).cast(names[t]) for c, t in shape.items() if c != "shingle"), pa.array(flat)], [*shape])

        return run, _ddl(shape)

    left, right = (df.mapInArrow(*distinct(keep, every)) for df, keep, every in ((contents, "content", True), (items, "item", plain is None)))
    return left.join(right, ["width", "size", "shingle"]).select("width", "size", "print", "content", "item").distinct()


def proposed(contents: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs of the rows of ``contents`` and ``items`` of one width and size whose fingerprints are within ``radius``."""
    keys = ["width", "size", "block", "value"]
    left = blocks(contents.select("width", "size", "print", "content"), False)
    right = blocks(items.select("width", "size", "print", "item"), True).withColumnRenamed("print", "item_print")
    near = left.join(right, keys).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
    return near.select("width", "size", "print", "content", "item").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, radius: int | None = RADIUS) -> DataFrame:
    """(doc_id, text_hash, item_id, start_word, words, similarity): each item's best window, the first of equals, in each document that leaks it.

    ``radius`` None finds every window at LEAST or more for certain; the radius misses some, at random, and none of an item
    of few distinct shingles. ``text_hash`` is the text's xxhash64 (null: that of the empty text). A document with fewer shingles than an item is
    one window for it. A null or empty text has no words and neither leaks nor is leaked. Texts are read whole, whatever
    their length. Repeated rows give repeated results, for items as for documents. Empty tables give no rows; columns
    other than doc_id, item_id and text are not read.
    """
    items = item_rows(benchmark)
    sizes = sorted((r["width"], r["size"]) for r in items.select("width", "size").distinct().collect())  # a row for each length of an item
    found = windows(docs, sizes, slots_of(items))
    key = ["width", "size", "print", "content"]
    contents = written(found.groupBy(*key).agg(F.min("shingles").alias("shingles")), "contents")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            value = [similarity(*(np.frombuffer(x, np.uint64) for x in p)) for p in zip(b.column("shingles").to_pylist(), b.column("theirs").to_pylist())]
            out = pa.RecordBatch.from_arrays([*(b.column(c) for c in (*key, "item_id", "item")), pa.array(value, pa.float64())], [*key, "item_id", "item", "similarity"])
            yield out.filter(pa.array(np.array(value) >= LEAST, pa.bool_()))

    some = sharing(contents, items, None) if radius is None else proposed(contents, items, radius).unionByName(sharing(contents, items, PLAIN)).distinct()
    pairs = some.join(contents, key).join(items.select("item", "item_id", F.col("shingles").alias("theirs")), "item")
    good = pairs.select(*key, "item_id", "item", "shingles", "theirs").mapInArrow(verify, "width int, size int, print long, content long, item_id long, item long, similarity double")
    places = found.select(*key, "row", "doc_id", "text_hash", "start", "words").join(good, key)
    best = places.groupBy("row", "item").agg(F.max_by(F.struct("doc_id", "text_hash", "item_id", "start", "words", "similarity"), F.struct("similarity", -F.col("start"))).alias("b"))
    return best.select("b.doc_id", "b.text_hash", "b.item_id", F.col("b.start").alias("start_word"), "b.words", F.round("b.similarity", 12).alias("similarity"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text leaks an item.

    Each row is judged by its own text: rows with a null or repeated doc_id stay or go like any other. Columns and texts
    stay as they are; an empty benchmark removes nothing; an empty table gives no rows.
    """
    d, b = docs.alias("d"), leaks(docs, benchmark).select("doc_id", "text_hash").distinct().alias("b")
    same = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.xxhash64(F.coalesce(F.col("d.text"), F.lit(""))) == F.col("b.text_hash"))
    return d.join(b, same, "left_anti")
