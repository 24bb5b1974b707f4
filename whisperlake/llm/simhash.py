"""SimHash near-duplicate classes through an inverted index on byte positions.

A document's fingerprint has 64 bits, so 8 positional bytes. Two fingerprints that differ in at most 3 bits agree in at
least 5 of the 8 bytes. Posting lists on single bytes would hold 1/256 of all fingerprints each; the lists here are on
triples of positions instead. The 8 triples inside {0..3} and {4..7} suffice: of any 5 agreeing positions 3 fall into one
half. Within a list the shared positional bytes of each pair are tallied, pairs below the guaranteed 5 go, and the rest
are verified bit by bit. A list longer than ``most`` is split exactly: members that share the triple must agree in 2 of
the other 5 positions, so the 10 pairs of those make lists of the second level. Such a list that is still longer is split
once more: 3 bits at most differ in its 3 free bytes, so one of their 4 stretches of 6 bits is alike. A list of the third
level holds 2**18 distinct fingerprints at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whisperlake.llm.common import small_batches, texts
from whisperlake.operators.components import components
from whisperlake.plans.scratch import written

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
SHARED = 5  # positional bytes that a pair within RADIUS bits is bound to share
RADIUS = 3


def fingerprint(text: str, width: int = 3, seed: int = 42, block: int = 1 << 16) -> int:
    """SimHash of one text: bit is 1 if set in over half the shingles' XXH64; no words: 0."""
    words = text.encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) < width:
        starts, ends = [0], [len(joined)]
    else:
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
        ends = ends[width - 1 :].tolist()
    n, hash64 = len(starts), xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for k in range(0, n, block):
        part = [hash64(joined[a:b], seed) for a, b in zip(starts[k : k + block], ends[k : k + block])]
        bits = np.unpackbits(np.array(part, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, int] = {}
            out = np.empty(b.num_rows, np.uint64)
            for k, t in enumerate(b.column("text").to_pylist()):
                if t not in seen:
                    seen[t] = fingerprint(t)
                out[k] = seen[t]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For all of a against all of b: shared positional bytes reach SHARED, and at most RADIUS bits differ."""
    x = a[:, None] ^ b[None, :]
    y = x | (x >> np.uint64(4))
    y |= y >> np.uint64(2)
    y |= y >> np.uint64(1)
    tally = 8 - np.bitwise_count(y & np.uint64(0x0101010101010101))
    hit = tally >= SHARED
    hit[hit] = np.bitwise_count(x[hit]) <= RADIUS
    return hit


def roots(fp: np.ndarray, cells: int = 1 << 21) -> np.ndarray:
    """For each of the distinct fingerprints, the position of its class's first member, classes by links within fp."""
    root, left = np.arange(len(fp)), np.arange(1, len(fp))
    seed, front = 0, np.array([0])
    while len(left):
        if not len(front):
            seed, front, left = left[0], left[:1], left[1:]
            continue
        part, front = front[: max(1, cells // len(left))], front[max(1, cells // max(1, len(left))) :]
        hit = near(fp[part], fp[left]).any(axis=0)
        new = left[hit]
        root[new] = seed
        left, front = left[~hit], np.concatenate([front, new])
    return root


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each posting list: a star for each class found in it."""
    for b in batches:
        src, dst = [], []
        fps = b.column("fps")
        nodes = b.column("nodes")
        off = fps.offsets.to_numpy()
        fp, node = fps.values.to_numpy(), nodes.values.to_numpy()
        for k in range(b.num_rows):
            f, m = fp[off[k] : off[k + 1]], node[off[k] : off[k + 1]]
            if len(f) == 2:
                if ((int(f[0]) ^ int(f[1])) & 0xFFFFFFFFFFFFFFFF).bit_count() <= RADIUS:
                    src.append(m[:1])
                    dst.append(m[1:])
                continue
            r = roots(f.view(np.uint64))
            at = np.flatnonzero(r != np.arange(len(r)))
            src.append(m[at])
            dst.append(m[r[at]])
        pack = lambda x: pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([pack(src), pack(dst)], ["src", "dst"])


def _byte(position: int) -> str:
    return f"(shiftrightunsigned(fp, {8 * position}) & 255L)"


def _key(number: int, positions: tuple[int, ...]) -> str:
    return f"{number}L" if not positions else f"(({_key(number, positions[:-1])}) * 256L + {_byte(positions[-1])})"


def links(nodes: DataFrame, most: int = 2048) -> DataFrame:
    """(src, dst) such that classes of distinct fingerprints at RADIUS bits or less are the components.

    ``nodes``: (fp, node), fp distinct. ``most`` only chooses between the two exact ways; it drops nothing.
    """
    first = ", ".join(f"struct({k} as t, {_key(k, p)} as key)" for k, p in enumerate(TRIPLES))
    keys = nodes.select("fp", "node", F.expr(f"inline(array({first}))"))
    counts = keys.groupBy("key").count().where("count > 1")
    # every pair may be listed under several keys; a single row of a key has no partner and goes here
    listed = written(keys.join(counts, "key"), "lists")
    gather = lambda df, *key: df.groupBy(*key).agg(F.collect_list("fp").alias("fps"), F.collect_list("node").alias("nodes")).where(F.size("fps") > 1).select("fps", "nodes")

    def below(p: tuple[int, ...]) -> str:
        """The second-level keys of a triple, each with the bytes that both leave free."""
        free = [x for x in range(8) if x not in p]
        return ", ".join(f"struct({_key(n, q)} as more, {_key(0, tuple(x for x in free if x not in q))} as rest)" for n, q in enumerate(combinations(free, 2)))

    second = " ".join(f"when t = {k} then array({below(p)})" for k, p in enumerate(TRIPLES))
    hot = listed.where(F.col("count") > most).select("key", "fp", "node", F.expr(f"inline(case {second} end)"))
    sizes = hot.groupBy("key", "more").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = written(hot.join(sizes, ["key", "more"]), "lists")
    third = ", ".join(f"{j}L * 64 + (shiftrightunsigned(rest, {6 * j}) & 63L)" for j in range(4))
    hotter = sized.where(F.col("n") > most).select("key", "more", "fp", "node", F.expr(f"explode(array({third})) as stretch"))
    every = gather(listed.where(F.col("count") <= most), "key").unionByName(gather(sized.where(F.col("n") <= most), "key", "more")).unionByName(gather(hotter, "key", "more", "stretch"))
    small_batches(nodes.sparkSession)
    return every.mapInArrow(_spans, "src long, dst long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Texts that are null or have no words get fingerprint zero and link like any other. A repeated doc_id gets one row for
    each of its rows. An empty table gives no rows; columns other than doc_id and text are not read. Rows with one
    fingerprint are merged before any list is made, so that a group of copies, however large, costs one entry.
    """
    prints = written(fingerprints(docs), "fingerprints")
    # fingerprints are the nodes, so that rows without a doc_id link others too
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.col("fp")), "nodes")
    found = components(links(nodes.select("fp", "node")))
    rooted = nodes.join(found, "node", "left").select("fp", "least", F.coalesce("component", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(named, "root").select("fp", "component_id"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose class holds a smaller doc_id.

    Of rows that repeat one doc_id all stay, if any of them does; rows with a null doc_id stay.
    """
    kept = near_duplicates(docs).where("doc_id = component_id or doc_id is null").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
