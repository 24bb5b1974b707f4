"""Ranked lexical search with MaxScore whose bounds know pairs of terms.

Documents are counted once for the terms that are asked for and written as a forward index. Its rows are dealt, as they
lie, into shards of bounded size. A shard holds a posting list for each term (documents and impacts, and the largest
impact), and, for the pairs of an item's heaviest terms, the list of the documents that hold both with the largest joint
impact of any of them. A set of terms can bring a document no more than the sum of its terms' largest impacts; where two
of them are paired it brings no more than the joint maximum, or the larger of the two, so that a choice of disjoint pairs
lowers the bound. Terms whose bound together stays below the k-th best score are not opened: documents that hold
nothing else are skipped, and the others leave as soon as the bound of what is missing no longer reaches that score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from whisperlake.llm.common import slices, small_batches
from whisperlake.plans.scratch import written

#: Letters, digits and all bytes of other characters make terms; A-Z are lowered.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Terms of a block of items, of which the driver and each task hold one at a time; documents and postings of a shard.
BLOCK_TERMS, SHARD_DOCS, SHARD_POSTINGS = 200_000, 16_384, 2_000_000
INDEX = "shard long, docs binary, known binary, terms binary, ends binary, places binary, impacts binary, pairs binary, pair_ends binary, pair_places binary, joint binary"


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(FOLD).split()


def impact(w: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class Shard:
    """Posting lists of some documents; ``lists[t]`` is (places, impacts, largest impact), ``joint[a, b]`` (places of both, largest sum)."""

    def __init__(self, docs: np.ndarray, known: np.ndarray):
        self.docs, self.known = docs, known
        self.lists: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
        self.joint: dict[tuple[int, int], tuple[np.ndarray, int]] = {}
        self.opened = 0  # postings read by searches

    @classmethod
    def build(cls, docs: np.ndarray, known: np.ndarray, place: np.ndarray, term: np.ndarray, impacts: np.ndarray, pairs: list[tuple[int, int]]) -> Shard:
        out = cls(docs, known)
        order = np.lexsort((place, term))
        place, term, impacts = place[order].astype(np.int32), term[order], impacts[order]
        edges = np.flatnonzero(np.diff(term, prepend=-1))
        for a, b in zip(edges, [*edges[1:], len(term)]):
            out.lists[int(term[a])] = place[a:b], impacts[a:b], int(impacts[a:b].max())
        for a, b in pairs:
            if a in out.lists and b in out.lists:
                x, y = sorted((out.lists[a], out.lists[b]), key=lambda v: len(v[0]))
                at = np.minimum(np.searchsorted(y[0], x[0]), len(y[0]) - 1)
                both = y[0][at] == x[0]
                if both.any():
                    out.joint[a, b] = x[0][both], int((x[1][both] + y[1][at[both]]).max())
        return out

    def packed(self, number: int) -> tuple:
        ends = lambda lists: np.cumsum([len(v[0]) for v in lists], dtype=np.int64).tobytes()
        flat = lambda lists, k, kind: np.concatenate([np.empty(0, kind), *(v[k] for v in lists)]).astype(kind).tobytes()
        own, joint = list(self.lists.values()), list(self.joint.values())
        tops = np.array([v[1] for v in joint], np.int64).tobytes()
        return (number, self.docs.tobytes(), self.known.tobytes(), np.array(list(self.lists), np.int32).tobytes(), ends(own), flat(own, 0, np.int32), flat(own, 1, np.int64),
                np.array(list(self.joint), np.int32).tobytes(), ends(joint), flat(joint, 0, np.int32), tops)

    @classmethod
    def unpacked(cls, row: dict) -> Shard:
        get = lambda name, kind: np.frombuffer(row[name], kind)
        out = cls(get("docs", np.int64), get("known", bool))
        places, impacts, at = get("places", np.int32), get("impacts", np.int64), 0
        for t, end in zip(get("terms", np.int32).tolist(), get("ends", np.int64).tolist()):
            out.lists[t] = places[at:end], impacts[at:end], int(impacts[at:end].max())
            at = end
        places, at = get("pair_places", np.int32), 0
        for (a, b), end, top in zip(get("pairs", np.int32).reshape(-1, 2).tolist(), get("pair_ends", np.int64).tolist(), get("joint", np.int64).tolist()):
            out.joint[a, b] = places[at:end], top
            at = end
        return out

    def bounds(self, terms: list[int], paired: list[tuple[int, int]]) -> list[int]:
        """The most that the first 0, 1, 2, ... of ``terms`` can bring a document together, by a greedy choice of disjoint pairs."""
        tops = [self.lists[t][2] for t in terms]
        rank = {t: k for k, t in enumerate(terms)}
        saved = []
        for a, b in paired:
            if a in rank and b in rank:
                x, y = self.lists[a][2], self.lists[b][2]
                save = x + y - max(x, y, self.joint[a, b][1] if (a, b) in self.joint else 0)
                if save > 0:
                    saved.append((save, rank[a], rank[b]))
        saved.sort(reverse=True)
        out, total = [0], 0
        for k, top in enumerate(tops):
            total += top
            used: set[int] = set()
            less = 0
            for save, x, y in saved:
                if x <= k and y <= k and x not in used and y not in used:
                    used |= {x, y}
                    less += save
            out.append(total - less)
        return out

    def _add(self, term: int, docs: np.ndarray, sums: np.ndarray) -> None:
        """Add a term's impacts to the sums of ``docs``, ascending places."""
        places, impacts, _ = self.lists[term]
        at = np.minimum(np.searchsorted(places, docs), len(places) - 1)
        hit = places[at] == docs
        sums[docs[hit]] += impacts[at[hit]]
        self.opened += len(docs)

    def best(self, wanted: list[int], paired: list[tuple[int, int]], floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k best documents with a score of ``floor`` and of 1 at least; all scores equal to the k-th's compete by doc_id."""
        terms = sorted((t for t in wanted if t in self.lists and self.lists[t][2] > 0), key=lambda t: (self.lists[t][2], t))
        if not terms:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        most, least = self.bounds(terms, paired), max(1, floor)
        if most[-1] < least:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        sums = np.zeros(len(self.docs), np.int64)
        seeds = np.empty(0, np.int32)
        for p in sorted((p for p in paired if p in self.joint), key=lambda p: -self.joint[p][1]):
            seeds = np.union1d(seeds, self.joint[p][0])
            if len(seeds) >= k:  # documents of a pair are likely ones: their k-th score is the first threshold
                for t in terms:
                    self._add(t, seeds, sums)
                least = max(least, int(np.partition(sums[seeds], len(seeds) - k)[len(seeds) - k]))
                sums[:] = 0
                break
        skipped = next(n for n in range(len(terms), -1, -1) if most[n] < least or n == 0)
        for t in reversed(terms[skipped:]):
            places, impacts, _ = self.lists[t]
            sums[places] += impacts
            self.opened += len(places)
        docs = np.flatnonzero(sums)
        for n in range(skipped, 0, -1):
            if len(docs) >= k:
                least = max(least, int(np.partition(sums[docs], len(docs) - k)[len(docs) - k]))
            docs = docs[sums[docs] + most[n] >= least]
            self._add(terms[n - 1], docs, sums)
        docs = docs[sums[docs] >= least]
        order = np.lexsort((self.docs[docs], ~self.known[docs], -sums[docs]))[:k]
        return docs[order], sums[docs[order]]


def search(docs: DataFrame, items: DataFrame, k: int = 10, pair_terms: int = 8, seed_share: int = 16) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best of all ``docs`` (doc_id, text) for each row of ``items`` (item_id, text).

    Every pair of an item's ``pair_terms`` heaviest terms gets an intersection list; the lists never change a result. One
    shard in ``seed_share`` is searched first, and the k-th score found there is where the search of all shards starts.
    Items go through in blocks of bounded size. Null texts and such without a term are no documents, and items without a
    term have no rows; each repeated row is a document, or an item, by itself; equal scores go by doc_id, null last; empty
    tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(set(terms_of(t))) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(found, pa.list_(pa.binary()))], ["item_id", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    asked = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(split, f"item_id {kind}, terms array<binary>")
    asked = written(asked.where(F.size("terms") > 0).withColumn("item", F.monotonically_increasing_id()), "items")
    blocks = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_TERMS)
    found = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()  # of BLOCK_TERMS terms or about
        some = _block(docs, [(r["item"], r["item_id"], [bytes(t) for t in r["terms"]]) for r in rows], kind, k, pair_terms, seed_share)
        found = some if found is None else found.unionByName(some)
    return found if found is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")


def _block(docs: DataFrame, items: list[tuple[int, object, list[bytes]]], kind: str, k: int, pair_terms: int, seed_share: int) -> DataFrame:
    vocabulary = {t: n for n, t in enumerate(sorted({t for _, _, terms in items for t in terms}))}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, terms, tfs = [], [], []
            for text in b.column("text").to_pylist():
                words = terms_of(text)
                own = Counter(map(vocabulary.get, words))
                own.pop(None, None)
                n.append(len(words))
                terms.append(list(own))
                tfs.append(list(own.values()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    forward = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<long>").where("n > 0")
    forward = written(forward, "forward")
    total = forward.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    n_docs, n_all = total["n"], total["l"] or 1
    weights = np.zeros(len(vocabulary), np.int64)
    for r in forward.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each of the block's terms
        weights[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["count"] + 1)))
    numbered = [(item, item_id, sorted((vocabulary[t] for t in terms), key=lambda t: (-weights[t], t))) for item, item_id, terms in items]
    paired = {item: [(min(a, b), max(a, b)) for x, a in enumerate(terms[:pair_terms]) for b in terms[x + 1 : pair_terms]] for item, _, terms in numbered}
    pairs = sorted({p for own in paired.values() for p in own})

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, made, kept, n_rows, n_postings = (context.partitionId() if context else 0), 0, [], 0, 0

        def emit() -> pa.RecordBatch:
            flat = lambda c, kind: np.concatenate([b.column(c).flatten().to_numpy(zero_copy_only=False) for b in kept]).astype(kind)
            sizes = np.concatenate([b.column("terms").value_lengths().to_numpy() for b in kept])
            ids = pa.chunked_array([b.column("doc_id") for b in kept]).combine_chunks()
            place = np.repeat(np.arange(n_rows), sizes)
            m = 10 + (90 * np.concatenate([b.column("n").to_numpy() for b in kept]) * n_docs) // n_all
            term, tf = flat("terms", np.int64), flat("tfs", np.int64)
            own = Shard.build(ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), place, term, impact(weights[term], tf, m[place]), pairs)
            row = own.packed((part << 32) + made)
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if k == 0 else pa.binary()) for k, v in enumerate(row)], [c.split()[0] for c in INDEX.split(", ")])

        for b in batches:
            for at in range(0, b.num_rows, 1024):
                piece = b.slice(at, 1024)
                kept.append(piece)
                n_rows += piece.num_rows
                n_postings += len(piece.column("terms").flatten())
                if n_rows >= SHARD_DOCS or n_postings >= SHARD_POSTINGS:
                    yield emit()
                    made, kept, n_rows, n_postings = made + 1, [], 0, 0
        if n_rows:
            yield emit()

    index = written(forward.mapInArrow(shards, INDEX), "postings")

    shape = f"item long, item_id {kind}, doc_id long, score long"
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], shape).schema)

    def run(floors: dict[int, int]):
        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    shard, out = Shard.unpacked(row), []
                    for item, item_id, terms in numbered:
                        places, scores = shard.best(terms, paired[item], floors.get(item, 0), k)
                        out += [(item, item_id, d if ok else None, s) for d, ok, s in zip(shard.docs[places].tolist(), shard.known[places].tolist(), scores.tolist())]
                    yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in out], arrow)

        return found

    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    seeds = index.where(F.pmod(F.xxhash64("shard"), F.lit(seed_share)) == 0).mapInArrow(run({}), shape).withColumn("rank", rank).where(F.col("rank") == k)
    floors = {r["item"]: r["score"] for r in seeds.select("item", "score").collect()}  # a row for each item of the block at most
    best = index.mapInArrow(run(floors), shape).withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")
