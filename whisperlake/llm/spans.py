"""Sentence-span de-duplication: every run of several consecutive sentences is hashed and joined globally.

Sentences end after ., ! or ? before white space, and at line breaks. Spans are the shortest runs of at least
``least_words`` words that begin or that end with a sentence: the former cover a repeated passage up to its last such
run, the latter what is left of its tail. A run is one sentence where that has the words alone, since a repeated passage
may be one long sentence; a whole text of fewer words is one span. A sentence goes when any span over it repeats one that
occurs earlier: earlier by doc_id, then by position in the document. Spans are equal if both of two unlike hashes of their
words are, 128 bits together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from whisperlake.llm.common import HEAVY_ROWS, held, join_counted, slot_bits, small_batches, texts
from whisperlake.llm.wordhash import WordHashes, sentence_bounds
from whisperlake.plans.scratch import written


SLOT_BITS = 27  # of the table that tells spans that may repeat: 16 MB


def short_runs(first: np.ndarray, some: np.ndarray, words: int, least_words: int, short_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last sentence) of the shortest runs of several sentences and of ``short_words`` words at least that begin or end with each, and of the single ones of ``least_words``."""
    n, low = len(some), first[some]
    high = np.append(low[1:], words)
    k = np.arange(n)
    last = np.maximum(np.searchsorted(high, low + short_words), k + 1)
    begin = np.minimum(np.searchsorted(low, high - short_words, "right") - 1, k - 1)
    ahead, behind, alone = last < n, begin >= 0, high - low >= least_words
    a, z = np.concatenate([k[ahead], begin[behind], k[alone]]), np.concatenate([last[ahead], k[behind], k[alone]])
    return some[a], some[z]


def spans_of(text: str, least_words: int, short_words: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first sentence, last sentence, hash, other hash) of every span."""
    bounds = sentence_bounds(text)
    words = WordHashes(text)
    if not bounds or not len(words):
        none = np.empty(0, np.int64)
        return none, none, none, none
    # words of sentence k are first[k] .. first[k + 1] - 1
    starts = np.array([a for a, _ in bounds])
    first = np.append(np.searchsorted(words.char_starts, starts), len(words))
    some = np.flatnonzero(np.diff(first) > 0)
    if short_words is not None:
        a, z = short_runs(first, some, len(words), least_words, short_words)
        if len(words) < least_words:
            a, z = np.append(a, some[0]), np.append(z, some[-1])
        a, z = np.unique(np.stack([a, z]), axis=1)
    elif len(words) < least_words:
        a, z = np.array([0]), np.array([len(bounds) - 1])
    else:
        ahead = some[first[some] + least_words <= len(words)]
        behind = some[first[some + 1] >= least_words]
        # the sentences that reach the count
        last = np.searchsorted(first, first[ahead] + least_words, side="left") - 1
        begin = np.searchsorted(first, first[behind + 1] - least_words, side="right") - 1
        a, z = np.unique(np.stack([np.append(ahead, begin), np.append(last, behind)]), axis=1)
    joined, at, to = words.joined()
    check = [xxhash.xxh64_intdigest(joined[x:y]) for x, y in zip(at[first[a]].tolist(), to[first[z + 1] - 1].tolist())]
    return a, z, words.span_hash(first[a], first[z + 1]), np.array(check, np.uint64).view(np.int64)


def span_table(docs: DataFrame, least_words: int, short_words: int | None = None) -> DataFrame:
    """(doc_id, first, last, hash, other) of every span of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [spans_of(t, least_words, short_words) for t in b.column("text").to_pylist()]
            n = [len(x[0]) for x in out]
            ids = pa.array(np.repeat(np.arange(len(out)), n))
            a, z, h, c = (np.concatenate([x[k] for x in out]) if out else np.empty(0, np.int64) for k in range(4))
            cols = [pa.array(a.astype(np.int32)), pa.array(z.astype(np.int32)), pa.array(h.astype(np.int64)), pa.array(c.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(ids), *cols], ["doc_id", "first", "last", "hash", "other"])

    small_batches(docs.sparkSession)
    return texts(docs).where("doc_id is not null").mapInArrow(run, "doc_id long, first int, last int, hash long, other long")


def repeats(spans: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """The rows of ``spans`` that repeat an earlier one.

    Hashes alone are counted first, and a table of bits of the repeated ones sends only spans on that may repeat. Hashes of
    very many of these meet their spans by a broadcast of bounded size.
    """
    slot = F.col("hash").bitwiseAND(F.lit((1 << SLOT_BITS) - 1)).alias("slot")
    bits = spans.sparkSession.sparkContext.broadcast(slot_bits(spans.groupBy("hash").count().where("count > 1").select(slot), SLOT_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("hash").to_numpy() & ((1 << SLOT_BITS) - 1)
            yield b.filter(pa.array(held(at, bits.value)))

    maybe = written(spans.mapInArrow(run, spans.schema), "spans")
    key = ["hash", "other"]
    firsts = written(maybe.groupBy(*key).agg(F.min(F.struct("doc_id", "first")).alias("origin"), F.count(F.lit(1)).alias("n")).where("n > 1"), "firsts")
    found = join_counted(maybe, firsts, key, "n", maybe.count(), heavy_rows)
    return found.where(F.struct("doc_id", "first") > F.col("origin")).select("doc_id", "first", "last")


def repeated(docs: DataFrame, least_words: int = 20, short_words: int | None = None) -> DataFrame:
    """(doc_id, sentences): positions, ascending, of the sentences that a non-first repeated span covers.

    With ``short_words``, runs of two sentences and more count from so many words on, and ``least_words`` is for single
    ones. Only documents with such sentences have a row. Null and empty texts and those without words have no spans; rows that repeat a doc_id count as one document's, so their equal positions do not repeat each other;
    a null doc_id is left out; an empty table gives no rows; columns other than doc_id and text are not read.
    """
    later = repeats(written(span_table(docs, least_words, short_words), "spans"))
    return later.groupBy("doc_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence("first", "last"))))).alias("sentences")
    )


def remove(docs: DataFrame, least_words: int = 20, short_words: int | None = None) -> DataFrame:
    """Every row of ``docs`` with ``clean_text`` and ``removed``, the array of positions that went (empty if none).

    Columns of these names in ``docs`` are replaced. A null text counts as empty; rows with a null doc_id lose nothing;
    rows that repeat a doc_id lose the same positions, where they have them; texts are read whole, whatever their length;
    an empty table gives no rows.
    """
    docs = docs.drop("clean_text", "removed")
    found = repeated(docs, least_words, short_words).withColumnRenamed("sentences", "removed")
    joined = docs.join(found, "doc_id", "left")
    names = [*joined.columns[:-1], "clean_text", "removed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean, went = [], []
            for t, gone in zip(b.column("text").to_pylist(), b.column("removed").to_pylist()):
                t, drop, left = t or "", set(gone or ()), []
                if drop:
                    bounds = sentence_bounds(t)
                    ends = [a for a, _ in bounds[1:]] + [len(t)]
                    left = [k for k in range(len(bounds)) if k in drop]
                    t = "".join(t[a:z] for k, ((a, _), z) in enumerate(zip(bounds, ends)) if k not in drop)
                clean.append(t)
                went.append(left)
            own = [b.column(c) for c in b.schema.names if c != "removed"]
            yield pa.RecordBatch.from_arrays([*own, pa.array(clean, pa.string()), pa.array(went, pa.list_(pa.int32()))], names)

    small_batches(docs.sparkSession)
    kinds = StructType([*joined.schema.fields[:-1], StructField("clean_text", StringType()), StructField("removed", ArrayType(IntegerType()))])
    return joined.mapInArrow(run, kinds)
