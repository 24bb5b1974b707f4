"""Phrases of up to five words by Toivonen's sampling, and how strongly their parts belong together.

A sample of documents is mined level by level at a lowered threshold and proposes the phrases that may be frequent. One
pass over all documents then counts exactly what was proposed together with its negative border: phrases that were not
proposed although both their first and their last words, all but one, were. A phrase of the border that turns out frequent
is a failure; what it brings into reach is counted by a further pass, until a pass fails no more. What was proposed is
told by a table of bits of fixed size: where two phrases share a bit more is counted, never less.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from whisperlake.llm.common import held, slices, slot_bits, small_batches
from whisperlake.llm.wordhash import mix64, run_hashes
from whisperlake.plans.scratch import written

#: Of each byte: 0 between words, 1 in a word, 2 between pieces; and the byte with A-Z lowered.
KIND = np.ones(256, np.uint8)
KIND[[0x20, 0x09]] = 0
KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BITS = 26
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Entries that a task keeps before it hands them on.
KEPT = 1 << 20
ROWS = "k int, hp long, hw long, n long, lang string, word string"


def slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def extended(first: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of all its words but the last, and that of the last."""
    with np.errstate(over="ignore"):
        return mix64(first * STEP + word)


class Words:
    """The words of some texts: where they stand, the piece of each, and a hash of each with its language."""

    def __init__(self, texts: pa.Array, langs: list[str]):
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        self.bytes = LOWER[whole]
        kind = KIND[whole]
        inside = kind == 1
        edge = np.zeros(len(whole) + 1, bool)
        edge[offsets] = True  # no word goes on from one text into the next
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        doc = np.searchsorted(offsets, self.starts, "right") - 1
        self.piece = np.cumsum(kind == 2, dtype=np.int64)[self.starts] + doc if len(self.starts) else np.empty(0, np.int64)
        # two texts never share a piece: a text that ends without a mark is told from the next by its number
        salt = np.array([xxhash.xxh3_64_intdigest(x) for x in langs], np.uint64)
        self.lang = doc
        with np.errstate(over="ignore"):
            self.hashes = mix64(run_hashes(self.bytes, self.starts, self.ends) + salt[doc]) if len(doc) else np.empty(0, np.uint64)

    def levels(self, new: np.ndarray, old: np.ndarray | None, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(k, hash, hash of all but the last word, hash of the last) of phrases within reach of ``new`` and not of ``old``."""
        n = len(self.hashes)
        h, at = self.hashes, np.arange(n)
        known = [held(slots(h), new), None if old is None else held(slots(h), old)]
        for k in range(2, longest + 1):
            if n < k:
                return
            # both parts proposed, within one piece
            one = self.piece[: n - k + 1] == self.piece[k - 1 :]
            reach = [None if v is None else v[:-1] & v[1:] & one for v in known]
            at = np.flatnonzero(reach[0])
            if not len(at):
                return
            first, last = h[at], self.hashes[at + k - 1]
            own = extended(first, last)
            fresh = slice(None) if reach[1] is None else ~reach[1][at]
            yield k, own[fresh], first[fresh], last[fresh]
            h = np.zeros(n - k + 1, np.uint64)
            h[at] = own
            for i, bits in enumerate((new, old)):
                if bits is not None:
                    v = np.zeros(n - k + 1, bool)
                    v[at] = held(slots(own), bits)
                    known[i] = v & reach[i]


def small(bits: np.ndarray) -> bytes:
    """A table of bits as it is sent to tasks."""
    return zlib.compress(bits.tobytes(), 1)


def large(sent: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(sent), np.uint32)


def tally(own: np.ndarray, first: np.ndarray, last: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Equal phrases, told by two hashes, are one entry with their number."""
    order = np.argsort(own, kind="stable")
    own, first, last = own[order], first[order], last[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (first[1:] != first[:-1])
    at = np.flatnonzero(new)
    counts = np.diff([*at, len(own)]) if n is None else np.add.reduceat(n[order], at) if len(at) else n
    return own[at], first[at], last[at], counts.astype(np.int64)


def _count(docs: DataFrame, new: np.ndarray, old: np.ndarray | None, longest: int) -> DataFrame:
    """Counts of what ``new`` brings into reach beyond ``old``: phrases as (k, hp, hw); at first also words, and k = 0: each language's total."""

    sent = [None if bits is None else small(bits) for bits in (new, old)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new, old = (None if x is None else large(x) for x in sent)
        words: dict[int, list] = {}
        totals: dict[str, int] = {}
        phrases: dict[int, list[tuple[np.ndarray, ...]]] = {}
        names = ROWS.replace(",", "").split()[::2]

        def merged() -> None:
            for k, parts in phrases.items():
                if len(parts) > 1:
                    phrases[k] = [tally(*(np.concatenate(v) for v in zip(*parts)))]

        def made() -> Iterator[pa.RecordBatch]:
            row = lambda k, hp, hw, n, lang, word: pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(hp, pa.int64()), pa.array(hw, pa.int64()), pa.array(n, pa.int64()), pa.array(lang, pa.string()), pa.array(word, pa.string())], names)
            own = list(words.items())
            for a in range(0, len(own), 1 << 16):
                part = own[a : a + (1 << 16)]
                signed = np.array([h for h, _ in part], np.uint64).view(np.int64)
                yield row(np.ones(len(part), np.int32), np.zeros(len(part), np.int64), signed, [v[0] for _, v in part], [v[1] for _, v in part], [v[2] for _, v in part])
            if totals:
                yield row([0] * len(totals), [0] * len(totals), [0] * len(totals), list(totals.values()), list(totals), [None] * len(totals))
            for k, ((_, first, last, n),) in phrases.items():
                for a in range(0, len(n), 1 << 18):
                    s = slice(a, a + (1 << 18))
                    yield row(np.full(len(n[s]), k, np.int32), first[s].view(np.int64), last[s].view(np.int64), n[s], pa.nulls(len(n[s]), pa.string()), pa.nulls(len(n[s]), pa.string()))
            words.clear(), totals.clear(), phrases.clear()

        for b in slices(batches, 2 << 20):
            langs = b.column("lang").to_pylist()
            w = Words(b.column("text"), langs)
            if old is None:
                distinct, first, n = np.unique(w.hashes, return_index=True, return_counts=True)
                raw = w.bytes.tobytes()
                for h, i, c in zip(distinct.tolist(), first.tolist(), n.tolist()):
                    if h in words:
                        words[h][0] += c
                    else:
                        words[h] = [c, langs[w.lang[i]], raw[w.starts[i] : w.ends[i]].decode("utf-8", "replace")]
                for d, c in zip(*(v.tolist() for v in np.unique(w.lang, return_counts=True))):
                    totals[langs[d]] = totals.get(langs[d], 0) + c
            for k, *found in w.levels(new, old, longest):
                phrases.setdefault(k, []).append(tally(*found))
            if sum(len(p[3]) for parts in phrases.values() for p in parts) + 4 * len(words) > KEPT:
                merged()
                if sum(len(p[3]) for parts in phrases.values() for p in parts) + 4 * len(words) > KEPT // 2:
                    yield from made()
        merged()
        yield from made()

    return docs.mapInArrow(run, ROWS)


def _mine(docs: DataFrame, least: int, proposed: np.ndarray, longest: int, passes: list[int]) -> DataFrame:
    """(k, hp, hw, n, lang, word, h) of all words and phrases with ``least`` occurrences or more, and each language's total as k = 0.

    ``passes`` gets the number of phrases that were frequent outside of what was proposed, for each pass.
    """

    def hashed(batches: Iterator[pa.RecordBatch], sent: bytes) -> Iterator[pa.RecordBatch]:
        new = large(sent)
        for b in batches:
            k, first, last = (b.column(c).to_numpy() for c in ("k", "hp", "hw"))
            first, last = first.view(np.uint64), last.view(np.uint64)
            h = np.where(k < 2, last, extended(first, last))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(h.view(np.int64)), pa.array(slots(h)), pa.array(~held(slots(h), new) & (k > 0) & (k < longest))], [*b.schema.names, "h", "slot", "fresh"])

    old, new, found = None, proposed, None
    while True:
        sent = small(new)
        # a task has one row of each phrase, so that rows are dealt before they are added up
        rows = _count(docs, new, old, longest).repartition("hp", "hw").groupBy("k", "hp", "hw", "lang", "word").agg(F.sum("n").alias("n"))
        frequent = rows.where((F.col("n") >= least) | (F.col("k") == 0)).select("k", "hp", "hw", "n", "lang", "word")
        got = written(frequent.mapInArrow(partial(hashed, sent=sent), ROWS + ", h long, slot long, fresh boolean"), "phrases")
        found = got if found is None else found.unionByName(got)
        failed = got.where("fresh").select("slot")
        passes.append(failed.count())
        if not passes[-1]:
            return found.select("k", "hp", "hw", "n", "lang", "word", "h", "slot")
        old, new = new, new | slot_bits(failed, BITS)


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, share: int = 16, lowered: float = 0.6, passes: list[int] | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words with ``least`` occurrences or more.

    The sample is one document in ``share``, told by a hash of its row, mined at ``lowered`` times its share of ``least``.
    Null texts are empty, null languages ``und``; each repeated row counts; a text may be of any length, as may a word;
    texts without words and empty tables give no rows; equal scores go by ``a``, then by the phrase's bytes; other columns
    are not read. ``passes``, if given, gets the failures of each pass over all documents.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce("lang", F.lit("und")).cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)).alias("part"))
    nothing = np.zeros(1 << BITS - 5, np.uint32)
    sample = _mine(rows.where("part = 0").drop("part"), max(2, int(least * lowered / share)), nothing, longest, [])
    proposed = slot_bits(sample.where(f"k > 0 AND k < {longest}").select("slot"), BITS)
    found = _mine(rows.drop("part"), least, proposed, longest, [] if passes is None else passes)
    return _ranked(found, longest, top)


def _ranked(found: DataFrame, longest: int, top: int) -> DataFrame:
    """The phrases' words, from those of all words but the last and the last, level by level; then scores of their cuts."""
    totals = found.where("k = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    words = found.where("k = 1").select("lang", "h", F.array("word").alias("words"), F.col("n").alias("a"))
    last = words.select(F.col("h").alias("hw"), F.col("words").alias("more"), F.col("lang").alias("lang_of"))
    level, every = words, words
    for k in range(2, longest + 1):
        own = found.where(F.col("k") == k).select("hp", "hw", "h", F.col("n").alias("a"))
        level = own.join(level.select(F.col("h").alias("hp"), "lang", "words"), "hp").join(last, "hw").where("lang = lang_of")
        level = written(level.select("lang", "h", F.concat("words", "more").alias("words"), "a"), "level")  # so that no level's joins are planned again in the next
        every = every.unionByName(level)
    every = written(every.select("lang", F.concat_ws(" ", "words").alias("phrase"), "words", F.size("words").alias("k"), "a"), "frequent")
    candidates = every.where("k > 1")
    part = lambda begin, size: F.concat_ws(" ", F.slice("words", begin, size))
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("first"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    known = every.select("lang", "phrase", "a")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    cuts = cuts.join(totals, "lang")
    score = F.expr("cast((cast(1000 as decimal(5,0)) * (cast(a as decimal(19,0)) * cast(n as decimal(19,0)))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as long)")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    # what lies inside of a longer candidate as frequent as itself goes
    spots = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("k") - size + 1), lambda begin: F.concat_ws(" ", F.slice("words", begin, size)))))
    inner = candidates.where("k > 2").select("lang", "a", F.explode(F.array_distinct(spots)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where("longer IS NULL OR longer < a")
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score")
