"""Quality: a generalised additive model with pairwise interactions, as lookup tables.

Boosting goes round the features in turn: each gets a shallow tree on its own bins, fitted to the residuals of all before
it, and the trees of a feature add up to one table. Then the pairs of features with the largest gain on the residuals get
tables over coarse bins in the same way. A score is a constant plus one table entry for each feature and pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whisperlake.llm.common import crc_fold, small_batches, texts
from whisperlake.llm.wordhash import WordHashes

FEATURES = (
    "log_words", "word_length", "long_words", "distinct_words", "repeated_neighbours", "top_word", "punctuation", "symbols", "bangs",
    "pipes", "digits", "capitals", "non_ascii", "log_lines", "line_length", "distinct_lines", "brackets", "sentence_marks",
)
_IN = lambda chars: np.isin(np.arange(256), list(chars.encode()))
_KINDS = np.stack([
    _IN("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"), _IN("#$%&*@^~+=<>\\"), _IN("!?"), _IN("|"), _IN("0123456789"),
    _IN("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), np.arange(256) >= 128, _IN("()[]{}"), _IN("."),
]).astype(np.float64)


def features(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    words = WordHashes(text)
    n, size = len(words), max(1, len(raw))
    punct, symbols, bangs, pipes, digits, capitals, wide, brackets, stops = _KINDS @ np.bincount(raw, minlength=256) / size
    lengths = words.ends - words.starts
    counts = np.unique(words.words, return_counts=True)[1] if n else np.zeros(1)
    lines = text.split("\n")
    m = max(1, n)
    return np.array([
        np.log1p(n), lengths.mean() if n else 0, (lengths > 14).mean() if n else 0, len(counts) / m if n else 0,
        (words.words[1:] == words.words[:-1]).mean() if n > 1 else 0, counts.max() / m, punct, symbols, bangs, pipes, digits, capitals, wide,
        np.log1p(len(lines)), np.log1p(size / len(lines)), len(set(lines)) / len(lines), brackets, stops,
    ])


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float = 5.0) -> np.ndarray:
    """Values by bin of the tree with so many leaves that greedy splits give, from the bins' gradient sums."""
    edges = [0, len(g)]
    sg, sh = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    for _ in range(leaves - 1):
        best = (1e-9, 0)
        for a, z in zip(edges, edges[1:]):
            k = np.arange(a + 1, z)
            if len(k):
                gains = _gain(sg[k] - sg[a], sh[k] - sh[a], ridge) + _gain(sg[z] - sg[k], sh[z] - sh[k], ridge) - _gain(sg[z] - sg[a], sh[z] - sh[a], ridge)
                top = int(gains.argmax())
                best = max(best, (float(gains[top]), int(k[top])))
        if best[1] == 0:
            break
        edges = sorted([*edges, best[1]])
    out = np.empty(len(g))
    for a, z in zip(edges, edges[1:]):
        out[a:z] = (sg[z] - sg[a]) / (sh[z] - sh[a] + ridge)
    return out


@dataclass
class Model:
    cuts: list[np.ndarray]
    coarse: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, t in enumerate(self.tables):
            out += t[np.searchsorted(self.cuts[f], x[:, f], side="right")]
        low = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.coarse)]
        for a, b, t in self.pairs:
            out += t[low[a], low[b]]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, coarse: int = 8, rounds: int = 120, pair_rounds: int = 40, most_pairs: int = 8, rate: float = 0.15, leaves: int = 4) -> Model:
    """Cyclic boosting of the logistic loss; rows of one class only give a constant near that class."""
    n, k = x.shape
    cut = lambda f, m: np.unique(np.quantile(x[:, f], np.linspace(0, 1, m + 1)[1:-1]))
    cuts, low = [cut(f, bins) for f in range(k)], [cut(f, coarse) for f in range(k)]
    at = [np.searchsorted(cuts[f], x[:, f], side="right") for f in range(k)]
    at_low = [np.searchsorted(low[f], x[:, f], side="right") for f in range(k)]
    p = (y.sum() + 0.5) / (n + 1)
    model = Model(cuts, low, float(np.log(p / (1 - p))), [np.zeros(len(c) + 1) for c in cuts], [])
    logit = np.full(n, model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-logit))
        return y - q, np.maximum(q * (1 - q), 1e-6)

    for _ in range(rounds):
        for f in range(k):
            g, h = slopes()
            size = len(cuts[f]) + 1
            step = rate * tree(np.bincount(at[f], g, size), np.bincount(at[f], h, size), leaves)
            model.tables[f] += step
            logit += step[at[f]]
    g, h = slopes()

    def cells(a: int, b: int, v: np.ndarray) -> np.ndarray:
        w = len(low[b]) + 1
        return np.bincount(at_low[a] * w + at_low[b], v, (len(low[a]) + 1) * w).reshape(-1, w)

    ranked = sorted(((float(_gain(cells(a, b, g), cells(a, b, h), 5.0).sum()), a, b) for a in range(k) for b in range(a)), reverse=True)
    model.pairs = [(a, b, np.zeros((len(low[a]) + 1, len(low[b]) + 1))) for _, a, b in ranked[:most_pairs]]
    for _ in range(pair_rounds):
        for a, b, t in model.pairs:
            g, h = slopes()
            sg, sh = cells(a, b, g), cells(a, b, h)
            # depth two: the cut of a's bins whose halves gain most from a tree over b's
            best, step = -1.0, np.zeros_like(t)
            for cut_at in range(1, len(sg)):
                halves = [tree(x.sum(axis=0), w.sum(axis=0), 2) for x, w in ((sg[:cut_at], sh[:cut_at]), (sg[cut_at:], sh[cut_at:]))]
                gain = sum(float(v @ x.sum(axis=0)) for v, x in zip(halves, (sg[:cut_at], sg[cut_at:])))
                if gain > best:
                    best = gain
                    step[:cut_at], step[cut_at:] = halves
            t += rate * step
            logit += rate * step[at_low[a], at_low[b]]
    return model


def _vectors(docs: DataFrame, *more: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([features(t).tolist() for t in b.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", *more)), x], ["doc_id", *more, "x"])

    small_batches(docs.sparkSession)
    return texts(docs, *more).mapInArrow(run, "doc_id long, " + "".join(f"{c} double, " for c in more) + "x array<double>")


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000) -> Model:
    """Fit on at most ``fit_rows`` labelled rows outside the held-out fold, those whose ids have the least hashes.

    Rows with a null label or id are passed over; of rows that repeat a doc_id the least features are taken, so that the
    driver gets a row for each sampled label at most. Without any labelled row every score is one half.
    """
    known = labels.select("doc_id", F.col("quality").cast("double").alias("label")).where(F.col("label").isNotNull() & (crc_fold() != 0))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(fit_rows)
    rows = _vectors(docs.select("doc_id", "text").join(F.broadcast(chosen.distinct()), "doc_id"), "label").groupBy("doc_id", "label").agg(F.min("x").alias("x")).orderBy("doc_id", "label", "x").collect()
    if not rows:
        return Model([np.empty(0)] * len(FEATURES), [np.empty(0)] * len(FEATURES), 0.0, [np.zeros(1)] * len(FEATURES), [])
    return fit(np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows]))


def score(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    A null text counts as empty and is scored like any other; a null doc_id is not held out; repeated rows get equal
    scores; an empty table gives no rows; other columns, labels among them, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t) for t in b.column("text").to_pylist()]
            s = model.scores(np.array(x)) if x else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    small_batches(docs.sparkSession)
    out = texts(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(crc_fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
