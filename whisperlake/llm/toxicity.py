"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A step's input is the sum of a hashed word vector and the mean of hashed vectors of all runs of three and four bytes of the
word, its edges marked. The network reads a text in segments of SEGMENT words, both ways. Attention pools the states of
every window of WINDOW words (stride 1), and the text's score is that of its worst window. Segments overlap by all but
PER words, so that each window lies in exactly one and shares its states with the windows beside it. Training picks
segments and a window in each: of a toxic text the one that the network finds worst, of a clean one any or the worst.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whisperlake.llm.common import crc_fold, small_batches, texts

WINDOW, SEGMENT = 32, 64
PER = SEGMENT - WINDOW + 1  # windows that begin in a segment
WORDS, GRAMS = 1 << 14, 1 << 14
E, H = 16, 8
WORD = re.compile(r"\w+")


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of three and four bytes of each word, its edges marked, one word after the other; and their numbers."""
    flat = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    own = np.repeat(np.arange(len(words)), sizes)
    parts, owners = [], []
    for n in (3, 4):
        m = max(0, len(flat) - n + 1)
        inside = own[:m] == own[n - 1 :][:m]
        h = np.full(m, n, np.uint32)
        for k in range(n):
            h = h * np.uint32(0x01000193) ^ flat[k : k + m]
        h ^= h >> np.uint32(15)
        parts.append((h * np.uint32(0x2C1B3C6D) >> np.uint32(8))[inside] % np.uint32(GRAMS))
        owners.append(own[:m][inside])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(parts)[order].astype(np.int32), np.bincount(owner, minlength=len(words))


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def summed(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by their places ``at``, 0..n-1."""
    return np.stack([np.bincount(at, v, n) for v in np.ascontiguousarray(values.T)], axis=1).astype(np.float32)


class Network:
    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        draw = lambda *s: (r.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"word": (0.1 * r.normal(size=(WORDS, E))).astype(np.float32), "gram": (0.3 * r.normal(size=(GRAMS, E))).astype(np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": draw(E, 3 * H), f"u{d}": draw(H, 3 * H), f"c{d}": np.zeros(3 * H, np.float32)}
        self.p |= {"a": draw(2 * H, H), "ab": np.zeros(H, np.float32), "v": draw(H), "o": draw(2 * H), "ob": np.zeros(1, np.float32)}
        self.scale = (1.0, 0.0)  # of the worst window's logit, fitted last

    def vectors(self, ids: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Inputs of words: their hashed ids, and their runs one after the other with the number of each."""
        out, some = self.p["word"][ids], np.flatnonzero(counts)
        if len(some):
            first = np.cumsum(counts) - counts
            out[some] += np.add.reduceat(self.p["gram"][flat], first[some], axis=0) / counts[some, None]
        return out

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (windows, steps, H) from gate inputs x (windows, steps, 3H) of one direction; padding keeps the state."""
        u, h = self.p[f"u{d}"], np.zeros((len(x), H), np.float32)
        out = np.empty((len(x), x.shape[1], H), np.float32)
        for t in range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1):
            g = h @ u
            zr = sigmoid(x[:, t, : 2 * H] + g[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            n = np.tanh(x[:, t, 2 * H :] + r * g[:, 2 * H :])
            new = np.where(mask[:, t, None], n + z * (h - n), h)
            if keep is not None:
                keep.append((t, h, z, r, n, g[:, 2 * H :]))
            h = new
            out[:, t] = h
        return out

    def gates(self, vectors: np.ndarray) -> np.ndarray:
        return np.concatenate([vectors @ self.p["wf"] + self.p["cf"], vectors @ self.p["wb"] + self.p["cb"]], axis=1)

    def logits(self, gates: np.ndarray, mask: np.ndarray, window: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Of segments, ``mask`` telling words from padding, and for each the words of the window that is pooled."""
        steps: dict = {"f": [], "b": []}
        s = np.concatenate([self._run(gates[..., : 3 * H], mask, "f", steps["f"] if keep is not None else None), self._run(gates[..., 3 * H :], mask, "b", steps["b"] if keep is not None else None)], axis=2)
        a = np.tanh(s @ self.p["a"] + self.p["ab"])
        e = np.where(window, a @ self.p["v"], -1e4)
        e = np.exp(e - e.max(axis=1, keepdims=True)) * window
        w = e / np.maximum(e.sum(axis=1, keepdims=True), 1e-9)
        c = (s * w[..., None]).sum(axis=1)
        if keep is not None:
            keep |= {"steps": steps, "s": s, "a": a, "w": w, "c": c}
        return c @ self.p["o"] + self.p["ob"][0]

    def gradients(self, vec: np.ndarray, at: np.ndarray, mask: np.ndarray, window: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray]:
        """Mean logistic loss's gradients, by parameter and by row of vec, for segments of rows ``at`` of vec."""
        k: dict = {}
        gates = self.gates(vec)[at]
        d = ((sigmoid(self.logits(gates, mask, window, k)) - y) / len(y)).astype(np.float32)
        p, g = self.p, {}
        g["ob"], g["o"] = d.sum(keepdims=True), d @ k["c"]
        dc = d[:, None] * p["o"]
        ds = dc[:, None, :] * k["w"][..., None]
        dw = (k["s"] * dc[:, None, :]).sum(axis=2)
        de = k["w"] * (dw - (dw * k["w"]).sum(axis=1, keepdims=True))
        g["v"] = np.einsum("bt,bth->h", de, k["a"])
        da = de[..., None] * p["v"] * (1 - k["a"] ** 2)
        g["a"], g["ab"] = np.einsum("bts,bth->sh", k["s"], da), da.sum(axis=(0, 1))
        ds = ds + da @ p["a"].T
        dgate = np.zeros_like(gates)
        for n_, (d_, off) in enumerate((("f", 0), ("b", H))):
            u = p[f"u{d_}"]
            gu, dh = np.zeros_like(u), np.zeros((len(y), H), np.float32)
            for t, h, z, r, n, gn in reversed(k["steps"][d_]):
                dh = dh + ds[:, t, off : off + H]
                m = mask[:, t, None]
                dn = dh * (1 - z) * (1 - n * n) * m
                dz = dh * (h - n) * z * (1 - z) * m
                dr = dn * gn * r * (1 - r)
                dg = np.concatenate([dz, dr, dn * r], axis=1)
                gu += h.T @ dg
                dgate[:, t, 3 * H * n_ : 3 * H * (n_ + 1)] = np.concatenate([dz, dr, dn], axis=1)
                dh = np.where(m, dh * z, dh) + dg @ u.T
            g[f"u{d_}"] = gu
        rows = summed(at.ravel(), dgate.reshape(-1, 6 * H), len(vec))
        dvec = np.zeros_like(vec)
        for n_, d_ in enumerate("fb"):
            part = rows[:, 3 * H * n_ : 3 * H * (n_ + 1)]
            g[f"w{d_}"], g[f"c{d_}"] = vec.T @ part, part.sum(axis=0)
            dvec += part @ p[f"w{d_}"].T
        return g, dvec


class Lexicon(dict):
    """Words met so far, by row, row 0 being padding; ``new`` holds those whose inputs are still to be made."""

    def __init__(self):
        super().__init__({"": 0})
        self.new: list[bytes] = [b""]

    def __missing__(self, w: str) -> int:
        self[w] = k = len(self)
        self.new.append(w.encode("utf-8", "replace"))
        return k

    def __call__(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def inputs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashed id, runs and number of runs of each new word; padding has none. Then no word is new."""
        ids = np.array([1 + zlib.crc32(w) % (WORDS - 1) if w else 0 for w in self.new])
        parts = [grams(self.new[k : k + 8192]) for k in range(0, len(self.new), 8192)] or [grams([])]
        self.new = []
        return ids, np.concatenate([f for f, _ in parts]), np.concatenate([c for _, c in parts])


def segments(rows: np.ndarray) -> np.ndarray:
    """The segments of one text's words, padded with 0: (segments, SEGMENT). A text without words has one, empty."""
    last = max(0, len(rows) - WINDOW)
    first = np.arange(0, last + 1, PER)
    padded = np.append(rows, np.zeros(first[-1] + SEGMENT - len(rows), np.int64)) if first[-1] + SEGMENT > len(rows) else rows
    return padded[first[:, None] + np.arange(SEGMENT)]


def inference_table(net: Network, ids: np.ndarray, flat: np.ndarray, counts: np.ndarray, chunk: int = 8192) -> np.ndarray:
    """Gate inputs of words, a few at a time, with those of n doubled, as infer() wants them: tanh(x) is then 2 * sigmoid(.) - 1, which is cheaper."""
    out, edge = np.empty((len(ids), 6 * H), np.float32), np.append(0, np.cumsum(counts))
    for k in range(0, len(ids), chunk):
        z = min(k + chunk, len(ids))
        out[k:z] = net.gates(net.vectors(ids[k:z], flat[edge[k] : edge[z]], counts[k:z]))
    out[:, 2 * H : 3 * H] *= 2
    out[:, 5 * H :] *= 2
    return out


def infer(net: Network, table: np.ndarray, segs: np.ndarray, chunk: int = 1024) -> np.ndarray:
    """Logits of all windows of segments, (segments, PER), -inf where none begins; both directions in one pass, steps first."""
    # columns z, r, n, each of H forward and H backward
    u = np.zeros((2 * H, 6 * H), np.float32)
    for k in range(3):
        u[:H, 2 * k * H : (2 * k + 1) * H] = net.p["uf"][:, k * H : (k + 1) * H] * (2 if k == 2 else 1)
        u[H:, (2 * k + 1) * H : (2 * k + 2) * H] = net.p["ub"][:, k * H : (k + 1) * H] * (2 if k == 2 else 1)
    two, p = 2 * H, net.p
    sizes = (segs > 0).sum(axis=1)
    out = np.full((len(segs), PER), -np.inf, np.float32)
    order = np.argsort(sizes, kind="stable")  # short segments go together, and need fewer steps
    for k in range(0, len(order), chunk):
        own = order[k : k + chunk]
        steps = max(WINDOW, int(sizes[own[-1]]))
        w = np.ascontiguousarray(segs[own, :steps].T)
        mask, padded = w > 0, sizes[own[0]] < steps
        n = len(own)
        h, states = np.zeros((n, two), np.float32), np.empty((steps, n, two), np.float32)
        for t in range(steps):
            x, g = np.empty((n, 3, 2, H), np.float32), h @ u
            x[:, :, 0] = table[w[t], : 3 * H].reshape(n, 3, H)
            x[:, :, 1] = table[w[steps - 1 - t], 3 * H :].reshape(n, 3, H)
            x = x.reshape(n, 6 * H)
            zr = x[:, : 2 * two] + g[:, : 2 * two]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            c = g[:, 2 * two :] * zr[:, two:]
            c += x[:, 2 * two :]
            np.negative(c, out=c)
            np.exp(c, out=c)
            c += 1
            np.divide(2, c, out=c)
            c -= 1
            new = h - c
            new *= zr[:, :two]
            new += c
            if padded:
                new[:, :H] = np.where(mask[t][:, None], new[:, :H], h[:, :H])
                new[:, H:] = np.where(mask[steps - 1 - t][:, None], new[:, H:], h[:, H:])
            h = new
            states[t, :, :H] = h[:, :H]
            states[steps - 1 - t, :, H:] = h[:, H:]
        a = states @ (2 * p["a"])
        a += 2 * p["ab"]
        np.negative(a, out=a)
        np.exp(a, out=a)
        a += 1
        np.divide(2, a, out=a)
        a -= 1
        e = np.exp(np.clip(a @ p["v"], -40, 40)) * mask
        over, under = e * (states @ p["o"]), e
        size = 1
        while size < WINDOW:  # sums over 1, 2, 4, .. words from each on, so that no window's sum is a difference
            over, under = over[size:] + over[:-size], under[size:] + under[:-size]
            size *= 2
        logit = (over / np.maximum(under, 1e-30)).T + p["ob"][0]
        begins = np.arange(logit.shape[1])[None, :] <= np.maximum(0, sizes[own] - WINDOW)[:, None]
        part = np.full((n, PER), -np.inf, np.float32)
        part[:, : logit.shape[1]] = np.where(begins, logit, -np.inf)
        out[own] = part
    return out


def fit(samples: list[tuple[str, float]], rounds: int = 6, least_steps: int = 200, batch: int = 128, rate: float = 0.01, seed: int = 5) -> Network:
    """Train on (text, label); with no samples, or of one class only, the scores are near that class."""
    net, r, lexicon = Network(), np.random.default_rng(seed), Lexicon()
    if not samples:
        return net
    segs = [segments(lexicon(words_of(t))) for t, _ in samples]
    y = np.array([v for _, v in samples], np.float32)
    first = np.concatenate([[0], np.cumsum([len(w) for w in segs])])
    every = np.concatenate(segs)
    ids, flat, counts = lexicon.inputs()
    starts = np.cumsum(counts) - counts
    m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    tick = 0

    def top() -> tuple[np.ndarray, np.ndarray]:
        """Each text's worst window, as segment * PER + its place there, and its logit."""
        v = infer(net, inference_table(net, ids, flat, counts), every)
        best = np.array([a * PER + int(v[a:z].argmax()) for a, z in zip(first, first[1:])])
        return best, v.ravel()[best]

    # both classes weigh alike: the rarer one is drawn more often
    pos, neg = np.flatnonzero(y > 0), np.flatnonzero(y <= 0)
    # few samples make few batches, so they go round more often
    rounds = max(rounds, -(-least_steps * batch // (2 * max(len(pos), len(neg)))))
    best, again = None, max(1, rounds // 24)  # worst windows are looked for anew 16 times, or each round if there are fewer
    for turn in range(rounds):
        if turn >= rounds // 3 and (turn - rounds // 3) % again == 0:
            best = top()[0]
        size = max(len(pos), len(neg))
        order = np.concatenate([r.choice(c, size) for c in (pos, neg) if len(c)])
        r.shuffle(order)
        for k in range(0, len(order), batch):
            docs = order[k : k + batch]
            seg = first[docs] + (r.random(len(docs)) * (first[docs + 1] - first[docs])).astype(np.int64)
            pick = seg * PER + (r.random(len(docs)) * (1 + np.clip((every[seg] > 0).sum(axis=1) - WINDOW, 0, PER - 1))).astype(np.int64)
            if best is not None:
                pick = np.where((y[docs] > 0) | (r.random(len(docs)) < 0.5), best[docs], pick)
            seg, begin = np.divmod(pick, PER)
            rows = every[seg]
            window = (rows > 0) & (np.arange(SEGMENT) >= begin[:, None]) & (np.arange(SEGMENT) < begin[:, None] + WINDOW)
            used, at = np.unique(rows, return_inverse=True)
            own = counts[used]
            runs = flat[np.repeat(starts[used] - (np.cumsum(own) - own), own) + np.arange(own.sum())]
            g, dvec = net.gradients(net.vectors(ids[used], runs, own), at.reshape(rows.shape), rows > 0, window, y[docs])
            tick += 1
            step = rate * (0.5 if turn > rounds // 2 else 1.0)
            _adam(net, m, g, step, tick)
            _sparse(net.p["word"], m["word"], ids[used], dvec, step)
            if len(runs):
                _sparse(net.p["gram"], m["gram"], runs, np.repeat(dvec / np.maximum(1, own)[:, None], own, axis=0), step)
    logit = top()[1].astype(np.float64)
    a, b = 1.0, 0.0
    for _ in range(200):  # scale the worst window's logit to the labels as they are, with a weak pull to (1, 0)
        q = sigmoid(a * logit + b)
        w = q * (1 - q) + 1e-6
        g0, g1 = (y - q).sum() - b, ((y - q) * logit).sum() - (a - 1)
        h00, h01, h11 = w.sum() + 1, (w * logit).sum(), (w * logit * logit).sum() + 1
        det = h00 * h11 - h01 * h01
        b, a = b + 0.5 * (h11 * g0 - h01 * g1) / det, a + 0.5 * (h00 * g1 - h01 * g0) / det
    net.scale = (float(max(a, 0.05)), float(b))
    return net


def _adam(net: Network, m: dict, grads: dict, rate: float, tick: int) -> None:
    for k, g in grads.items():
        one, two = m[k]
        one += 0.1 * (g - one)
        two += 0.01 * (g * g - two)
        net.p[k] -= (rate * (one / (1 - 0.9**tick)) / (np.sqrt(two / (1 - 0.99**tick)) + 1e-7)).astype(np.float32)


def _sparse(table: np.ndarray, m: list, rows: np.ndarray, grads: np.ndarray, rate: float) -> None:
    """Adagrad on the rows that occur."""
    own, at = np.unique(rows, return_inverse=True)
    g = summed(at, grads, len(own))
    m[1][own] += g * g
    table[own] -= 5 * rate * g / (np.sqrt(m[1][own]) + 1e-7)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> Network:
    """Fit on at most ``per_class`` rows of each label outside the held-out fold, those whose ids have the least hashes.

    Of rows that repeat a doc_id the least text is taken, so that the driver gets a row for each sampled label at most.
    """
    known = labels.select("doc_id", F.col("toxic").cast("double").alias("label")).where(F.col("label").isNotNull() & (crc_fold() != 0))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = known.where("label > 0").orderBy(*order).limit(per_class).unionByName(known.where("label <= 0").orderBy(*order).limit(per_class))
    rows = texts(docs).join(F.broadcast(chosen.distinct()), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).orderBy("doc_id", "label").collect()
    net = fit([(r["text"], r["label"]) for r in rows])
    # the sample evens out the classes; the scale's constant is put back by their shares
    seen = {True: 0, False: 0}
    for r in rows:
        seen[r["label"] > 0] += 1
    whole = {r["toxic"]: r["n"] for r in known.groupBy((F.col("label") > 0).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if all(seen.values()) and all(whole.get(k) for k in seen):
        net.scale = (net.scale[0], net.scale[1] + float(np.log(whole[True] / seen[True]) - np.log(whole[False] / seen[False])))
    return net


class Scorer:
    """A trained network with the gate inputs of the words met so far, up to ``most`` words."""

    def __init__(self, net: Network, most: int = 300_000):
        self.net, self.most = net, most
        self._clear()

    def _clear(self) -> None:
        self.lexicon = Lexicon()
        self.table, self.done = np.zeros((1024, 6 * H), np.float32), 0

    def __call__(self, batch: list[str]) -> np.ndarray:
        """The texts' scores."""
        if not batch:
            return np.zeros(0)
        segs = [segments(self.lexicon(words_of(t))) for t in batch]
        n = len(self.lexicon)
        if n > len(self.table):
            self.table = np.concatenate([self.table[: self.done], np.zeros((max(n, 2 * self.done) - self.done, 6 * H), np.float32)])
        if self.lexicon.new:
            self.table[self.done : n] = inference_table(self.net, *self.lexicon.inputs())
            self.done = n
        top = np.full(len(batch), -np.inf)
        own = np.repeat(np.arange(len(batch)), [len(x) for x in segs])
        every = np.concatenate(segs)
        for k in range(0, len(every), 1 << 15):  # a long text has too many segments to hold all of their windows at once
            np.maximum.at(top, own[k : k + (1 << 15)], infer(self.net, self.table, every[k : k + (1 << 15)]).max(axis=1))
        if n > self.most:
            self._clear()
        return sigmoid(np.clip(self.net.scale[0] * top + self.net.scale[1], -30, 30))


def score(docs: DataFrame, net: Network, least: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    A null or empty text has one empty window and is scored by it; a null doc_id is not held out; repeated rows get equal
    scores; an empty table gives no rows; other columns, labels among them, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for b in batches:
            s = scorer(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.round(s.astype(np.float64), 6))], ["doc_id", "score"])

    small_batches(docs.sparkSession)
    out = texts(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(crc_fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose text is predicted toxic.

    Each row is judged by its own text, where it stands: nothing is shuffled, and null or repeated doc_ids make no
    difference. A null text counts as empty; columns and texts stay as they are; an empty table gives no rows.
    """
    net = train(docs, labels)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(net)
        for t in batches:
            yield pd.Series(np.round(scorer(t.tolist()), 6))

    small_batches(docs.sparkSession)
    return docs.where(scores(F.coalesce(F.col("text"), F.lit(""))) < least)
