"""Phrases, nearest neighbours and ranked search against brute force, and on odd rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from whisperlake.llm import nearest, phrases, ranking
from whisperlake.llm.common import table
from whisperlake.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, phrase string, a string, n string"
LONG = "word " * 30_000 + "end."
ODD = [(1, None, "en"), (2, "", "en"), (3, "  \n\t ", None), (4, LONG, "en"), (5, "a", "und"), (6, "a b", None), (7, "Éa, b! c? d.\nE f", "fr"), (7, "Éa, b! c? d.\nE f", "fr"), (8, LONG, "en"), (None, "a b a b", None), (9, "x\0y ퟿ z", "de")]
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, lang, "p", "a", "n") for i, t, lang in ODD], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# 11


def plain_phrases(rows, least, longest=5, top=2000):
    counts = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts["und" if lang is None else lang][tuple(words[i : i + k])] += 1
    out = set()
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        wanted = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        scored = []
        for p, a in wanted.items():
            cuts = [(1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = any(100 * b >= 100 * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in wanted.items())
            if not inside:
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n, -score))
    return out


def found_phrases(df):
    return {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


def made_texts(seed, n):
    r = random.Random(seed)
    stock = ["new york city", "New York", "ice cream", "à la carte", "a a a a a a a", "machine learning model", "of the"]
    mark = lambda: r.choice([" ", " ", "  ", "\t", ". ", ", ", "\n", "! "])
    text = lambda: "".join(r.choice([*stock, "x", "y", "zz", "É", "of", "the", f"w{r.randint(0, 30)}"]) + mark() for _ in range(r.randint(0, 40)))
    return [(k, text(), r.choice(["en", "fr", None])) for k in range(n)]


@pytest.mark.parametrize("share, lowered", [(4, 0.5), (1, 1.0), (1000, 1.0)])
def test_phrases_against_brute_force(spark, share, lowered):
    """Whatever the sample proposes: a fair share, all there is, or nothing at all, when border failures bring everything."""
    rows = made_texts(7, 150)
    docs = spark.createDataFrame([(*r, "p", "a", "n") for r in rows], DOCS).repartition(3)
    passes = []
    got = found_phrases(phrases.collocations(docs, least=6, share=share, lowered=lowered, passes=passes))
    assert got == plain_phrases([r[1:] for r in rows], 6)
    assert passes[-1] == 0 and (len(passes) == 1 if share == 1 else len(passes) > 1)


def test_border_failures_bring_longer_phrases(spark):
    """A phrase of five words that the sample never shows is found, though none of its parts was proposed."""
    rows = [(k, "only here is this said", "en") for k in range(20)]
    found = found_phrases(phrases.collocations(spark.createDataFrame([(*r, "p", "a", "n") for r in rows], DOCS), least=20, share=10**6))
    assert found == plain_phrases([r[1:] for r in rows], 20) == {("en", 1, "only here is this said", 20, 20, 20, 100, 5000)}


def test_phrase_ranks_are_cut_and_exact(spark):
    rows = made_texts(9, 80)
    docs = spark.createDataFrame([(*r, "p", "a", "n") for r in rows], DOCS)
    got = found_phrases(phrases.collocations(docs, least=3, top=4, longest=3))
    assert got == plain_phrases([r[1:] for r in rows], 3, 3, 4)


def test_scores_beyond_64_bits(spark):
    shape = phrases.ROWS + ", h long"
    big = 10**12
    rows = [(0, 0, 0, 4 * big, "en", None, 0), (1, 0, 1, big, "en", "x", 1), (1, 0, 2, 2 * big + 1, "en", "y", 2), (2, 1, 2, big - 7, None, None, 3)]
    got = phrases._ranked(spark.createDataFrame(rows, shape), 5, 10).collect()
    assert [(r.phrase, r.a, r.score) for r in got] == [("x y", big - 7, 1000 * (big - 7) * 4 * big // (big * (2 * big + 1)))]


def test_phrases_of_odd_rows(spark, odd, empty):
    got = found_phrases(phrases.collocations(odd, least=2))
    assert got == plain_phrases([(t, lang) for _, t, lang in ODD], 2)
    assert ("und", 1, "a b", 3, 4, 3, 7, 1750) in got  # three rows, one of which says it twice, and lang null is und
    assert phrases.collocations(empty).count() == 0


# 12


def product(a, b):
    """Added up in order; sum() of Python compensates."""
    out = 0.0
    for x, y in zip(a.tolist(), b.tolist()):
        out += x * y
    return out


def plain_nearest(rows, chosen, k):
    fine = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for at, (i, q) in enumerate(fine):
        if chosen(i):
            others = [(-product(q, v), j is None, j or 0) for n, (j, v) in enumerate(fine) if n != at and len(v) == len(q)]
            out.setdefault(i, []).append([(rank, None if none else j, -s) for rank, (s, none, j) in enumerate(sorted(others)[:k], 1)])
    return out


def found_nearest(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.query_id].append((r["rank"], r.vec_id, r.score))
    return {k: sorted(v, key=lambda x: x[0]) for k, v in out.items()}


VECTORS = "vec_id long, embedding array<float>, score string, rank string"


def made_vectors(seed, n, dim=12):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(9, dim)) * r.uniform(0.2, 5, (9, 1))
    x = (centres[r.integers(0, 9, n)] + 0.2 * r.normal(size=(n, dim))).astype(np.float32)
    x[: n // 4] = x[r.integers(0, 5, n // 4)]  # many copies of few
    x[n // 4 : n // 3] = np.round(x[n // 4 : n // 3])  # and ties of unlike vectors
    return [(k, [float(v) for v in row]) for k, row in enumerate(x)]


def test_nearest_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nearest, "SHARD", 64)
    monkeypatch.setattr(nearest, "QUERIES", 16)
    monkeypatch.setattr(nearest, "LEAF", 8)
    rows = made_vectors(3, 500)
    df = spark.createDataFrame([(i, v, "s", "r") for i, v in rows], VECTORS).repartition(3)
    got = found_nearest(nearest.nearest(df, F.col("vec_id") % 7 == 0, 10))
    want = plain_nearest(rows, lambda i: i % 7 == 0, 10)
    assert {k: [v] for k, v in got.items()} == want and len(got) == 72


def test_a_factor_trades_recall_for_work():
    """In one tree: factor one gives all, a larger one takes fewer products and keeps most."""
    rows = made_vectors(5, 4000, 16)
    x = np.unique(np.array([v for _, v in rows]), axis=0)
    most = float(np.sqrt((x * x).sum(axis=1).max())) * (1 + nearest.SLACK)
    tree, q, ids = nearest.Tree(x, most, 32), x[::40], np.arange(len(x))
    want = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :10]
    taken, recall = [], []
    for factor in (1.0, 1.05, 1.3):
        a, b, _, n = nearest.search(tree, x, ids, q, np.full(len(q), -np.inf), 10, factor)
        hits = sum(len(set(b[a == k]) & set(want[k])) for k in range(len(q)))
        taken.append(n)
        recall.append(hits / want.size)
    assert taken[0] < len(q) * len(x) and taken[2] < taken[1] < taken[0]
    assert recall[0] == 1 and recall[1] > 0.95 > recall[2]


def test_nearest_on_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, [1.0, 2.0]), (20, [2.0, 0.0]), (None, [3.0, 3.0]), (None, [0.5, 0.5]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
            (40, [5.0]), (7, [-1.0, -0.0]), (8, [-1.0, 0.0]), (60, [1.0, 1.0, 1.0]), (9, [3e38, 3e38])]
    df = spark.createDataFrame([(i, v, "s", "r") for i, v in rows], VECTORS)
    want = plain_nearest([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], lambda i: i is not None and i % 20 == 0, 20)
    got = defaultdict(list)
    for r in nearest.nearest(df, F.col("vec_id") % 20 == 0, 20).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert {k: sorted(v, key=repr) for k, v in got.items()} == {k: sorted((x for one in v for x in one), key=repr) for k, v in want.items() if any(v)}
    assert 40 not in got and 60 not in got  # nothing else has their length
    assert nearest.nearest(df.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0
    assert nearest.nearest(df.where("embedding is null"), F.col("vec_id") >= 0, 20).count() == 0


def test_nearest_query_recall(spark):
    """The registered query against brute force over a driver's table."""
    rows = pq.read_table("/root/testdata/sf0.01/embeddings.parquet").to_pydict()
    got = found_nearest(QUERIES["op12_nearest"](spark, "/root/testdata/sf0.01"))
    x = np.array(rows["embedding"], float)
    sums = x @ x.T
    np.fill_diagonal(sums, -np.inf)
    for k, i in enumerate(rows["vec_id"]):
        if i % 20 == 0:
            assert [v for _, v, _ in got[i]] == [rows["vec_id"][j] for j in np.argsort(-sums[k], kind="stable")[:20]]


# 13


def plain_ranking(docs, items, k):
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    terms = [(i, re.findall(pattern, t.translate(LOWER))) for i, t in docs if t is not None]
    terms = [(i, Counter(t)) for i, t in terms if t]
    n_docs, n_all = len(terms), sum(sum(t.values()) for _, t in terms)
    df = Counter(w for _, t in terms for w in t)
    out = []
    for item, text in items:
        found = []
        for i, t in terms:
            n = sum(t.values())
            m = 10 + (90 * n * n_docs) // n_all
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * t[w]) // (1000 * t[w] + 8 * m)) for w in set(re.findall(pattern, (text or "").translate(LOWER))) if w in t)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def found_ranking(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


RANKED = "doc_id long, text string, score string, rank string, item_id string"


@pytest.mark.parametrize("shard", [16, 100_000])
def test_ranking_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(ranking, "SHARD_DOCS", shard)
    r = random.Random(11)
    word = lambda: f"W{min(int(r.expovariate(0.05)), 200)}"
    docs = [(k, " ".join(word() for _ in range(r.randint(0, 60)))) for k in range(400)] + [(k, "W1 w2 É_x W3") for k in range(400, 420)]
    items = [(k, " ".join(word() for _ in range(r.randint(0, 25))) + " É-X") for k in range(12)] + [(99, None), (98, "___ nowhere")]
    df = spark.createDataFrame([(i, t, "s", "r", "x") for i, t in docs], RANKED).repartition(4)
    got = found_ranking(ranking.search(df, spark.createDataFrame(items, "item_id long, text string"), 10))
    assert got == plain_ranking(docs, items, 10)


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK_TERMS", 5)
    docs = [(k, f"a{k % 5} b{k % 3} c") for k in range(30)]
    items = [(k, f"a{k} b{k} zz c") for k in range(9)]
    df = spark.createDataFrame([(i, t, "s", "r", "x") for i, t in docs], RANKED)
    assert found_ranking(ranking.search(df, spark.createDataFrame(items, "item_id long, text string"), 4)) == plain_ranking(docs, items, 4)


def test_pairs_tighten_bounds_and_skip_more():
    """Two heavy terms that hardly meet: their pair's bound is far below the sum, and fewer postings are read for the same result."""
    r = np.random.default_rng(2)
    n = 4000
    terms = {0: np.arange(0, n, 2), 1: np.arange(1, n, 2), 2: np.sort(r.choice(n, 60, replace=False)), 3: np.arange(n)}
    terms[0] = np.sort(np.append(terms[0], 5))  # they meet once, weakly
    place, term, score = [], [], []
    for t, p in terms.items():
        place.append(p)
        term.append(np.full(len(p), t))
        score.append({0: r.integers(500, 1000, len(p)), 1: r.integers(500, 1000, len(p)), 2: r.integers(1000, 1400, len(p)), 3: r.integers(1, 20, len(p))}[t])
    score[0][np.searchsorted(terms[0], 5)] = score[1][np.searchsorted(terms[1], 5)] = 3
    args = np.arange(n), np.ones(n, bool), np.concatenate(place), np.concatenate(term), np.concatenate(score)
    pairs = [(0, 1), (0, 2), (1, 2)]
    shard, plain = ranking.Shard.build(*args, pairs), ranking.Shard.build(*args, [])
    assert shard.bounds([3, 0, 1], pairs)[-1] < plain.bounds([3, 0, 1], [])[-1]
    sums = np.bincount(args[2], args[4], n).astype(np.int64)
    want = sorted(zip((-sums).tolist(), range(n)))[:10]
    for one, own in ((shard, pairs), (plain, [])):
        places, scores = one.best([0, 1, 2, 3], own, 0, 10)
        assert list(zip((-scores).tolist(), places.tolist())) == want
    assert shard.opened < 0.6 * plain.opened
    # every bound holds for every document
    for own in ([0, 1], [3, 0], [3, 0, 1, 2]):
        most = shard.bounds(own, pairs)
        for k in range(len(own) + 1):
            assert max(np.bincount(args[2][np.isin(args[3], own[:k])], args[4][np.isin(args[3], own[:k])], n), default=0) <= most[k]
    again = ranking.Shard.unpacked(dict(zip([c.split()[0] for c in ranking.INDEX.split(", ")], shard.packed(7))))
    assert [v.tolist() for v in again.best([0, 1, 2, 3], pairs, 0, 10)] == [v.tolist() for v in shard.best([0, 1, 2, 3], pairs, 0, 10)]


def test_ranking_on_odd_rows(spark):
    docs = [(i, t) for i, t, _ in ODD] + [(None, "b a"), (20, "b A"), (3, "a_b")]
    items = [(1, "a"), (1, "a"), (None, "b é"), (2, None), (3, LONG), (4, "...")]
    df = spark.createDataFrame([(i, t, "s", "r", "x") for i, t in docs], RANKED)
    asked = spark.createDataFrame([(i, t, "d") for i, t in items], "item_id long, text string, doc_id string")
    assert found_ranking(ranking.search(df, asked, 3)) == plain_ranking(docs, items, 3)
    assert ranking.search(df.limit(0), asked, 3).count() == ranking.search(df, asked.limit(0), 3).count() == 0


def test_ranking_query(spark):
    d, b = (pq.read_table(f"/root/testdata/sf0.001/{t}.parquet").to_pydict() for t in ("documents", "benchmark"))
    got = found_ranking(QUERIES["op13_ranking"](spark, "/root/testdata/sf0.001"))
    assert got == plain_ranking(list(zip(d["doc_id"], d["text"])), list(zip(b["item_id"], b["text"])), 10)


def test_phrases_query(spark):
    d = table(spark, "/root/testdata/sf0.001", "documents").toPandas()
    assert found_phrases(QUERIES["op11_phrases"](spark, "/root/testdata/sf0.001")) == plain_phrases(list(zip(d["text"], d["lang"])), 100)
