"""Every query with SQL against DuckDB over the smallest tables, and invariants between queries."""

import math
import numbers
import os
import random
from collections import Counter

import duckdb
import pandas as pd
import pytest

from whisperlake import jobs_library, library, streams_library
from whisperlake.fixtures import Views, with_views
from whisperlake.operators import propagation


assert jobs_library and streams_library  # their queries are the library's


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir("/root/testdata/sf0.001"):
        c.execute(f"create view {f[:-8]} as select * from '/root/testdata/sf0.001/{f}'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def text(x):
        if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return "-"
        return repr(round(float(x), 9)) if isinstance(x, numbers.Number) and not isinstance(x, bool) else str(x)

    return sorted(tuple(text(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(library.SQL))
def test_matches_sql(spark, duck, data, name):
    df = library.QUERIES[name](spark, data)
    found = pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns)
    wanted = duck.execute(library.SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


@pytest.mark.parametrize("name", sorted(set(library.QUERIES) - set(library.SQL)))
def test_runs(spark, data, name):
    df = library.QUERIES[name](spark, data)
    assert df.columns
    df.collect()


def test_fanout_and_originated_agree(spark, data):
    v = Views(spark, data)
    args = (v.timings, v.metadata, v.message_first_seen, v.owned)
    total = propagation.fanout(*args, cutoff=1).agg({"qualifying": "sum"}).first()[0] or 0
    assert total == propagation.originated_propagation(*args, cutoff=1).first()["qualifying_messages"]


def test_sketches_are_close(spark):
    v = Views(spark, "/root/testdata/sf0.01")
    from pyspark.sql import functions as F

    from whisperlake.operators import rollups

    near = rollups.message_rate_rollup(v.timings, v.metadata).groupBy("type").agg(F.hll_sketch_estimate(F.hll_union_agg("outer_hll")).alias("n"))
    exact = v.timings.where("dir = 1").join(v.metadata.where("type in (1,2,3)"), "hash").groupBy("type").agg(F.countDistinct(v.timings["hash"]).alias("m"))
    for r in near.join(exact, "type").collect():
        assert abs(r["n"] - r["m"]) <= max(1, 0.03 * r["m"])


def test_merged_sketches_rank_errors(spark):
    """Quantiles over two hours with thousands of receipts: the share of delays below each is near the rank asked for."""
    from pyspark.sql import functions as F

    from whisperlake.operators import rollups

    t = spark.range(60_000).select((F.col("id") % 3).alias("hash"), F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.pmod(F.xxhash64("id"), F.lit(7_000_000_000))).alias("net_timestamp"), F.lit(1).alias("dir"), F.lit(None).cast("timestamp").alias("orig_timestamp"))
    m = spark.createDataFrame([(k, 1, None, 5) for k in range(3)], "hash long, type int, orig_node string, scid long")
    rows = {r["hash"]: r for r in rollups.propagation_from_sketch(rollups.propagation_rollup(t, m), 2).collect()}
    first = t.groupBy("hash").agg(F.min("net_timestamp").alias("f"))
    delays = t.join(first, "hash").select("hash", ((F.unix_micros("net_timestamp") - F.unix_micros("f")) / 1e6).alias("d"))
    for k in range(3):
        assert rows[k]["receipts"] == 20_000
        for p in (5, 25, 50, 75, 95):
            share = delays.where((F.col("hash") == k) & (F.col("d") <= rows[k][f"p{p:02d}"])).count() / 20_000
            assert abs(share - p / 100) < 0.02


def test_views_hold_every_row(spark, duck, data):
    v = Views(spark, data)
    for view, source in (("channels", "orders"), ("chan_views", "lineitem")):
        n = duck.execute(f"select count(*) from {source}").fetchone()[0]
        assert getattr(v, view).count() == n
        assert duck.execute(with_views(f"SELECT count(*) FROM {view}")).fetchone()[0] == n


def test_components_take_less_each_round(spark, monkeypatch):
    """Stars kept every node in every round; nodes without a name and those with loops only are told apart from others."""
    from whisperlake.operators import components, graph

    rows, plain = [], components.written

    def counted(df, name, *more):
        found = plain(df, name, *more)
        rows.append((name, found.count()))
        return found

    monkeypatch.setattr(components, "written", counted)
    pairs = [(f"c{k}", f"c{k + 1}") for k in range(999)] + [("x", "y"), ("y", "x"), ("z", "z"), ("w", None)]
    edges = spark.createDataFrame([(k, a, b, 1) for k, (a, b) in enumerate(pairs)], "scid long, src string, dst string, capacity long")
    got = graph.graph_stats(edges).first()
    assert (got.edges, got.nodes, got.components, got.largest) == (1003, 1005, 4, 1000)
    found = [n for name, n in rows if name == "edges"]
    assert sum(found) < 2 * found[0] and found[-1] == 0
    named = {(r.pubkey, r.component, r["size"]) for r in graph.components_of(edges).collect()}
    assert named == {(f"c{k}", "c0", 1000) for k in range(1000)} | {("x", "x", 2), ("y", "x", 2), ("z", "z", 1), ("w", "w", 1)}
    got = graph.graph_stats(edges.where("src = 'z' or src is null")).first()
    assert (got.nodes, got.components, got.largest) == (1, 1, 1)
    assert graph.graph_stats(edges.limit(0)).first()[:2] == (0, 0)


def test_components_against_brute_force(spark):
    """The whole channel view is one component, so several are tried by hand."""
    from whisperlake.operators import graph

    r = random.Random(9)
    pairs = [(f"c{a}", f"c{a + r.randint(0, 3)}") for a in r.sample(range(200), 90)]
    edges = spark.createDataFrame([(k, a, b, 1) for k, (a, b) in enumerate(pairs)], "scid long, src string, dst string, capacity long")
    root = {n: n for pair in pairs for n in pair}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    size = Counter(root.values())
    assert len(size) > 5
    assert {(x.pubkey, x.component, x["size"]) for x in graph.components_of(edges).collect()} == {(n, c, size[c]) for n, c in root.items()}
