"""Jobs and operators that must hold where tables, groups and graphs are large, against brute force or a plain form."""

import datetime as dt
import json
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from whisperlake import library, streams_library
from whisperlake.fixtures import Views
from whisperlake.operators import attribution, bitmaps, distances, graph, held, legacy, propagation, quantiles, refresh
from whisperlake.sources import files, json_array, keyed
from whisperlake.streaming import ingest, metrics, state

assert streams_library  # it adds its queries to the library's

AT = dt.datetime(2024, 1, 1)


def at(minutes: float) -> dt.datetime:
    return AT + dt.timedelta(minutes=minutes)


# Keyed tables


def test_only_folders_whose_filter_says_maybe_are_opened(spark, tmp_path):
    path = str(tmp_path / "keys")
    rows = lambda a, b: spark.range(a, b).select((F.col("id") * 7919).alias("hash"), F.col("id").alias("n"))
    for k in range(6):
        assert keyed.insert_if_absent(rows(1000 * k, 1000 * k + 1000), path, "hash") <= 2  # a filter is wrong for about one key in 1e6 here
    folders = 6 * keyed.BUCKETS
    assert sum(1 for _ in (tmp_path / "keys").glob("key_batch=*/key_bucket=*")) == folders
    one = spark.createDataFrame([(3 * 7919, -1)], "hash long, n long")
    assert keyed.insert_if_absent(one, path, "hash") == 1  # the one folder that holds it
    old = rows(2000, 2100)
    assert keyed.insert_if_absent(old, path, "hash") <= keyed.BUCKETS  # one batch's folders, of six
    assert keyed.insert_if_absent(rows(5990, 6010), path, "hash") <= keyed.BUCKETS
    got = keyed.read_keyed(spark, path)
    assert got.columns == ["hash", "n"] and got.count() == got.select("hash").distinct().count() == 6010
    assert got.where("n < 0").isEmpty()  # what is there stays
    keyed.compact(spark, path, "hash")
    assert keyed.read_keyed(spark, path).count() == 6010 and len(list((tmp_path / "keys").glob("key_batch=*"))) == 1
    assert keyed.insert_if_absent(rows(0, 6020), path, "hash") == keyed.BUCKETS and keyed.read_keyed(spark, path).count() == 6020


def test_keys_of_several_columns_and_nulls(spark, tmp_path):
    path = str(tmp_path / "keys")
    rows = lambda *x: spark.createDataFrame(x, "a string, b int, v string")
    keyed.insert_if_absent(rows(("x", 1, "first"), ("x", None, "first"), (None, None, "first"), ("x", 1, "first")), path, ["a", "b"])
    keyed.insert_if_absent(rows(("x", 1, "later"), ("x", None, "later"), (None, None, "later"), ("x", 2, "later")), path, ["a", "b"])
    assert sorted((r.a or "-", r.b or 0, r.v) for r in keyed.read_keyed(spark, path).collect()) == [("-", 0, "first"), ("x", 0, "first"), ("x", 1, "first"), ("x", 2, "later")]


def test_retention_reads_all_files_in_one_job(spark, data, tmp_path):
    v = Views(spark, data)
    day = v.timings.agg(F.min("net_timestamp")).first()[0].date()
    done = [files.export_day(v.timings, day + dt.timedelta(days=k), str(tmp_path)) for k in range(3)]
    broken = tmp_path / "broken.parquet"
    broken.mkdir()
    (broken / "part-0.parquet").write_text("not parquet")
    got = {r.file_path: (r.parquet_rows, r.file_bytes) for r in files.file_rows(spark, [d[0] for d in done] + [str(broken), str(tmp_path / "none")]).collect()}
    assert {d[0]: (d[1], d[2]) for d in done}.items() <= got.items()
    assert got[str(broken)] == got[str(tmp_path / "none")] == (-1, -1)


# Percentiles of heavy groups


def test_refined_percentiles_equal_percentile(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", "b", None]), r.choice([r.randint(-5, 5), r.randint(0, 10**9), None])) for _ in range(3000)] + [("lone", 7), ("nulls", None)]
    df = spark.createDataFrame(rows, "k string, v long")
    probs = [0.0, 0.001, 0.25, 0.5, 0.9, 1.0]
    want = {x.k: (x.n, x.p) for x in df.groupBy("k").agg(F.count("v").alias("n"), F.percentile("v", F.array(*map(F.lit, probs))).alias("p")).collect()}
    for heavy in (0, 500, 10**9):
        got = {x.k: (x.n, x.p, x.low) for x in quantiles.percentiles(df, ["k"], "v", probs, [F.min("v").alias("low")], heavy=heavy).collect()}
        assert set(got) == set(want)
        for k, (n, p, low) in got.items():
            assert n == want[k][0] and (p == pytest.approx(want[k][1]) if want[k][1] else p is None)
            assert low == (min((v for g, v in rows if g == k and v is not None), default=None))
    with pytest.raises(Exception, match="span"):
        quantiles.percentiles(df, ["k"], "v", probs, heavy=0, span=1000).collect()


def test_one_message_of_ten_million_receipts(spark):
    n = 10_000_000
    df = spark.range(n).select(F.lit(1).alias("hash"), (F.col("id") * 7919 % n * 31).alias("v"))
    got = quantiles.percentiles(df, ["hash"], "v", [0.05, 0.5, 0.95]).first()
    assert got.n == n and got.p == pytest.approx([31 * p * (n - 1) for p in (0.05, 0.5, 0.95)])


def test_summaries_are_the_same_for_heavy_messages(spark, data):
    v = Views(spark, data)
    near = lambda a, b: [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in a.collect()] == [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in b.collect()]
    args = v.timings, v.metadata, v.message_first_seen
    assert near(*(propagation.propagation(*args, peer_cutoff=2, exact=True, heavy=h).orderBy("hash") for h in (8, 10**9)))
    assert near(*(legacy.convergence_delay_summary(v.timings, 0.02, heavy=h) for h in (8, 10**9)))
    assert near(*(propagation.originated_propagation(*args, v.owned, cutoff=1, heavy=h) for h in (8, 10**9)))


# Attribution


def plain_owner(owners, ts, grace):
    def rank(o):
        first, last, uuid = o
        gap = max(first - ts, ts - last, 0)
        return (gap > grace, gap if gap > grace else 0, first, uuid)

    return min(owners, key=rank)[2] if owners else None


@pytest.mark.parametrize("width", [7, 50, 10_000])
def test_attribution_against_brute_force(spark, width):
    r = random.Random(width)
    samples = [(r.randint(0, 400), f"u{r.randint(0, 9)}", r.choice([1, 2]), "r", 9) for _ in range(60)]
    packets = [(k, r.choice([float(r.randint(-50, 450)), r.uniform(-50, 450)]), r.choice([1, 2, 3]), "r", 9) for k in range(400)] + [(400, 5.0, None, "r", 9), (401, None, 1, "r", 9)]
    own = defaultdict(dict)
    for t, u, port, *_ in samples:
        low, high = own[port].get(u, (t, t))
        own[port][u] = min(low, t), max(high, t)
    shape = "local_port int, remote_ip string, remote_port int"
    got = attribution.attribute_flows(spark.createDataFrame(packets, f"pkt_id int, ts double, {shape}"), spark.createDataFrame(samples, f"epoch long, uuid string, {shape}"), 6, width).collect()
    assert len(got) == len(packets)
    for x in got:
        if x.ts is not None:
            owners = [(a, b, u) for u, (a, b) in own.get(x.local_port, {}).items()]
            assert x.uuid == plain_owner(owners, x.ts, 6), x
            assert x.in_window == any(a - 6 <= x.ts <= b + 6 for a, b, _ in owners)


def test_a_socket_with_very_many_owners(spark):
    n = 100_000
    key = [F.lit(1).alias("local_port"), F.lit("r").alias("remote_ip"), F.lit(9).alias("remote_port")]
    samples = spark.range(2 * n).select((F.floor(F.col("id") / 2) * 10 + F.col("id") % 2 * 5).alias("epoch"), F.format_string("u%06d", F.floor(F.col("id") / 2)).alias("uuid"), *key)
    packets = spark.range(n).select("id", (F.col("id") * 10 + 7.0).alias("ts"), *key)
    got = attribution.attribute_flows(packets, samples, 1)
    assert got.where(F.col("in_window") | (F.col("uuid") != F.format_string("u%06d", "id"))).isEmpty() and got.count() == n  # 2 after one, 3 before the next


def test_captured_rows_are_oriented(spark):
    p = spark.createDataFrame([(1, 5.0, "me", 1, "r", 9, 10), (2, 6.0, "r", 9, "me", 1, 20), (3, 7.0, "x", 1, "y", 2, 30), (4, 8.0, "me", 4, "z", 5, 40)], "pkt_id int, ts double, src_ip string, src_port int, dst_ip string, dst_port int, bytes long")
    s = spark.createDataFrame([(5, "u", 1, "r", 9)], "epoch long, uuid string, local_port int, remote_ip string, remote_port int")
    flows, lost = attribution.captured_flows(p, s, "me")
    assert {(x.pkt_id, x.uuid) for x in flows.collect()} == {(1, "u"), (2, "u"), (4, None)}
    assert {(x.remote_ip, x.packets) for x in lost.collect()} == {("z", 1), ("y", 1)}


def test_assignments_are_ranked(spark):
    nodes = spark.createDataFrame([(f"n{k}", "1.2.3.4:9735" if k % 5 else None) for k in range(3000)], "pubkey string, sockets string")
    membership = nodes.select("pubkey", (F.substring("pubkey", 2, 9).cast("int") % 2).alias("level_0"))
    mapping = spark.createDataFrame([("a", 0), ("b", 1), ("c", 7)], "collector string, level_0 int")
    plan = graph.sampling_plan(membership, 50)
    got = graph.assignments(mapping, plan.unionByName(plan.limit(1).withColumn("level_0", F.lit(7))), membership, nodes, 3).collect()
    for c in ("a", "b"):
        own = sorted((x["rank"], x.pubkey) for x in got if x.collector == c)
        assert [k for k, _ in own] == list(range(1, 1201)) and len({p for _, p in own}) == 1200
    assert [(x.pubkey, x["rank"]) for x in got if x.collector == "c"] == [(None, None)]
    other = {(x.collector, x["rank"]): x.pubkey for x in graph.assignments(mapping, plan, membership, nodes, 4).collect()}
    assert sum(other[x.collector, x["rank"]] == x.pubkey for x in got if x.pubkey) < 100


# Distances


def plain_distances(pairs):
    near = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    out = {}
    for s in near:
        seen, front = {s: 0}, [s]
        while front:
            front = [y for x in front for y in near[x] if y not in seen and not seen.setdefault(y, seen[x] + 1) is None]
        out[s] = seen
    return out


def made_graph(seed, n, m, reach):
    r = random.Random(seed)
    return [(f"v{a}", f"v{min(n - 1, a + r.randint(0, reach))}") for a in (r.randrange(n) for _ in range(m))]


def test_neighbourhood_and_diameter(spark):
    pairs = made_graph(1, 150, 260, 9) + [("x", "y"), ("y", "z"), ("x", "x")]
    far = plain_distances(pairs)
    edges = spark.createDataFrame(pairs + [(None, "x")], "src string, dst string")
    top = max(d for own in far.values() for d in own.values())
    want = [sum(sum(d <= k for d in own.values()) for own in far.values()) for k in range(top + 1)]
    assert [(r.hops, r.pairs) for r in distances.neighbourhood(edges, 14).orderBy("hops").collect()] == list(enumerate(want))
    main = max(far.values(), key=len)
    got = distances.diameter(edges).first()
    assert got.vertices == len(main) and got.diameter == max(max(far[v].values()) for v in main) and got.sweeps < len(main) / 2
    s = distances.distance_summary(distances.neighbourhood(edges, 14)).first()
    every = [d for own in far.values() for d in own.values() if d]
    assert s.pairs == len(every) and s.mean_hops == pytest.approx(sum(every) / len(every)) and 0 < s.effective_diameter < top
    assert distances.diameter(edges.limit(0)).count() == distances.neighbourhood(edges.limit(0)).count() == 0


@pytest.mark.parametrize("held", [True, False])
def test_exact_neighbourhood(spark, monkeypatch, held):
    """More sources than a task takes at once, several components, and the form for graphs that tasks cannot hold."""
    if not held:
        monkeypatch.setattr(distances, "HELD", 0)
        monkeypatch.setattr(distances, "PAIRS", 20_000)
    pairs = made_graph(2, 700 if held else 200, 1900 if held else 500, 40) + [("x", "y"), ("y", "z"), ("x", "x"), ("y", "x")] + [(f"p{k}", f"q{k}") for k in range(20)]
    far = plain_distances(pairs)
    edges = spark.createDataFrame(pairs + [(None, "x")], "src string, dst string")
    top = max(d for own in far.values() for d in own.values())
    want = [sum(sum(d <= k for d in own.values()) for own in far.values()) for k in range(top + 1)]
    assert [(r.hops, r.pairs) for r in distances.exact_neighbourhood(edges).orderBy("hops").collect()] == list(enumerate(want))
    main = max(far.values(), key=len)
    assert distances.diameter(edges).first()[:2] == (len(main), max(max(far[v].values()) for v in main))
    assert distances.exact_neighbourhood(edges.limit(0)).count() == 0


def chained(spark, path, n):
    """Orders whose links are a chain of ``n`` vertices."""
    spark.range(n - 1).select(F.col("id").alias("o_custkey"), (F.col("id") * 200).alias("o_orderkey")).write.parquet(f"{path}/orders.parquet")
    return str(path)


def test_diameter_of_many_hops_is_few_jobs(spark, monkeypatch, tmp_path):
    """A table for each hop of each sweep took hundreds."""
    names, plain = [], distances.written
    monkeypatch.setattr(distances, "written", lambda df, name, *more: names.append(name) or plain(df, name, *more))
    assert [tuple(r) for r in library.QUERIES["g7_diameter"](spark, chained(spark, tmp_path, 400)).collect()] == [(400, 399)]
    assert len(names) < 20


def test_neighbourhood_of_more_than_256_hops(spark, tmp_path):
    """This was an error."""
    got = library.QUERIES["g7_neighbourhood"](spark, chained(spark, tmp_path, 300)).orderBy("hops").collect()
    assert [tuple(r) for r in got] == [(t, 300 + 2 * sum(300 - k for k in range(1, t + 1))) for t in range(300)]


def test_distances_of_more_than_256_hops(spark, tmp_path):
    """This was an error."""
    got = library.QUERIES["g7_distances"](spark, chained(spark, tmp_path, 300)).collect()
    assert [tuple(r) for r in got] == [(300 * 299, round(301 / 3, 6))]


def narrow_graph(seed, n, reach, ring=False):
    """Numbered ends of edges of a long graph of narrow layers, its numbers shuffled, and how many pairs lie so many hops apart."""
    r = random.Random(seed)
    names = r.sample(range(n), n)
    pairs = {tuple(sorted((names[a], names[min(n - 1, a + k)]))) for a in range(n - 1) for k in (1, *(r.randint(1, reach) for _ in range(2)))}
    pairs |= {tuple(sorted((names[0], names[-1])))} if ring else set()
    far = [d for own in plain_distances(sorted(pairs)).values() for d in own.values()]
    ends = np.array(sorted(pairs), np.int32)
    return held.Graph(ends[:, 0], ends[:, 1]), np.bincount(far).tolist()


@pytest.mark.parametrize("few, patience, reach, ring", [(1, 32, 32, False), (64, 32, 32, False), (4, 1, 32, False), (4, 32, 32, True), (4, 32, 4, True), (4, 32, 3, False)])
def test_pairs_counted_layer_by_layer(monkeypatch, few, patience, reach, ring):
    """Sources dealt in uneven parts; kinds that merge soon, late or never; layers too far apart, from which on every vertex is searched from."""
    for name, value in (("FEW", few), ("PATIENCE", patience), ("REACH", reach)):
        monkeypatch.setattr(held, name, value)
    graph, want = narrow_graph(few, 240, 3 if ring else 7, ring)
    for small in (0, 10_000):  # layer by layer, and from every vertex
        parts = [graph.counts(a, b, small) for a, b in ((0, 3), (3, 100), (100, 101), (101, 240))]
        assert np.trim_zeros(sum(np.pad(p, (0, 600 - len(p))) for p in parts), "b").tolist() == want


def test_pairs_of_a_long_graph_take_time_in_proportion(monkeypatch):
    """Searches from every vertex took 64 hops' worth of steps for each vertex here; one search now goes on for all sources of a part."""
    steps, plain = [], held.Graph._spread
    monkeypatch.setattr(held.Graph, "_spread", lambda *a: (steps.append(1) or x for x in plain(*a)))
    ends = np.arange(8191, dtype=np.int32)
    graph = held.Graph(ends, ends + 1)
    counts = graph.counts(0, 1000) + graph.counts(1000, 8192)
    assert np.trim_zeros(counts, "b").tolist() == [8192, *(2 * (8192 - k) for k in range(1, 8192))]
    assert len(steps) < 8192


def test_tasks_hold_the_larger_graphs():
    """The links of 9,000,000 orders were searched by joins, with a job for each of thousands of hops."""
    assert distances.HELD >= 8_779_500


def test_diameter_of_a_long_graph_is_few_sweeps(spark):
    """What may still be the furthest is searched from at once, so that a round of sweeps is enough."""
    r = random.Random(3)
    pairs = sorted({(a, min(5999, a + k)) for a in range(5999) for k in (1, r.randint(1, 12), r.randint(1, 12))})
    edges = spark.createDataFrame([(f"v{a}", f"v{b}") for a, b in pairs], "src string, dst string")
    ends = np.array(pairs, np.int32)
    want = len(np.trim_zeros(held.Graph(ends[:, 0], ends[:, 1]).counts(0, 6000, 10_000), "b")) - 1
    rounds, plain = [], distances._sweeps_held
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(distances, "_sweeps_held", lambda *a: rounds.append(1) or plain(*a))
        got = distances.diameter(edges).first()
    assert (got.vertices, got.diameter) == (6000, want) and len(rounds) <= 2


def test_distances_of_a_long_graph_are_counted_layer_by_layer(spark, monkeypatch, tmp_path):
    """A worker searched from each of the vertices; it now does for no more than the pairs of a part with what lies behind it."""

    def no_searches(shared):
        from whisperlake.operators.held import graph_of

        found = graph_of(shared)
        found.pairs = None
        return found

    monkeypatch.setattr(distances, "graph_of", no_searches)
    got = library.QUERIES["g7_distances"](spark, chained(spark, tmp_path, 5000)).collect()
    assert [tuple(r) for r in got] == [(5000 * 4999, round(5001 / 3, 6))]


def test_sketched_neighbourhood_is_close(spark):
    """Balls of up to 3000 vertices in sketches of 256 registers."""
    r = random.Random(5)
    pairs = [(f"v{k}", f"v{r.randrange(3000)}") for k in range(3000) for _ in range(2)]
    far = plain_distances(pairs)
    got = {x.hops: x.pairs for x in distances.neighbourhood(spark.createDataFrame(pairs, "src string, dst string"), 8).collect()}
    for k in range(max(got) + 1):
        want = sum(sum(d <= k for d in own.values()) for own in far.values())
        assert abs(got[k] - want) < 0.1 * want


# Bitmaps


def test_bitmaps_merge_over_any_buckets(spark):
    r = random.Random(8)
    rows = [(at(r.randint(0, 600)), r.randint(0, 300) if r.random() > 0.05 else None, r.choice("ab")) for _ in range(4000)]
    df = spark.createDataFrame(rows, "net_timestamp timestamp, hash long, k string")
    ids = bitmaps.dictionary(df, "hash", "net_timestamp")
    assert ids.count() == ids.select("id").distinct().count() == len({h for _, h, _ in rows if h is not None})
    pages = bitmaps.bitmap_rollup(df, ids, "hash", "10 minutes", "k")
    for low, high in ((0, 600), (50, 170), (200, 210)):
        part = pages.where((F.col("bucket") >= F.lit(at(low))) & (F.col("bucket") < F.lit(at(high))))
        got = {x.k: (x.receipts, x["distinct"]) for x in bitmaps.distinct_counts(part, "k").collect()}
        some = [(h, k) for t, h, k in rows if at(low) <= t < at(high)]
        assert got == {k: (sum(x == k for _, x in some), len({h for h, x in some if x == k and h is not None})) for k in "ab"}
    more = bitmaps.extend(ids, df.select((F.col("hash") * 2).alias("hash"), "net_timestamp"), "hash", "net_timestamp")
    assert more.count() == more.select("id").distinct().count() == more.select("hash").distinct().count() > ids.count()
    assert more.join(ids, ["hash", "id"]).count() == ids.count()  # ids never change


# Streams


def as_stream(spark, batches, schema, folder, column):
    """Each batch a file, in order of the files' times."""
    import os

    folder.mkdir()
    for k, rows in enumerate(batches):
        path = folder / f"{k}.json"
        path.write_text("\n".join(json.dumps({c: v.isoformat() if isinstance(v, dt.datetime) else v for c, v in zip(schema.replace(",", "").split()[::2], r)}) for r in rows))
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def test_liveness_stream_equals_batch(spark, tmp_path):
    """Beats out of order within the lateness, twice, and silent collectors; the last batches only move the watermark."""
    r = random.Random(6)
    beats = sorted((at(r.uniform(0, 300)), r.choice(["a", "b", "c"])) for _ in range(60))
    order = sorted(beats, key=lambda x: (x[0] + dt.timedelta(minutes=r.uniform(0, 8))))
    batches = [[(c, t) for t, c in order[k : k + 7]] for k in range(0, len(order), 7)] + [[("a", order[0][0]), *[("b", t) for t, c in order[-3:] if c == "b"]], [("z", at(1000))], [("z", at(1001))], [("z", at(1002))]]
    batches[-4] = [b for b in batches[-4] if b[1] > at(280)] or [("z", at(990))]
    shape = "collector string, ts timestamp"
    out = state.liveness_stream(as_stream(spark, batches, shape, tmp_path / "in", "ts"), 900, "15 minutes")
    got = []
    q = out.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, _: got.extend((x.collector, x.event, x.at) for x in df.collect())).trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(x.collector, x.event, x.at) for x in state.liveness_events(spark.createDataFrame([b for batch in batches for b in batch], shape), 900).collect()}
    own = lambda x: {e for e in x if e[0] != "z"}
    assert own(got) == own(want) and len(got) == len(set(got)) and {e for _, e, _ in own(got)} == {"online", "expired"}


def test_listener_writes_progress(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.txt").write_text("a\nb\n")
    writer = metrics.ProgressWriter(spark, str(tmp_path / "progress"))
    spark.streams.addListener(writer)
    try:
        stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
        stream.writeStream.queryName("lines").format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        import time

        for _ in range(100):
            if (tmp_path / "progress").exists() and list((tmp_path / "progress").glob("_SUCCESS")):
                break
            time.sleep(0.1)
        got = spark.read.parquet(str(tmp_path / "progress"))
        assert got.agg(F.sum("input_rows")).first()[0] == 6 and got.select("name").distinct().first()[0] == "lines"
    finally:
        spark.streams.removeListener(writer)


def test_ingest_observes_bad_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("1700000000000000,peerA,ca,inbound,120,42,rawA,,,7,n1;bad\nworse;1700000000000001,peerA,ca,inbound,120,42,rawA,,,7,n1")
    source = spark.readStream.schema("value string").text(str(tmp_path / "in"))
    ingest.ingest(source, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out/metrics")).first()
    assert (got.lines, got.bad, got.batch) == (4, 2, 0) and got.seconds > 0
    assert metrics.rates(spark.read.parquet(str(tmp_path / "out/metrics"))).first().bad_share == 0.5
    assert spark.read.parquet(str(tmp_path / "out/log/touched")).count() == 1


def test_untouched_steps_are_not_rewritten(spark, tmp_path):
    build = lambda t: t.groupBy(F.window("net_timestamp", "1 hour").start.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    rows = lambda *minutes: spark.createDataFrame([(at(m),) for m in minutes], "net_timestamp timestamp")
    first, late = rows(1, 61, 130, 500, 900), rows(131, 132)
    log, path = str(tmp_path / "log"), str(tmp_path / "rates")
    refresh.log_touched(first, 0, log)
    assert len(refresh.refresh_touched(build, first, path, log, at_once=2, most=3)) == 3  # and the rest is taken up
    assert len(refresh.refresh_touched(build, first, path, log)) == 1 and refresh.refresh_touched(build, first, path, log) == []
    files_of = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "rates").glob("step=*/*.parquet")}
    before = files_of()
    refresh.log_touched(late, 1, log)
    assert len(refresh.refresh_touched(build, first.unionByName(late), path, log)) == 1
    after = files_of()
    assert len(before) == len(after) == 4 and sum(after.get(p) == m for p, m in before.items()) == 3
    assert {x.bucket: x.n for x in spark.read.parquet(path).collect()} == {at(0): 1, at(60): 1, at(120): 3, at(480): 1, at(900): 1}


# One large array


def test_an_array_is_read_by_many_tasks(spark, tmp_path):
    """100 MB of one array in one file, objects within objects, braces and quotes in strings: equal to reading it whole."""
    r = random.Random(2)
    odd = ['}', '{', '"', '\\', '\\"}', '],[', '}\n{', 'é}', ',{"a":', '']
    path = tmp_path / "big.json"
    with path.open("w", encoding="utf-8") as f:
        f.write("[\n  ")
        for k in range(200_000):
            o = {"pubkey": f"k{k}", "alias": "".join(r.choices(odd, k=3)), "more": {"list": [{"x": k}, {"x": -k}], "none": {}}, "pad": "p" * 380}
            f.write((" ,\n" if k else "") + json.dumps(o, ensure_ascii=bool(k % 2)))
        f.write("]\n")
    assert path.stat().st_size > 95_000_000
    schema = "pubkey string, alias string, more struct<list: array<struct<x: long>>>, missing int"
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        assert json_array.pieces(spark, str(path)).rdd.getNumPartitions() > 20
        got = files.read_json_array(spark, str(path), schema)
        sums = lambda d: d.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("pubkey", "alias", "more")), F.count("missing")).first()
        assert sums(got) == sums(spark.read.schema(schema).option("multiLine", True).json(str(path)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_small_and_odd_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text('[]')
    (tmp_path / "b.json").write_text('[{"x": 1}, {"x": 2, "y": {"z": "}"}}, {}]')
    (tmp_path / "c.json").write_text('\n [ {"x":3}\n]')
    (tmp_path / "d.json").write_text('[{"x": 4}, {"x": 5')
    got = json_array.objects(spark, str(tmp_path)).collect()
    by = defaultdict(list)
    for o in sorted(got, key=lambda o: o.number):
        by[o.file[-6]].append(json.loads(o.text))
    assert by == {"b": [{"x": 1}, {"x": 2, "y": {"z": "}"}}, {}], "c": [{"x": 3}], "d": [{"x": 4}]}


def test_listings_of_a_whole_table_have_no_limit(spark, tmp_path):
    """d4: 1500 receipts of the least hash, more than the operator lists by itself."""
    from whisperlake.library import QUERIES

    at = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(k, at, k, "view", 1.0) for k in range(1500)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["d4_receipts_for_hash"](spark, str(tmp_path)).collect()
    assert sorted(r.row_inc for r in got) == list(range(1500))


def test_quantiles_of_many_receipts_are_exact(spark):
    """T1 to T4 on 3000 receipts of a message, against sorted lists; and values of refined groups."""
    from whisperlake.operators import rollups

    r = random.Random(5)
    rows = [(AT + dt.timedelta(microseconds=r.randint(0, 7_000_000_000)), k, k % 2, k % 2, f"n{k % 3}", 1, k, None) for k in range(6000)] + [(AT, 6000 + k, k, k, "n0", 2, k, None) for k in range(2)]
    t = spark.createDataFrame(rows, "net_timestamp timestamp, row_inc long, hash long, inner_hash long, collector string, dir int, peer_hash long, orig_timestamp timestamp")
    m = spark.createDataFrame([(k, k, 3, 100, None, 7) for k in range(2)], "hash long, inner_hash long, type int, size int, orig_node string, scid long")
    micros = lambda x: (x - AT) // dt.timedelta(microseconds=1)

    def want(values, since, probs):
        return [(sorted(values)[max(1, len(values) - int(len(values) - len(values) * p)) - 1] - since) / 1e6 for p in probs]

    five, three = (0.05, 0.25, 0.5, 0.75, 0.95), (0.25, 0.5, 0.75)
    of = lambda h, c=None: [micros(x[0]) for x in rows if x[5] == 1 and x[2] == h and c in (None, x[4]) and micros(x[0]) < 7_200_000_000]
    for x in rollups.exact_propagation(t, m, 2).collect():
        assert (x.receipts, list(x[4:])) == (len(of(x.hash)), want(of(x.hash), min(of(x.hash)), five))
    for x in rollups.exact_comparison(t, m, 2).collect():
        assert [x.single_p25, x.single_p50, x.single_p75] == want(of(x.hash, x.collector), min(of(x.hash, x.collector)), three) and x.all_p50 == want(of(x.hash), min(of(x.hash)), three)[1]
    for x in rollups.exact_outbound_propagation(t, m, 2).collect():
        hours = [[y for y in of(x.hash, c) if y // 3_600_000_000 == h] for c in ("n0", "n1", "n2") for h in (0, 1)]
        near = [y for ys in hours if min(ys) <= 3_600_000_000 for y in ys]
        assert (x.total_peers, list(x[3:])) == (len(near), want(near, 0, five))
    few = spark.range(500).select((F.col("id") % 2).alias("k"), (F.col("id") * F.col("id") % 997).alias("v"))
    for x in quantiles.percentiles(few, ["k"], "v", five, heavy=10, span=1 << 12, disc=True).collect():
        assert [y / 1e6 for y in x.p] == want([i * i % 997 for i in range(500) if i % 2 == x.k], 0, five)


def test_arrays_behind_one_another(spark, tmp_path):
    """Two lists in one file, as a repartition may leave them: the second one's first object is read too."""
    (tmp_path / "two.json").write_text('[{"pubkey": "a"}, {"pubkey": "b"}]\n[{"pubkey": "c"}, {"pubkey": "d"}]\n')
    assert sorted(x.pubkey or "" for x in json_array.read_json_array(spark, str(tmp_path / "two.json"), "pubkey string").collect()) == ["a", "b", "c", "d"]


def test_channel_ids_of_large_order_keys(spark, tmp_path):
    """Keys beyond 2**23, whose ids fill 64 bits, and beyond 2**24; every query that reads the ids gives each channel once."""
    from whisperlake import jobs_library
    from whisperlake.library import QUERIES

    assert jobs_library  # it adds its queries

    keys = [7, 2**23 - 1, 2**23, 9_000_001, 2**24 + 7]
    made = spark.createDataFrame([(k, 5, "F" if k % 2 else "O", 100.0 + k % 1000) for k in keys], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double")
    made.write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(k, 1) for k in range(10)], "c_custkey long, c_nationkey long").write.parquet(str(tmp_path / "customer.parquet"))
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    ids = {(x.scid + 2**64) % 2**64 for x in run("g1_edges")}
    assert ids == {k << 40 | 5 << 16 | k % 2 for k in keys[:4]} | {7 << 40 | 1005 << 16 | 1}
    assert {(int(x.back), bytes.fromhex(x.le_hex)) for x in run("f1_f2_bytes_of_ids")} == {(i, i.to_bytes(8, "little")) for i in ids}
    assert {x.text for x in run("f3_scid_format") if x.back == x.scid} == {f"{i >> 40}x{i >> 16 & 0xFFFFFF}x{i & 0xFFFF}" for i in ids}
    got = {((x.scid + 2**64) % 2**64): (x.state, x.capacity) for x in run("g17_channel_utxo_filter")}
    assert got == {(k & 0xFFFFFF) << 40 | ((k >> 24) * 1000 + 5) << 16 | k % 2: ("spent", None) if k % 2 else ("kept", 101 + k % 1000) for k in keys}
    for name in ("g10_edge_scope", "g4_box_cox", "g5_log_standardize"):
        assert len({x.scid for x in run(name)}) == len(keys)


def test_graph_diff_deals_by_the_number_of_rows(spark):
    """So many rows to a partition, all of a key in one."""
    dealt = graph._dealt(spark.range(1000).select((F.col("id") % 100).alias("k")), "k", 100)
    assert dealt.rdd.getNumPartitions() == 11
    assert dealt.select("k", F.spark_partition_id().alias("p")).distinct().count() == 100
