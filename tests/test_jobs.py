"""Life cycle, streaming and graph jobs on small frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from whisperlake.fixtures import Views
from whisperlake.operators import attribution, graph, legacy, rates, rollups
from whisperlake.operators.components import components
from whisperlake.sources import files
from whisperlake.streaming import ingest

LINE = "1700000000000000,peerA,ca,inbound,120,42,rawA,,,7,n1"


def test_decode(spark):
    bad = ["x,y", LINE + ",12", LINE.replace("ca", "zz"), LINE.replace("inbound", "up"), LINE.replace("1700000000000000", "soon"), LINE.replace(",120,", ",70000,"), LINE.replace(",42,", ",18446744073709551616,")]
    good = [LINE, LINE.replace(",42,", ",18446744073709551615,"), "1700000000000001,p,pong,outbound,1,0,r,,,,"]
    df = spark.createDataFrame([(";".join(good + bad),)], "value string")
    got = ingest.decode_lines(df).collect()
    assert [r.error for r in got] == [None] * 3 + ["fields", "fields", "type", "dir", "net_timestamp", "size", "inner_hash"]
    assert int(got[1].inner_hash) == 2**64 - 1 and got[2].scid is None
    with pytest.raises(Exception, match="bad line"):
        ingest.decode_lines(df, "failfast").collect()


def test_ingest_stream_equals_batch(spark, tmp_path):
    lines = [LINE.replace("1700000000000000", str(1700000000000000 + k)).replace("rawA", f"raw{k % 5}") for k in range(20)] + ["bad"]
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.txt").write_text("\n".join(";".join(lines[j : j + 4]) for j in range(4 * k, len(lines), 12)))
    source = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
    ingest.ingest(source, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    batch = ingest.decode_lines(spark.read.text(str(tmp_path / "in")))
    good = batch.where("error is null")
    assert spark.read.parquet(str(tmp_path / "out/timings")).count() == good.count() > 0
    assert spark.read.parquet(str(tmp_path / "out/messages")).count() == good.select("hash").distinct().count()
    assert spark.read.parquet(str(tmp_path / "out/quarantine")).count() == batch.where("error is not null").count()


def test_ping_pongs_are_alike_for_one_batch_and_many(spark, tmp_path):
    """Row numbers grow over batches, so pongs meet the pings before them however the lines were cut."""
    import os
    import random

    r = random.Random(5)
    lines, now = [], 1_700_000_000_000_000
    for _ in range(120):
        now += r.randint(1, 5_000_000)
        word, way = r.choice([("ping", "outbound"), ("pong", "inbound"), ("ca", "inbound")])
        lines.append(f"{now},peer{r.randint(0, 3)},{word},{way},9,1,raw{len(lines)},,,7,n1")
    (tmp_path / "in").mkdir()
    for k in range(6):
        path = tmp_path / "in" / f"{k}.txt"
        path.write_text("\n".join(";".join(lines[j : j + 5]) for j in range(20 * k, 20 * k + 20, 5)))
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    found = []
    for files_at_once in (1, 100):
        root = str(tmp_path / str(files_at_once))
        source = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_at_once).text(str(tmp_path / "in"))
        ingest.ingest(source, f"{root}/out", f"{root}/cp").awaitTermination()
        t, m = spark.read.parquet(f"{root}/out/timings"), spark.read.parquet(f"{root}/out/metadata")
        assert t.select("row_inc").distinct().count() == len(lines)
        assert [x.net_timestamp for x in t.orderBy("row_inc").collect()] == [x.net_timestamp for x in t.orderBy("net_timestamp").collect()]
        found.append(sorted((x.peer, x.response_seconds) for x in legacy.ping_pong_pairs(t, m).collect()))
    assert found[0] == found[1] and len(found[0]) > 10


def test_sync_that_failed_is_replaced(spark, data, tmp_path):
    v, root = Views(spark, data), str(tmp_path / "s")
    files.incremental_sync(v.timings, {}, root, dt.datetime(2024, 1, 10))
    files.delete(spark, f"{root}/_sync_state")
    files.incremental_sync(v.timings, {}, root, dt.datetime(2024, 1, 12))
    files.incremental_sync(v.timings, {}, root, dt.datetime(2100, 1, 1))
    t = spark.read.parquet(f"{root}/timings")
    assert t.count() == t.select("row_inc").distinct().count() == v.timings.count()


def test_an_unreachable_export_is_kept(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "e.parquet")
    files.export_once(spark.range(3), path)

    def fail(*_):
        raise OSError("connection reset")

    monkeypatch.setattr(files, "size_of", fail)
    with pytest.raises(OSError, match="reset"):
        files.export_once(spark.range(3), path)
    assert spark.read.parquet(path).count() == 3


def test_a_shared_folder_is_asked_for():
    from types import SimpleNamespace

    from whisperlake.plans.scratch import shared_dir

    context = SimpleNamespace(master="spark://x:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))


def test_rollup_stream_equals_batch(spark, data, tmp_path):
    v = Views(spark, data)
    t = v.timings.where("dir = 1").orderBy("net_timestamp").coalesce(1)
    t.write.parquet(str(tmp_path / "t"))
    spark.createDataFrame([(dt.datetime(2100, 1, 1),)], "net_timestamp timestamp").write.mode("append").parquet(str(tmp_path / "late"))
    stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "t"))
    m = v.metadata
    q = ingest.rollup_stream(lambda r: rollups.message_rate_rollup(r, m).select("bucket", "type", "receipts"), stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = {(r.bucket, r.type): r.receipts for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.bucket, r.type): r.receipts for r in rollups.message_rate_rollup(t, m).select("bucket", "type", "receipts").collect()}
    assert got and all(want[k] == n for k, n in got.items())  # buckets past the watermark, whole


def test_first_seen_first_write_wins(spark, tmp_path):
    path = str(tmp_path / "fs")
    rows = lambda *x: spark.createDataFrame([(h, dt.datetime(2024, 1, d)) for h, d in x], "hash long, net_timestamp timestamp")
    ingest.update_first_seen(rows((1, 2), (2, 2)), path, "2024-01-02 12:00:00")
    ingest.update_first_seen(rows((1, 1), (3, 2)), path, "2024-01-02 12:00:00", "10 days")
    assert {(r.hash, r.first_seen.day) for r in spark.read.parquet(path).collect()} == {(1, 2), (2, 2), (3, 2)}


def test_warmup_and_liveness(spark):
    t = spark.createDataFrame([("n", "p", dt.datetime(2024, 1, 1, 0, k)) for k in (0, 9, 10, 30)], "collector string, peer string, net_timestamp timestamp")
    c = spark.createDataFrame([("n", "p", dt.datetime(2024, 1, 1))], "collector string, peer string, started timestamp")
    assert [r.net_timestamp.minute for r in ingest.warmup_filter(t, c).orderBy("net_timestamp").collect()] == [10, 30]
    hb = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 0, 5)), ("b", dt.datetime(2024, 1, 1))], "collector string, ts timestamp")
    assert [r.collector for r in ingest.liveness(hb, "2024-01-01 00:12:00").collect()] == ["a"]


def test_life_cycle(spark, data, tmp_path):
    v, root, log = Views(spark, data), str(tmp_path / "x"), str(tmp_path / "log")
    t = v.timings
    day = t.agg(F.min("net_timestamp")).first()[0].date()
    now = dt.datetime(2100, 1, 1)
    files.append_timings(t, f"{root}/live")
    live = spark.read.parquet(f"{root}/live")
    done = files.export_day(live.drop("day"), day, root)
    assert done[1] == t.where(F.to_date("net_timestamp") == F.lit(day)).count() > 0
    assert files.export_day(live.limit(0).drop("day"), day, root) == done  # kept as it is
    files.record_archive(spark, log, day, "timings", done, now)
    files.record_archive(spark, log, day, "timings", (done[0], -5, 0), now)  # the first row stays
    logged = spark.read.parquet(log)
    assert logged.count() == 1
    pending = files.pending_ranges(live, logged, 1, now).collect()
    assert pending and all(r.range_start.date() != day for r in pending)
    assert files.missing_companions(logged).count() == 4
    assert files.export_companion(v.metadata, v.message_first_seen, "metadata", day, root)[1] > 0
    verdict = files.retention_verify(live, logged, 1, now)
    assert verdict.first().verified
    assert not files.retention_verify(live.limit(3), logged, 1, now).first().verified
    assert len(files.retention_apply(verdict, f"{root}/live", str(tmp_path / "gone"), now)) == 1 and files.exists(spark, f"{root}/live/day={day}")
    files.retention_apply(verdict, f"{root}/live", str(tmp_path / "gone"), now, dry_run=False)
    assert not files.exists(spark, f"{root}/live/day={day}") and spark.read.parquet(str(tmp_path / "gone")).count() == 1
    got = files.load_range(spark, root, day, 2, ("timings", "messages"))
    assert set(got) == {"timings"} and spark.table("timings").count() == done[1]


def test_broken_export_is_made_anew(spark, tmp_path):
    path = tmp_path / "e.parquet"
    path.mkdir()
    (path / "part-0.parquet").write_text("not parquet")
    assert files.export_once(spark.range(3), str(path))[1] == 3


def test_sync(spark, data, tmp_path):
    v, root = Views(spark, data), str(tmp_path / "s")
    cut = dt.datetime(2024, 1, 20)
    files.incremental_sync(v.timings, {"metadata": v.metadata}, root, cut)
    files.incremental_sync(v.timings, {"metadata": v.metadata}, root, dt.datetime(2100, 1, 1))
    assert spark.read.parquet(f"{root}/timings").count() == v.timings.count()
    assert spark.read.parquet(f"{root}/metadata").count() == v.metadata.select("hash").distinct().count()


def test_text_formats(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("# c\n1\tu\t40000\t10.0.0.1\t9735\nbad\tline\n2\tu\tx\t1\t1\n")
    assert files.read_socket_samples(spark, str(tmp_path / "s.tsv")).count() == 1
    files.write_csv(spark.range(4).withColumn("community", F.col("id") % 2), str(tmp_path / "c"), "community")
    assert sorted(p.name for p in (tmp_path / "c").glob("community=*")) == ["community=0", "community=1"]
    (tmp_path / "n.csv").write_text("a,b\n1,x\nq,y\n")
    with pytest.raises(Exception):  # noqa: B017
        files.read_csv_typed(spark, str(tmp_path / "n.csv"), "a int, b string").collect()
    (tmp_path / "n.json").write_text('[{"pubkey": "a"}, {"pubkey": "b"}]')
    (tmp_path / "m.json").write_text('[{"pubkey": "c", "alias": "x"}]')
    both = files.merge_append_json(spark, [str(tmp_path / "n.json"), str(tmp_path / "m.json")], ["pubkey string", "pubkey string, alias string"])
    assert both.count() == 3 and both.where("alias is null").count() == 2


def test_components(spark):
    chain = [(k, k + 1) for k in range(50)] + [(100, 101), (100, 100), (7, 3), (None, 4)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert {got[k] for k in range(51)} == {0} and got[101] == got[100] == 100
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_hops(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "src string, dst string")
    got = {r.pubkey: r.hops for r in graph.hops_from(e, spark.createDataFrame([("a",)], "pubkey string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_ping_pong(spark):
    rows = [(1, 4, 2), (2, 5, 1), (3, 5, 1), (4, 5, 2), (5, 4, 1), (6, 4, 2), (7, 4, 2), (8, 5, 1)]
    t = spark.createDataFrame([(n, "p", k, d, dt.datetime(2024, 1, 1, 0, 0, n)) for n, k, d in rows], "row_inc long, peer string, hash long, dir int, net_timestamp timestamp")
    m = spark.createDataFrame([(4, 4), (5, 5)], "hash long, type int")
    assert {(r.ping_row, r.pong_row) for r in legacy.ping_pong_pairs(t, m).collect()} == {(1, 2), (1, 3), (7, 8)}
    assert {(r.ping_row, r.pong_row) for r in legacy.ping_pong_pairs(t, m, True).collect()} == {(1, 2), (7, 8)}


def test_buckets(spark):
    df = spark.createDataFrame([(x,) for x in (0.5, 1.0, 1.5, 10.0, 10.5, 1001.0)], "x double")
    assert [r.entity_count for r in rates.bucket_counts(df, "x").orderBy("bucket").collect()] == [1, 2, 1, 0, 1]
    assert {(r.entity_count, r.message_pct) for r in rates.bucket_counts(df.limit(0), "x").collect()} == {(0, 0.0)}


def test_attribution(spark):
    s = spark.createDataFrame([(t, u, 1, "r", 9) for t, u in ((100, "a"), (200, "a"), (150, "b"), (300, "b"))], "epoch long, uuid string, local_port int, remote_ip string, remote_port int")
    p = spark.createDataFrame([(k, float(x), port, "r", 9, 1) for k, (x, port) in enumerate([(160, 1), (350, 1), (1000, 1), (0, 1), (5, 2)])], "pkt_id int, ts double, local_port int, remote_ip string, remote_port int, bytes long")
    got = {r.pkt_id: (r.uuid, r.in_window) for r in attribution.attribute_flows(p, s).collect()}
    assert got == {0: ("a", True), 1: ("b", True), 2: ("b", False), 3: ("a", False), 4: (None, False)}


def test_sampling_plan(spark):
    df = spark.createDataFrame([("p", 0)] * 900 + [("q", 1)] * 50 + [("r", 2)] * 5, "pubkey string, level_0 int")
    got = {r.level_0: r.connection_count for r in graph.sampling_plan(df, 100).collect()}
    assert got[1] == 5 and got[2] >= 1 and got[0] < 95


def test_box_cox(spark):
    import math

    df = spark.createDataFrame([(math.exp(x / 10),) for x in range(-20, 21)], "x double")
    out, lam = graph.box_cox(df, "x")
    assert abs(lam) < 0.05
    assert abs(out.agg(F.avg("x_bc")).first()[0]) < 1e-9


def test_merge_and_diff(spark):
    """b lacks z, of which nobody has info; a knows it; y has no info anywhere; direction 2 of each channel is nobody's."""
    n = spark.createDataFrame([("a", "x", 5, "new"), ("b", "x", 4, "old"), ("b", "y", None, None), ("a", "z", None, None)], "collector string, pubkey string, last_update int, alias string")
    c = spark.createDataFrame([("a", 1, 1, 9, 1, 1, 1), ("b", 1, 1, 8, 1, 1, 1), ("a", 2, 1, 9, 1, 1, 1), ("a", 3, 1, 9, 1, 1, 1), ("b", 3, 2, 9, 1, 1, 1)], "collector string, scid long, direction int, last_update int, fees_base long, fees_ppm long, cltv long")
    d = {r.collector: r for r in graph.graph_diff(n, c).collect()}
    assert (d["b"].known_nodes, d["b"].missing_nodes, d["b"].missing_node_info, d["b"].stale_node_info, d["b"].matching_node_info) == (2, 1, 1, 1, 1)
    assert (d["a"].known_nodes, d["a"].missing_nodes, d["a"].missing_node_info, d["a"].stale_node_info, d["a"].matching_node_info) == (2, 1, 1, 0, 2)
    assert (d["b"].known_channels, d["b"].missing_channels, d["b"].missing_directions, d["b"].stale_directions, d["b"].matching_directions) == (2, 1, 1, 0, 3)
    assert (d["a"].known_channels, d["a"].missing_channels, d["a"].missing_directions, d["a"].matching_directions) == (3, 0, 1, 5)


def test_merged_channels(spark):
    c = spark.createDataFrame([("b", 1, 9, None), ("a", 1, 5, 70), ("c", 1, 7, 80), ("a", 2, None, None), ("b", 2, None, 3), ("b", 3, 4, 1), ("a", 3, 4, 2)], "collector string, scid long, last_update int, capacity long")
    assert {(r.scid, r.last_update, r.capacity) for r in graph.merge_channels(c).collect()} == {(1, 9, 80), (2, None, 3), (3, 4, 2)}


def _receipts(spark, rows):
    """(timings, metadata) of (minute, hash, collector, dir), all of type 3."""
    at = dt.datetime(2024, 1, 1)
    t = [(at + dt.timedelta(minutes=k), n, h, h, c, d, n % 3, None) for n, (k, h, c, d) in enumerate(rows)]
    m = [(h, h, 3, 100, None, 7) for h in {r[1] for r in rows}]
    return (spark.createDataFrame(t, "net_timestamp timestamp, row_inc long, hash long, inner_hash long, collector string, dir int, peer_hash long, orig_timestamp timestamp"),
            spark.createDataFrame(m, "hash long, inner_hash long, type int, size int, orig_node string, scid long"))


def test_a_late_collector_is_not_compared(spark):
    """Its receipts lie over an hour after the first bucket of the message at any collector."""
    t, m = _receipts(spark, [(0, 1, "a", 1), (1, 1, "a", 1), (300, 1, "b", 1), (301, 1, "b", 1), (61, 1, "c", 1)])
    got = {r.collector: r for r in rollups.collector_comparison(rollups.propagation_rollup(t, m, per_collector=True), 1).collect()}
    assert set(got) == {"a", "c"} and got["a"].peers_all == 3 and got["a"].peers_single == 2 and got["c"].single_p50 == 0.0


def test_outbound_propagation_has_quantiles_from_the_origin(spark):
    t, m = _receipts(spark, [(2, 1, "a", 2), (1, 1, "b", 1), (3, 1, "c", 1), (12, 1, "c", 1), (5, 1, "d", 1), (70, 1, "e", 1), (4, 2, "a", 2), (6, 2, "b", 1)])
    got = rollups.outbound_propagation(rollups.outbound_origin_rollup(t, m), rollups.propagation_rollup(t, m, per_collector=True), 2).collect()
    assert [(r.hash, r.total_peers, r.p05, r.p50, r.p95) for r in got] == [(1, 3, 60.0, 180.0, 600.0)]  # b's bucket begins before, e's over an hour after


def test_comparison_counts_messages_and_not_receipts(spark):
    t, m = _receipts(spark, [(k, 1, "a", 1) for k in range(12)] + [(k, 2, "a", 1) for k in range(3)])
    got = rollups.scid_comparison(rollups.activity_rollup(t, m, "scid"), min_messages=2).collect()
    assert [(r.scid, r.announcements, r.updates, r.total) for r in got] == [(7, 0, 2, 2)]
    assert not rollups.scid_comparison(rollups.activity_rollup(t, m, "scid"), min_messages=3).collect()


def test_reach_is_by_message(spark):
    """Two owners of one message, each heard by the other and by one more: four rows, three collectors."""
    from whisperlake.operators import propagation

    t, m = _receipts(spark, [(0, 1, "a", 2), (0, 1, "b", 2), (1, 1, "a", 1), (2, 1, "b", 1), (3, 1, "c", 1)])
    owned = spark.createDataFrame([("a", 7), ("b", 7)], "collector string, scid long")
    fs = spark.createDataFrame([(1, dt.datetime(2024, 1, 1))], "hash long, first_seen timestamp")
    got = propagation.originated_propagation(t.withColumn("peer", F.lit("p")), m, fs, owned, cutoff=3).first()
    assert (got.qualifying_messages, got.total_receipts, got.median_reach) == (1, 4, 3.0)
