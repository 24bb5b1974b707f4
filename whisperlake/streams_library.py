"""Queries over streams with state, refreshes, distances, bitmaps, captured flows and large arrays, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whisperlake.fixtures import Views
from whisperlake.jobs_library import folder, ingested
from whisperlake.library import _INTERVALS, _RECEIPTS, SQL, longs, query, r6, said, ts
from whisperlake.operators import attribution, bitmaps, distances, rates, refresh
from whisperlake.sources import json_array
from whisperlake.streaming import metrics, state

FAR = "2100-01-01 00:00:00"


def streamed(rows: DataFrame, root: str, name: str, at: str, files: int = 6) -> DataFrame:
    """``rows`` as a stream of files in the order of ``at``, one far later row last, which moves the watermark past all others."""
    spark = rows.sparkSession
    rows.repartitionByRange(files, at).write.parquet(f"{root}/{name}/in")
    last = spark.createDataFrame([(None,) * len(rows.columns)], ", ".join(f"{c} {k}" for c, k in rows.dtypes)).withColumn(at, F.lit(FAR).cast("timestamp"))
    last = last.withColumns({c: F.lit("~") for c, k in rows.dtypes if k == "string"})
    for k in range(2):  # a second one, as a watermark moves after the batch that raised it
        last.withColumn(at, F.expr(f"{at} + interval {k} day")).coalesce(1).write.mode("append").parquet(f"{root}/{name}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/{name}/in")


def drained(out: DataFrame, root: str, mode: str = "append") -> DataFrame:
    """All that a stream gives out until its input ends."""
    spark = out.sparkSession
    if mode == "append":
        q = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
    else:
        q = out.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").foreachBatch(lambda df, k: df.withColumn("_batch", F.lit(k)).write.mode("append").parquet(f"{root}/out"))
    q.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out")


def live(v: Views) -> DataFrame:
    beats = v.timings.where("hash % 10 = 1").select("collector", F.col("net_timestamp").alias("ts"))
    root = folder(v, "liveness")
    out = drained(state.liveness_stream(streamed(beats, root, "beats", "ts"), 7200, "30 days"), root, "update")
    return said(out.where("collector <> '~'").select("collector", "event", "at"), "at")


_LIVE = "b AS (SELECT DISTINCT collector, net_timestamp AS ts FROM timings WHERE hash%10=1), w AS (SELECT *, lag(ts) OVER (PARTITION BY collector ORDER BY ts) AS p, lead(ts) OVER (PARTITION BY collector ORDER BY ts) AS n FROM b)"
query("k5_liveness_stream", f"WITH {_LIVE} SELECT collector, 'online' AS event, {ts('ts')} AS \"at\" FROM w WHERE p IS NULL OR ts > p + INTERVAL 2 HOUR UNION ALL SELECT collector, 'expired', {ts('ts + INTERVAL 2 HOUR')} FROM w WHERE n IS NULL OR n > ts + INTERVAL 2 HOUR")(live)


def warmed(v: Views) -> DataFrame:
    """Connections begin at the first receipt of a peer, and anew at every hundredth row."""
    root, t = folder(v, "warm-up"), v.timings.select("row_inc", "collector", "peer", "net_timestamp")
    begins = t.groupBy("collector", "peer").agg(F.min("net_timestamp").alias("started")).unionByName(t.where("row_inc % 100 = 0").select("collector", "peer", F.col("net_timestamp").alias("started")))
    rows, conns = streamed(t, root, "receipts", "net_timestamp"), streamed(begins, root, "connections", "started")
    return drained(state.warmup_stream(rows, conns, "10 minutes", "60 days"), root).where("collector <> '~'").select("row_inc")


query("k4_warmup_stream", "WITH cn AS (SELECT collector, peer, min(net_timestamp) AS started FROM timings GROUP BY 1,2 UNION ALL SELECT collector, peer, net_timestamp FROM timings WHERE row_inc%100=0) SELECT row_inc FROM timings t WHERE NOT EXISTS (SELECT 1 FROM cn WHERE cn.collector=t.collector AND cn.peer=t.peer AND t.net_timestamp>=started AND t.net_timestamp<started+INTERVAL 10 MINUTE)")(warmed)


def counted(v: Views) -> DataFrame:
    root, t = folder(v, "peers"), v.timings.select("collector", "peer_hash", "dir", "net_timestamp")
    return said(drained(state.peer_count_stream(streamed(t, root, "receipts", "net_timestamp").withColumn("dir", F.coalesce("dir", F.lit(1))), lateness="30 days"), root).where("collector <> '~'"), "bucket")


query("c1_peer_count_stream", f"WITH a AS (SELECT time_bucket(INTERVAL 10 MINUTE, net_timestamp) AS b, collector, count(DISTINCT peer_hash) AS peers FROM timings WHERE dir=1 GROUP BY 1,2) SELECT {ts('b')} AS bucket, collector, peers FROM a")(counted)


def observed(v: Views) -> DataFrame:
    """Sums of what the batches of an ingest observed."""
    rows = v.timings.sparkSession.read.parquet(f"{ingested(v)}/metrics")
    sums = rows.agg(F.sum("lines").alias("lines"), F.sum("bad").alias("bad"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.count_if(F.expr("seconds > 0 and bytes > 0")).alias("timed"), F.count(F.lit(1)).alias("batches"))
    each = metrics.rates(rows).agg(F.count_if(F.expr("lines_per_s > 0 and bad_share between 0 and 0.5")).alias("rated"))
    return said(sums.crossJoin(each).select("lines", "bad", "first_ts", "last_ts", (F.col("timed") == F.col("batches")).alias("all_timed"), (F.col("rated") == F.col("batches")).alias("all_rated")), "first_ts", "last_ts")


query("k6_ingest_metrics", f"WITH b AS (SELECT count(DISTINCT CAST(floor(row_inc/10) AS BIGINT)) AS n FROM timings WHERE CAST(floor(row_inc/10) AS BIGINT)%50=0) SELECT count(*)+(SELECT n FROM b) AS lines, (SELECT n FROM b) AS bad, {ts('min(net_timestamp)')} AS first_ts, {ts('max(net_timestamp)')} AS last_ts, true AS all_timed, true AS all_rated FROM timings")(observed)


def refreshed(v: Views) -> DataFrame:
    """Half of the receipts, then those of one day more, then the rest: each time only what was touched, the last time a few steps a run."""
    root, spark = folder(v, "steps"), v.timings.sparkSession
    build = lambda t: rates.message_rate(t, v.metadata)
    held = v.timings.where("row_inc % 2 = 0")
    for batch, (new, every) in enumerate(((held, held), (v.timings.where("row_inc % 2 = 1 and net_timestamp < timestamp '2024-01-03'"), held.unionByName(v.timings.where("row_inc % 2 = 1 and net_timestamp < timestamp '2024-01-03'"))), (v.timings, v.timings))):
        refresh.log_touched(new, batch, f"{root}/log")
        while refresh.refresh_touched(build, every, f"{root}/rates", f"{root}/log", 256, None if batch < 2 else 400):
            pass
    return longs(said(spark.read.parquet(f"{root}/rates").select("bucket", "type", "receipts"), "bucket"))


query("c9_refresh_touched", f"SELECT {ts('b')} AS bucket, CAST(type AS BIGINT) AS type, receipts FROM (SELECT date_trunc('hour', net_timestamp) AS b, type, count(*) AS receipts FROM timings t JOIN metadata m ON t.hash=m.hash WHERE dir=1 AND m.type IN (1,2,3) GROUP BY 1,2)")(refreshed)

# Exact distinct counts that merge


def _bits(v: Views, value: str, width: str, *keys: str) -> DataFrame:
    t = v.timings.where("dir = 1").join(v.metadata.where("type in (1, 2, 3)").select("hash", "type", "orig_node", "scid"), "hash")
    return bitmaps.bitmap_rollup(t, bitmaps.dictionary(t, value, "net_timestamp"), value, width, *keys)


def _both(v: Views, width: str, wide: str | None, *keys: str, only: str = "true") -> DataFrame:
    by = [F.window("bucket", wide).start.alias("bucket")] if wide else []
    outer, inner = (bitmaps.distinct_counts(_bits(v, x, width, *keys).where(only), *by, *keys).withColumnRenamed("distinct", n) for x, n in (("hash", "unique_outer"), ("inner_hash", "unique_inner")))
    names = [*(["bucket"] if wide else []), *keys]
    return outer.join(inner.drop("receipts"), names)


query("t7_exact_6h", f"WITH {_RECEIPTS} SELECT {ts('time_bucket(INTERVAL 6 HOUR, net_timestamp)')} AS bucket, CAST(type AS BIGINT) AS type, count(*) AS receipts, count(DISTINCT hash) AS unique_outer, count(DISTINCT inner_hash) AS unique_inner FROM inb GROUP BY time_bucket(INTERVAL 6 HOUR, net_timestamp), type")(
    lambda v: longs(said(_both(v, "10 minutes", "6 hours", "type"), "bucket")))
query("t9_exact_nodes", f"WITH {_RECEIPTS} SELECT orig_node, count(*) AS receipts, count(DISTINCT hash) AS unique_outer, count(DISTINCT inner_hash) AS unique_inner FROM inb WHERE type=2 AND orig_node IS NOT NULL GROUP BY 1")(
    lambda v: _both(v, "1 hour", None, "orig_node", only="orig_node is not null"))
query("t10_exact_scids", f"WITH {_RECEIPTS} SELECT {ts('time_bucket(INTERVAL 12 HOUR, net_timestamp)')} AS bucket, scid, CAST(type AS BIGINT) AS type, count(*) AS receipts, count(DISTINCT hash) AS unique_outer, count(DISTINCT inner_hash) AS unique_inner FROM inb WHERE scid IS NOT NULL GROUP BY time_bucket(INTERVAL 12 HOUR, net_timestamp), scid, type")(
    lambda v: longs(said(_both(v, "1 hour", "12 hours", "scid", "type", only="scid is not null"), "bucket")))


def peers_exactly(v: Views) -> DataFrame:
    """T8 over ten-minute pages, and peers of whole hours, which ten-minute counts alone cannot give."""
    t = v.timings.where("dir = 1")
    pages = bitmaps.bitmap_rollup(t, bitmaps.dictionary(t, "peer_hash", "net_timestamp"), "peer_hash", "10 minutes", "collector")
    ten = bitmaps.distinct_counts(pages, "bucket", "collector").groupBy(F.date_trunc("hour", "bucket").alias("hour"), "collector").agg(F.max("distinct").alias("peers"))
    whole = bitmaps.distinct_counts(pages, F.date_trunc("hour", "bucket").alias("hour"), "collector").select("hour", "collector", F.col("distinct").alias("hourly"))
    return said(ten.join(whole, ["hour", "collector"]), "hour")


query("t8_exact_peers", f"WITH pc AS (SELECT time_bucket(INTERVAL 10 MINUTE, net_timestamp) AS b, collector, count(DISTINCT peer_hash) AS peers FROM timings WHERE dir=1 GROUP BY 1,2), ph AS (SELECT date_trunc('hour', b) AS h, collector, max(peers) AS peers FROM pc GROUP BY 1,2), hh AS (SELECT date_trunc('hour', net_timestamp) AS h, collector, count(DISTINCT peer_hash) AS hourly FROM timings WHERE dir=1 GROUP BY 1,2) SELECT {ts('ph.h')} AS hour, ph.collector, peers, hourly FROM ph JOIN hh ON ph.h=hh.h AND ph.collector=hh.collector")(peers_exactly)

# Distances

_HOPS = "lb AS (SELECT src AS x, dst AS y FROM links UNION SELECT dst, src FROM links), hp(x, y, h) USING KEY (x, y) AS (SELECT DISTINCT x, x, 0 FROM lb UNION SELECT hp.x, lb.y, min(hp.h)+1 FROM hp JOIN lb ON hp.y=lb.x LEFT JOIN recurring.hp AS known ON known.x=hp.x AND known.y=lb.y WHERE known.x IS NULL GROUP BY hp.x, lb.y)"
query("g7_neighbourhood", f"WITH {_HOPS}, n AS (SELECT h, count(*) AS c FROM hp GROUP BY 1) SELECT CAST(h AS BIGINT) AS hops, CAST(sum(c) OVER (ORDER BY h) AS BIGINT) AS pairs FROM n")(
    lambda v: distances.exact_neighbourhood(v.links))
query("g7_distances", f"WITH {_HOPS} SELECT count(*) AS pairs, round(avg(h),6) AS mean_hops FROM hp WHERE h>0")(
    lambda v: r6(distances.distance_summary(distances.exact_neighbourhood(v.links)).select("pairs", "mean_hops"), "mean_hops"))
query("g7_diameter", f"WITH {_HOPS}, m AS (SELECT x, min(y) AS c FROM hp GROUP BY 1), k AS (SELECT c, count(*) AS n FROM m GROUP BY 1 ORDER BY n DESC, c LIMIT 1) SELECT (SELECT n FROM k) AS vertices, CAST(max(h) AS BIGINT) AS diameter FROM hp JOIN m ON m.x=hp.x JOIN k ON m.c=k.c")(
    lambda v: distances.diameter(v.links).select("vertices", "diameter"))
for _name in ("g7_neighbourhood", "g7_distances", "g7_diameter"):
    SQL[_name] = SQL[_name].replace("WITH ", "WITH RECURSIVE ", 1)

# Captured flows

_OURS = "203.0.113.5"
_ORIENTED = f"ow AS (SELECT pkt_id, ts, bytes, CASE WHEN src_ip='{_OURS}' THEN src_port ELSE dst_port END AS local_port, CASE WHEN src_ip='{_OURS}' THEN dst_ip ELSE src_ip END AS remote_ip, CASE WHEN src_ip='{_OURS}' THEN dst_port ELSE src_port END AS remote_port FROM captured WHERE src_ip='{_OURS}' OR dst_ip='{_OURS}'), " + _INTERVALS.replace("FROM packets", "FROM ow")
query("g18_captured_totals", f"WITH {_ORIENTED} SELECT uuid, count(*) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes, count(DISTINCT (local_port, remote_ip, remote_port)) AS connections, count(DISTINCT remote_ip) AS peers FROM fl WHERE uuid IS NOT NULL GROUP BY 1")(
    lambda v: attribution.flow_totals(attribution.captured_flows(v.captured, v.samples, _OURS)[0]))
query("g18_captured_lost", f"WITH {_ORIENTED} SELECT remote_ip, count(*) AS packets FROM (SELECT remote_ip FROM fl WHERE uuid IS NULL UNION ALL SELECT dst_ip FROM captured WHERE src_ip<>'{_OURS}' AND dst_ip<>'{_OURS}') GROUP BY 1")(
    lambda v: attribution.captured_flows(v.captured, v.samples, _OURS)[1])

# One array in one file


def array_read(v: Views) -> DataFrame:
    """All nodes as one JSON array in one file, with braces, quotes and brackets in their aliases, read in ranges of 64 kB."""
    root, spark = folder(v, "array"), v.timings.sparkSession
    odd = F.concat("alias", F.element_at(F.array(*map(F.lit, ('}"', '{[\\', "]", '\\"}', ",{"))), (F.col("active") % 5 + 1).cast("int")))
    rows = v.features.select("pubkey", odd.alias("alias"), "sockets", F.struct("active", "asn").alias("more"))
    text = rows.select(F.to_json(F.struct("*")).alias("o")).agg(F.concat(F.lit("[\n"), F.concat_ws(",\n ", F.collect_list("o")), F.lit("\n]\n")).alias("value"))
    text.coalesce(1).write.text(f"{root}/nodes")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        found = json_array.read_json_array(spark, f"{root}/nodes", "pubkey string, alias string, sockets string, more struct<active: long, asn: long>")
        out = found.select("pubkey", "alias", "sockets", "more.active", "more.asn")
        found.inputFiles()  # the ranges are chosen as the plan is made
        return out
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


query("s18_one_large_array", """SELECT pubkey, concat(alias, CASE active%5 WHEN 0 THEN '}"' WHEN 1 THEN '{[\\' WHEN 2 THEN ']' WHEN 3 THEN '\\"}' ELSE ',{' END) AS alias, sockets, active, asn FROM features""")(array_read)
