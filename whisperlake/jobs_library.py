"""Queries that run the column functions, the sources and the jobs over whole tables, with SQL that says what they must give.

A job writes to a folder of its own below the shared one, and the query returns what is read back from there.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whisperlake import functions as fn
from whisperlake.fixtures import Views
from whisperlake.library import day, longs, query, r6, said, ts
from whisperlake.operators import diagnostics, legacy, rates
from whisperlake.plans.scratch import shared_dir
from whisperlake.sources import files
from whisperlake.streaming import ingest

FAR = dt.datetime(2100, 1, 1)


def folder(v: Views, name: str) -> str:
    return f"{shared_dir(v.timings.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Functions

_BYTES = ", ".join(f"format('{{:02X}}', (scid>>{8 * k})&255)" for k in range(8))
query("f1_f2_bytes_of_ids", f"SELECT scid, concat({_BYTES}) AS le_hex, CAST(scid AS VARCHAR) AS back FROM channels")(
    lambda v: v.channels.select("scid", F.hex(fn.u64_to_le_bytes("scid")).alias("le_hex"), fn.le_bytes_to_u64(fn.u64_to_le_bytes("scid")).cast("string").alias("back")))
_WORD = "CASE typ WHEN 1 THEN 'ca' WHEN 2 THEN 'na' WHEN 3 THEN 'cu' WHEN 4 THEN 'ping' ELSE 'other' END"
query("f5_f6_types", f"SELECT {_WORD} AS word, CASE WHEN typ<=4 THEN CAST(typ AS BIGINT) END AS code, CASE typ WHEN 1 THEN 'channel_announcement' WHEN 2 THEN 'node_announcement' WHEN 3 THEN 'channel_update' WHEN 4 THEN 'ping' ELSE 'unknown' END AS name, count(*) AS n FROM g_base GROUP BY 1,2,3")(
    lambda v: longs(v.g_base.select(F.expr(_WORD).alias("word")).select("word", fn.type_code("word").alias("code"), fn.type_name(fn.type_code("word"), "unknown").alias("name")).groupBy("word", "code", "name").agg(F.count(F.lit(1)).alias("n"))))
query("f7_message_hash", "SELECT count(DISTINCT raw) AS distinct_hashes, count(*) AS rows_hashed FROM messages")(
    lambda v: v.messages.agg(F.countDistinct(fn.message_hash("raw")).alias("distinct_hashes"), F.count(F.lit(1)).alias("rows_hashed")))
query("f8_f9_parsing", f"SELECT event_id, {ts('ts')} AS at, CASE WHEN event_id%3=0 THEN NULL ELSE concat('x',user_id) END AS text FROM g_base")(
    lambda v: said(v.g_base.select("event_id", fn.micros_to_ts(F.unix_micros("ts").cast("string")).alias("at"), fn.empty_to_null(F.expr("if(event_id % 3 = 0, '', concat('x', user_id))")).alias("text")), "at"))
query("f10_f12_buckets", f"SELECT event_id, {ts('time_bucket(INTERVAL 10 MINUTE, ts)')} AS bucket, round((epoch_us(ts)-epoch_us(time_bucket(INTERVAL 10 MINUTE, ts)))/1e6,6) AS inside FROM g_base")(
    lambda v: said(r6(v.g_base.withColumn("bucket", fn.time_bucket("10 minutes", "ts")).select("event_id", "bucket", fn.epoch_diff("ts", "bucket").alias("inside")), "inside"), "bucket"))
_WINDOWS = ("90m", "36h", "3d")
query("f14_time_windows", " UNION ALL ".join(f"SELECT '{w}' AS w, count(*) AS receipts FROM timings WHERE net_timestamp > (SELECT max(net_timestamp) FROM timings) - INTERVAL {n} MINUTE" for w, n in zip(_WINDOWS, (90, 2160, 4320))))(
    lambda v: v.timings.crossJoin(F.broadcast(v.timings.agg(F.max("net_timestamp").alias("top")))).select("net_timestamp", "top", F.explode(F.array(*map(F.lit, _WINDOWS))).alias("w"))
    .where(" or ".join(f"(w = '{w}' and net_timestamp > top - interval {fn.parse_time_window(w)})" for w in _WINDOWS)).groupBy("w").agg(F.count(F.lit(1)).alias("receipts")))
# addresses of many kinds, from the customers' keys
_ADDRESS = "CASE c_custkey%8 WHEN 0 THEN concat(c_custkey%256,'.',c_nationkey,'.',c_custkey%250,'.9:9735') WHEN 1 THEN concat('172.',c_custkey%40,'.3.4:9735') WHEN 2 THEN concat('192.168.',c_custkey%250,'.1:9735') WHEN 3 THEN concat('[2001:db8::',c_custkey%99,']:9735') WHEN 4 THEN concat(repeat('q',56),'.onion:9735') WHEN 5 THEN concat('abc',c_custkey,'.onion:9735') WHEN 6 THEN concat('node',c_custkey,'.example.com:9735') ELSE '[fe80::1]:9735' END"
_IP = "CAST(split_part(address,'.',{k}) AS INT)"
query("f15_f21_addresses", f"""WITH a AS (SELECT c_custkey, {_ADDRESS} AS address FROM customer), b AS (SELECT *, c_custkey%8 AS k FROM a)
    SELECT c_custkey, address, k IN (0,1,2,3,7) AS clearnet, k IN (4,5) AS tor, CASE WHEN k IN (4,5) THEN 'tor' WHEN k=6 THEN 'none' ELSE 'clearnet' END AS net,
    CASE WHEN k=0 THEN NOT ({_IP.format(k=1)} IN (10,127) OR {_IP.format(k=1)}>=240 OR ({_IP.format(k=1)}=172 AND {_IP.format(k=2)} BETWEEN 16 AND 31) OR ({_IP.format(k=1)}=192 AND {_IP.format(k=2)}=168) OR ({_IP.format(k=1)}=100 AND {_IP.format(k=2)} BETWEEN 64 AND 127) OR ({_IP.format(k=1)}=169 AND {_IP.format(k=2)}=254)
        OR ({_IP.format(k=1)}=192 AND {_IP.format(k=2)}=0 AND {_IP.format(k=3)}=2) OR ({_IP.format(k=1)}=198 AND {_IP.format(k=2)}=51 AND {_IP.format(k=3)}=100) OR ({_IP.format(k=1)}=203 AND {_IP.format(k=2)}=0 AND {_IP.format(k=3)}=113))
        WHEN k=1 THEN NOT {_IP.format(k=2)} BETWEEN 16 AND 31 WHEN k IN (2,5,7) THEN false ELSE true END AS reachable,
    CASE WHEN k IN (4,5) THEN 'onion' ELSE 'remainder' END AS class, concat('p',c_custkey) AS pubkey, address AS target FROM b""")(
    lambda v: v.customer.select("c_custkey", F.expr(_ADDRESS).alias("address")).withColumn("p", fn.parse_peer_specifier(F.concat(F.lit("p"), "c_custkey", F.lit("@"), "address")))
    .select("c_custkey", "address", fn.is_clearnet("address").alias("clearnet"), fn.is_tor("address").alias("tor"), fn.net_type("address").alias("net"), fn.ip_reachability("address").alias("reachable"), fn.address_class("address").alias("class"), "p.pubkey", F.col("p.address").alias("target")))
query("f22_f24_ages", "WITH a AS (SELECT pubkey, alias, sockets, 1800000000-first_seen AS age FROM features) SELECT pubkey, CASE WHEN age<=3600 THEN 'hour' WHEN age<=86400 THEN 'day' WHEN age<=604800 THEN 'week' WHEN age<=1209600 THEN 'two_weeks' WHEN age<=2419200 THEN 'month' WHEN age<=7257600 THEN 'three_months' WHEN age<=14515200 THEN 'six_months' WHEN age<=29030400 THEN 'year' ELSE 'other' END AS bin, CAST(floor(age/86400.0) AS BIGINT) AS days FROM a")(
    lambda v: v.features.select("pubkey", fn.recency_bin(F.lit(1_800_000_000) - F.col("first_seen")).alias("bin"), fn.age_days("first_seen", 1_800_000_000).alias("days")))
_CLASS = "CASE c_custkey%9 WHEN 0 THEN '127.0.0.1:9735' WHEN 1 THEN '0.0.0.0:9735' WHEN 2 THEN '[::]:9735' WHEN 3 THEN 'localhost:1' WHEN 4 THEN concat('k',c_custkey,'.onion:9735') WHEN 5 THEN concat('k',c_custkey,'.onion') WHEN 6 THEN '[::1]:9735' WHEN 7 THEN concat('onion',c_custkey,'.org:1') ELSE concat('10.0.1.',c_custkey%250,':1') END"
query("f21_address_class", "SELECT c_custkey, CASE WHEN c_custkey%9<4 THEN 'localhost' WHEN c_custkey%9=4 THEN 'onion' ELSE 'remainder' END AS class FROM customer")(
    lambda v: v.customer.select("c_custkey", fn.address_class(F.expr(_CLASS)).alias("class")))
_ALIAS = "CASE c_custkey%8 WHEN 0 THEN concat('LNT',c_custkey) WHEN 1 THEN concat('node',c_custkey,'.com') WHEN 2 THEN concat('LNT.',c_custkey) WHEN 3 THEN concat('x',c_custkey,'.info') WHEN 4 THEN concat('y',c_custkey,'.network') WHEN 5 THEN concat('z',c_custkey,'.co.uk') WHEN 6 THEN 'LNT.biz' ELSE concat('plain',c_custkey,'.me.') END"
query("f23_alias_clean", "SELECT c_custkey, CASE c_custkey%8 WHEN 0 THEN concat('LNT',c_custkey) WHEN 1 THEN concat('node',c_custkey) WHEN 2 THEN '' WHEN 3 THEN concat('x',c_custkey,'.info') WHEN 4 THEN concat('y',c_custkey) WHEN 5 THEN concat('z',c_custkey,'.co') WHEN 6 THEN 'LNT' ELSE concat('plain',c_custkey,'.me.') END AS alias FROM customer")(
    lambda v: v.customer.select("c_custkey", fn.alias_clean(F.expr(_ALIAS)).alias("alias")))
_MANY = "array(concat('k',c_custkey,'.onion:1'), concat('1.2.3.',c_custkey%250,':1'), concat('k',c_custkey,'.onion:1'), '9.9.9.9:1')"
query("f25_f26_addresses_once", "SELECT c_custkey, concat('k',c_custkey,'.onion:1,1.2.3.',c_custkey%250,':1,9.9.9.9:1') AS once, concat('1.2.3.',c_custkey%250,':1,9.9.9.9:1,k',c_custkey,'.onion:1') AS preferred FROM customer")(
    lambda v: v.customer.select("c_custkey", F.array_join(fn.address_dedupe(F.expr(_MANY)), ",").alias("once"), F.array_join(fn.endpoint_preference(F.expr(_MANY)), ",").alias("preferred")))
query("f27_f30_predicates", "SELECT c_custkey, c_custkey%4<>0 AS sockets, c_custkey%3=0 AS balance FROM customer")(
    lambda v: v.customer.select("c_custkey", fn.has_sockets(F.expr("case c_custkey % 4 when 0 then if(c_custkey % 8 = 0, null, '') else 'x:1' end")).alias("sockets"), fn.has_balance(F.expr("if(c_custkey % 3 = 0, array(c_custkey), array())")).alias("balance")))

# Approximate forms: on few values they are exact

query("a3_approx_distinct", "SELECT count(DISTINCT collector) AS n FROM timings")(lambda v: v.timings.agg(F.approx_count_distinct("collector", 0.01).alias("n")))

# Sources and sinks



def line() -> Column:
    """A receipt with its metadata as a collector's line."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    stamp = F.coalesce(F.unix_micros("orig_timestamp").cast("string"), F.lit(""))
    word, way = F.expr("element_at(array('ca','na','cu','ping','pong'), type)"), F.expr("if(dir = 1, 'inbound', 'outbound')")
    return F.concat_ws(",", F.unix_micros("net_timestamp").cast("string"), "peer", word, way, text("size"), text("inner_hash"), F.concat(F.lit("raw-"), text("hash")), stamp, text("orig_node"), text("scid"), "collector")


def lines(v: Views) -> DataFrame:
    """Receipts as the collectors' lines, some of them to a payload; every 50th payload has a broken line besides."""
    full = v.timings.join(v.metadata.drop("inner_hash"), "hash")
    packed = full.groupBy((F.col("row_inc") / 10).cast("long").alias("k")).agg(F.array_join(F.array_sort(F.collect_list(line())), ";").alias("value"))
    return packed.select(F.when(F.col("k") % 50 == 0, F.concat("value", F.lit(";not,a,line"))).otherwise(F.col("value")).alias("value"))


_FULL = "fu AS (SELECT t.*, m.type, m.size, m.orig_node, m.scid FROM timings t JOIN metadata m ON t.hash=m.hash)"
query("s2_decode_lines", f"WITH {_FULL} SELECT collector, peer, {ts('net_timestamp')} AS at, CAST(type AS BIGINT) AS type, CAST(dir AS BIGINT) AS dir, CAST(size AS BIGINT) AS size, CAST(inner_hash AS VARCHAR) AS inner_hash, {ts('orig_timestamp')} AS stamp, orig_node, CAST(scid AS VARCHAR) AS scid FROM fu")(
    lambda v: longs(said(ingest.decode_lines(lines(v)).where("error is null").select("collector", "peer", F.col("net_timestamp").alias("at"), "type", "dir", "size", F.col("inner_hash").cast("string").alias("inner_hash"), F.col("orig_timestamp").alias("stamp"), "orig_node", F.col("scid").cast("string").alias("scid")), "at", "stamp")))
query("s2_bad_lines", "SELECT 'fields' AS error, count(DISTINCT CAST(floor(row_inc/10) AS BIGINT)) AS n FROM timings WHERE CAST(floor(row_inc/10) AS BIGINT)%50=0")(
    lambda v: ingest.decode_lines(lines(v)).where("error is not null").groupBy("error").agg(F.count(F.lit(1)).alias("n")))


def split(v: Views) -> DataFrame:
    parts = ingest.split_tables(ingest.decode_lines(lines(v)))
    key = {"messages": "hash", "metadata": "hash", "message_hashes": "outer_hash", "timings": "row_inc"}
    found = [parts[n].agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n"), F.countDistinct(k).alias("keys")) for n, k in key.items()]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


query("s3_split_tables", "WITH n AS (SELECT count(*) AS n, count(DISTINCT hash) AS h FROM timings) SELECT 'messages' AS name, n, h AS keys FROM n UNION ALL SELECT 'metadata', n, h FROM n UNION ALL SELECT 'message_hashes', n, h FROM n UNION ALL SELECT 'timings', n, n FROM n")(split)


def ingested(v: Views) -> str:
    """The lines through the streaming job, a file at a time."""
    spark, root = v.timings.sparkSession, folder(v, "ingest")
    lines(v).repartition(3).write.text(f"{root}/lines")
    stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 2).text(f"{root}/lines")
    ingest.ingest(stream, f"{root}/tables", f"{root}/checkpoint").awaitTermination()
    return f"{root}/tables"


def ingest_counts(v: Views) -> DataFrame:
    spark, root = v.timings.sparkSession, ingested(v)
    t = spark.read.parquet(f"{root}/timings")
    rows = t.agg(F.lit("timings").alias("name"), F.count(F.lit(1)).alias("n"), F.countDistinct("row_inc").alias("keys"))
    for name, key in (("messages", "hash"), ("metadata", "hash"), ("message_hashes", "outer_hash")):
        rows = rows.unionByName(spark.read.parquet(f"{root}/{name}").agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("keys")))
    return rows


query("s5_ingest_stream", "WITH n AS (SELECT count(*) AS n, count(DISTINCT hash) AS h FROM timings) SELECT 'messages' AS name, h AS n, h AS keys FROM n UNION ALL SELECT 'metadata', h, h FROM n UNION ALL SELECT 'message_hashes', h, h FROM n UNION ALL SELECT 'timings', n, n FROM n")(ingest_counts)


def absent(v: Views) -> DataFrame:
    path = folder(v, "absent")
    for rows in (v.metadata.where("hash % 3 = 0"), v.metadata, v.metadata.limit(0), v.metadata.where("hash % 2 = 0")):
        files.insert_if_absent(rows, path, "hash")
    return files.read_keyed(v.timings.sparkSession, path)


query("s4_insert_if_absent", "SELECT hash, CAST(type AS BIGINT) AS type, CAST(size AS BIGINT) AS size, orig_node, scid FROM metadata")(lambda v: longs(absent(v).select("hash", "type", "size", "orig_node", "scid")))


def stored(v: Views) -> DataFrame:
    path = folder(v, "timings")
    files.append_timings(v.timings, path)
    return v.timings.sparkSession.read.parquet(path)


query("s5_append_timings", f"SELECT {day('net_timestamp')} AS day, count(*) AS receipts, CAST(sum(row_inc) AS BIGINT) AS rows_sum FROM timings GROUP BY 1")(
    lambda v: stored(v).groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("receipts"), F.sum("row_inc").alias("rows_sum")))


def archived(v: Views) -> tuple[str, str, dt.date]:
    """The first day of the table exported, twice, and logged, twice: (root, log, day)."""
    root, first = folder(v, "archive"), v.timings.agg(F.min("net_timestamp")).first()[0].date()
    spark, log = v.timings.sparkSession, f"{root}/log"
    for _ in range(2):
        done = files.export_day(v.timings, first, root)
        files.record_archive(spark, log, first, "timings", done, FAR)
        files.export_companion(v.metadata, v.message_first_seen, "metadata", first, root)
    return root, log, first


def loaded(v: Views) -> DataFrame:
    root, _, first = archived(v)
    found = files.load_range(v.timings.sparkSession, root, first, 1, ("timings", "metadata"))
    one = lambda n, k: found[n].agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n"), F.sum(k).cast("long").alias("keys_sum"))
    return one("timings", "row_inc").unionByName(one("metadata", "hash"))


_FIRST = "fd AS (SELECT date_trunc('day', min(net_timestamp)) AS d FROM timings)"
query("s1_s6_s7_s8_exports", f"WITH {_FIRST} SELECT 'timings' AS name, count(*) AS n, CAST(sum(row_inc) AS BIGINT) AS keys_sum FROM timings, fd WHERE date_trunc('day', net_timestamp)=d UNION ALL SELECT 'metadata', count(*), CAST(sum(m.hash) AS BIGINT) FROM metadata m JOIN message_first_seen f ON m.hash=f.hash, fd WHERE date_trunc('day', first_seen)=d")(loaded)
query("s10_pending_ranges", f"WITH {_FIRST} SELECT DISTINCT {ts('range_start')} AS range_start FROM (SELECT date_trunc('day', net_timestamp) AS range_start FROM timings), fd WHERE range_start<>d")(
    lambda v: said(files.pending_ranges(v.timings, v.timings.sparkSession.read.parquet(archived(v)[1]), 1, FAR), "range_start"))
query("s11_missing_companions", f"WITH {_FIRST} SELECT {ts('d')} AS range_start, unnest(['messages','metadata','message_hashes','message_first_seen']) AS range_table FROM fd")(
    lambda v: said(files.missing_companions(v.timings.sparkSession.read.parquet(archived(v)[1])), "range_start"))
query("s9_d2_archive_log", f"WITH {_FIRST} SELECT {ts('d')} AS range_start, {ts('d + INTERVAL 1 DAY')} AS range_end, 'timings' AS range_table, (SELECT count(*) FROM timings WHERE date_trunc('day', net_timestamp)=d) AS row_count FROM fd")(
    lambda v: said(diagnostics.archive_listing(v.timings.sparkSession.read.parquet(archived(v)[1])).select("range_start", "range_end", "range_table", "row_count"), "range_start", "range_end"))


def retained(v: Views) -> DataFrame:
    """The first day verified, dropped and logged: what is left of the live table, by day."""
    root, log, _ = archived(v)
    spark, live = v.timings.sparkSession, f"{root}/live"
    files.append_timings(v.timings, live)
    verdict = files.retention_verify(spark.read.parquet(live), spark.read.parquet(log), 1, FAR)
    files.retention_apply(verdict, live, f"{root}/gone", FAR, dry_run=False)
    left = spark.read.parquet(live).groupBy(F.col("day").cast("string").alias("day")).agg(F.lit("live").alias("state"), F.count(F.lit(1)).alias("receipts"))
    return left.unionByName(spark.read.parquet(f"{root}/gone").select(F.to_date("range_start").cast("string").alias("day"), F.lit("dropped").alias("state"), F.col("db_rows").alias("receipts")))


query("s12_s13_retention", f"WITH {_FIRST} SELECT {day('net_timestamp')} AS day, CASE WHEN date_trunc('day', net_timestamp)=d THEN 'dropped' ELSE 'live' END AS state, count(*) AS receipts FROM timings, fd GROUP BY 1,2")(retained)


def exported(v: Views) -> DataFrame:
    root = folder(v, "full")
    files.full_export({"metadata": v.metadata, "timings": v.timings}, root, 1000)
    spark = v.timings.sparkSession
    return spark.read.parquet(f"{root}/timings").join(spark.read.parquet(f"{root}/metadata").select("hash", "type"), "hash").groupBy("type").agg(F.count(F.lit(1)).alias("receipts"))


query("s15_full_export", "SELECT CAST(type AS BIGINT) AS type, count(*) AS receipts FROM timings t JOIN metadata m ON t.hash=m.hash GROUP BY 1")(lambda v: longs(exported(v)))


def synced(v: Views) -> DataFrame:
    """Two syncs, the first of which is run again as if it had failed before its state was written."""
    root, spark = folder(v, "sync"), v.timings.sparkSession
    ends = v.timings.agg(F.min("net_timestamp"), F.max("net_timestamp")).first()
    cut = ends[0] + (ends[1] - ends[0]) / 2
    for k, until in enumerate((cut, cut + dt.timedelta(hours=1), FAR)):
        files.incremental_sync(v.timings, {"metadata": v.metadata}, root, until)
        if k == 0:
            files.delete(spark, f"{root}/_sync_state")
    counts = lambda n, k: spark.read.parquet(f"{root}/{n}").agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n"), F.countDistinct(k).alias("keys"))
    return counts("timings", "row_inc").unionByName(counts("metadata", "hash"))


query("s16_incremental_sync", "SELECT 'timings' AS name, count(*) AS n, count(DISTINCT row_inc) AS keys FROM timings UNION ALL SELECT 'metadata', count(*), count(DISTINCT hash) FROM metadata")(synced)


def text_round(v: Views) -> DataFrame:
    """Nodes through partitioned CSV, typed again, with the region of their network, and through JSON lists."""
    root, spark = folder(v, "text"), v.timings.sparkSession
    nodes = v.features.select("pubkey", "alias", F.col("asn").cast("string").alias("iso_code"), (F.col("active") % 3).alias("community"))
    files.write_csv(nodes, f"{root}/csv", "community")
    regions = v.features.select(F.col("asn").cast("string").alias("iso_code")).where("iso_code is not null").distinct().withColumn("region", F.concat(F.lit("r"), "iso_code"))
    regions.write.option("sep", "\t").option("header", True).csv(f"{root}/regions")
    typed = files.read_csv_typed(spark, f"{root}/csv", "pubkey string, alias string, iso_code string, community int")
    path = files.write_graph_json({"nodes": files.region_lookup(typed, f"{root}/regions")}, root, dt.datetime(2024, 1, 2, 3, 4))
    return spark.read.schema("pubkey string, alias string, region string, community long").json(f"{path}/nodes")


query("s17_s21_s23_text_tables", "SELECT pubkey, alias, CASE WHEN asn IS NOT NULL THEN concat('r',asn) END AS region, active%3 AS community FROM features")(text_round)


def json_lists(v: Views) -> DataFrame:
    root, spark = folder(v, "lists"), v.timings.sparkSession
    parts = [v.features.where("active % 2 = 0").select("pubkey"), v.features.where("active % 2 = 1").select("pubkey", "alias")]
    for k, p in enumerate(parts):
        # an array of some objects to a file, as scrapers leave them
        listed = p.select(F.to_json(F.struct("*")).alias("j"), F.pmod(F.xxhash64("pubkey"), F.lit(16)).alias("g")).groupBy("g").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ", "), F.lit("]")).alias("value"))
        listed.select("value").repartition(16).write.option("lineSep", "\n").text(f"{root}/{k}")
    return files.merge_append_json(spark, [f"{root}/0", f"{root}/1"], ["pubkey string", "pubkey string, alias string"])


query("s18_s24_json_lists", "SELECT pubkey, CASE WHEN active%2=1 THEN alias END AS alias FROM features")(json_lists)


def samples_read(v: Views) -> DataFrame:
    path = folder(v, "samples")
    rows = v.samples.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in ("epoch", "uuid", "local_port", "remote_ip", "remote_port"))).alias("value"))
    noise = v.samples.select(F.explode(F.array(F.lit("# a comment"), F.concat(F.lit("bad\t"), "uuid"))).alias("value"))
    rows.unionByName(noise).write.text(path)
    return longs(files.read_socket_samples(v.timings.sparkSession, path))


query("s22_socket_samples", "SELECT epoch, uuid, CAST(local_port AS BIGINT) AS local_port, remote_ip, CAST(remote_port AS BIGINT) AS remote_port FROM samples")(samples_read)

# State, roll-ups that are refreshed, and diagnostics


def first_seen_job(v: Views) -> DataFrame:
    path, spark = folder(v, "first-seen"), v.timings.sparkSession
    for until in ("2024-01-10", "2024-01-20", "2100-01-01"):
        ingest.update_first_seen(v.timings.where(F.col("net_timestamp") < F.lit(until).cast("timestamp")), path, until, "100 years")
    return said(files.read_keyed(spark, path), "first_seen")


query("k1_update_first_seen", f"SELECT hash, {ts('first_seen')} AS first_seen FROM message_first_seen")(first_seen_job)


def deduped(v: Views) -> DataFrame:
    root, spark = folder(v, "dedupe"), v.timings.sparkSession
    v.timings.select("hash", "net_timestamp").write.parquet(f"{root}/in")
    stream = spark.readStream.schema("hash long, net_timestamp timestamp").option("maxFilesPerTrigger", 4).parquet(f"{root}/in")
    out = ingest.dedupe_stream(stream, "1000 days").writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("hash").agg(F.count(F.lit(1)).alias("n"))


query("k3_dedupe_stream", "SELECT DISTINCT hash, CAST(1 AS BIGINT) AS n FROM timings")(deduped)


def refreshed(v: Views) -> DataFrame:
    """Hourly receipts made once over all days, then again over some of them from fewer receipts: just those days change."""
    path, spark = folder(v, "refresh"), v.timings.sparkSession
    build = lambda t: rates.message_rate(t, v.metadata)
    from whisperlake.operators import rollups

    rollups.refresh(build, v.timings, path, "2000-01-01", "2100-01-01")
    rollups.refresh(build, v.timings.where("row_inc % 2 = 0"), path, "2024-01-10 05:00:00", "2024-01-12 00:00:00")
    return longs(said(spark.read.parquet(path).select("bucket", "type", "receipts"), "bucket"))


query("c9_refresh", f"SELECT {ts('b')} AS bucket, CAST(type AS BIGINT) AS type, receipts FROM (SELECT date_trunc('hour', net_timestamp) AS b, type, count(*) AS receipts FROM timings t JOIN metadata m ON t.hash=m.hash WHERE dir=1 AND m.type IN (1,2,3) AND (row_inc%2=0 OR net_timestamp < TIMESTAMP '2024-01-10' OR net_timestamp >= TIMESTAMP '2024-01-12') GROUP BY 1,2)")(refreshed)
query("d6_shares", "WITH a AS (SELECT orig_node, count(*) AS messages FROM metadata WHERE orig_node IS NOT NULL GROUP BY 1) SELECT orig_node, messages, round(messages*100.0/(SELECT sum(messages) FROM a),6) AS pct FROM a")(
    lambda v: r6(diagnostics.shares(legacy.entity_frequency(v.metadata, "orig_node").select("orig_node", "messages"), "messages"), "pct"))
query("d8_status", "WITH h AS (SELECT collector, arg_max(peer_hash, row_inc) AS peers FROM timings WHERE collector<>'n3' GROUP BY 1), r AS (SELECT DISTINCT collector FROM timings UNION SELECT 'n99') SELECT CAST(coalesce(sum(peers),0) AS BIGINT) AS peers, CAST(count(peers)*10 AS BIGINT) AS target, count(peers) AS online, count(*) FILTER (peers IS NULL) AS offline, string_agg(r.collector, ',' ORDER BY r.collector) FILTER (peers IS NULL) AS offline_ids FROM r LEFT JOIN h ON r.collector=h.collector")(
    lambda v: diagnostics.status(v.timings.where("collector <> 'n3'").select(F.col("collector").alias("uuid"), F.col("row_inc").alias("ts"), F.col("peer_hash").alias("peers"), F.lit(10).cast("long").alias("target")), v.timings.select(F.col("collector").alias("uuid")).union(v.timings.select(F.lit("n99"))).distinct()).withColumn("offline_ids", F.array_join("offline_ids", ",")))
_REG = "rg AS (SELECT concat('u', CASE WHEN c_custkey%10=0 THEN c_custkey+1 ELSE c_custkey END) AS uuid, concat('h', c_nationkey) AS host, c_custkey%7 AS port FROM customer), mp AS (SELECT concat('u', c_custkey+5) AS uuid, c_custkey%12 AS community FROM customer WHERE c_custkey%12<>3), cm AS (SELECT level_0 AS community, count(*) AS size FROM membership GROUP BY 1)"
query("d9_registry_audit", f"""WITH {_REG} SELECT 'duplicate_id' AS "check", uuid AS subject, count(*) AS n FROM rg GROUP BY uuid HAVING count(*)>1 UNION ALL SELECT 'socket_conflict', concat(host, ':', port), count(*) FROM rg GROUP BY host, port HAVING count(*)>1 UNION ALL SELECT 'unknown_id', uuid, 1 FROM mp WHERE uuid NOT IN (SELECT uuid FROM rg)
    UNION ALL SELECT 'uncovered_community', CAST(community AS VARCHAR), size FROM cm WHERE community NOT IN (SELECT community FROM mp) UNION ALL SELECT 'collectors_on_host', host, count(*) FROM rg GROUP BY host""")(
    lambda v: diagnostics.registry_audit(
        v.customer.select(F.expr("concat('u', if(c_custkey % 10 = 0, c_custkey + 1, c_custkey))").alias("uuid"), F.expr("concat('h', c_nationkey)").alias("host"), (F.col("c_custkey") % 7).alias("port")),
        v.customer.where("c_custkey % 12 <> 3").select(F.expr("concat('u', c_custkey + 5)").alias("uuid"), (F.col("c_custkey") % 12).alias("community")),
        v.membership.groupBy(F.col("level_0").alias("community")).agg(F.count(F.lit(1)).alias("size"))))
