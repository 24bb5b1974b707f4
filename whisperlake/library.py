"""The gossip queries by name, over whole tables, each with the SQL that DuckDB checks it with where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from whisperlake import functions as fn
from whisperlake.fixtures import Views, with_views
from whisperlake.operators import attribution, diagnostics, graph, legacy, propagation, rates, rollups
from whisperlake.sources import files
from whisperlake.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = 1_800_000_000


def query(name: str, sql: str | None = None):
    def add(build: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return build(Views(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = with_views(sql)
        return build

    return add


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in cols})


def percentiles(df: DataFrame, *cols: str) -> DataFrame:
    """To 6 places, off the ties that two ways of interpolating may break apart."""
    return df.withColumns({c: F.round(F.col(c) + 1e-8, 6) for c in cols or P})


def said(df: DataFrame, *cols: str) -> DataFrame:
    """Times and days as text: engines disagree on their types, not on these."""
    return df.withColumns({c: (F.col(c).cast("string") if dict(df.dtypes)[c] == "date" else fn.text_of(c)) for c in cols})


def longs(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c, k in df.dtypes if k in ("int", "smallint", "tinyint")})


TEXT = "strftime({}, '%Y-%m-%d %H:%M:%S')"
ts = TEXT.format
day = lambda c: f"strftime({c}, '%Y-%m-%d')"
delay = lambda a, b: f"(epoch_us({a})-epoch_us({b}))/1e6"
HOUR, DAY = "date_trunc('hour', net_timestamp)", "date_trunc('day', net_timestamp)"
pcts = lambda c: ", ".join(f"round(quantile_cont({c}, {p}) + 1e-8, 6) AS {n}" for n, p in propagation.PROBS.items())
P = [*propagation.PROBS]

# Summaries over raw receipts

query("l1_convergence_delay_summary", "WITH f AS (SELECT hash, min(net_timestamp) AS t0, count(*) AS n FROM timings GROUP BY hash), k AS (SELECT hash, t0, n FROM f WHERE n >= 0.02*(SELECT count(DISTINCT peer_hash) FROM timings)), p AS (SELECT k.hash, k.n, "
      + ", ".join(f"quantile_cont({delay('net_timestamp', 't0')}, {p}) AS {n}" for n, p in legacy.CONVERGENCE.items()) + " FROM timings t JOIN k ON t.hash=k.hash GROUP BY k.hash, k.n) SELECT "
      + ", ".join(f"round(avg({n}),4) AS avg_{n}" for n in legacy.CONVERGENCE) + ", count(*) AS messages, round(avg(n),4) AS avg_total_peers FROM p")(
    lambda v: (lambda d: d.withColumns({c: F.round(c, 4) for c, k in d.dtypes if k == "double"}))(legacy.convergence_delay_summary(v.timings, 0.02)))
query("l2_total_size_max_peers", "SELECT CAST((SELECT sum(size) FROM metadata) AS BIGINT) AS total_size, (SELECT count(DISTINCT peer_hash) FROM timings) AS max_peers")(
    lambda v: legacy.total_size_max_peers(v.timings, v.metadata))
NAMES = "CASE type WHEN 1 THEN 'channel_announcement' WHEN 2 THEN 'node_announcement' WHEN 3 THEN 'channel_update' WHEN 4 THEN 'ping' WHEN 5 THEN 'pong' END"
query("l3_type_proportions", f"SELECT CAST(type AS BIGINT) AS type, {NAMES} AS type_name, count(DISTINCT hash) AS messages, round(count(DISTINCT hash)*100.0/(SELECT count(DISTINCT hash) FROM metadata),6) AS pct FROM metadata GROUP BY type")(
    lambda v: longs(r6(legacy.type_proportions(v.metadata), "pct")))
HOURS = delay("max(net_timestamp)", "min(net_timestamp)") + "/3600"
query("l4_unique_rate", f"SELECT count(DISTINCT hash) AS unique_messages, {ts('min(net_timestamp)')} AS first_ts, {ts('max(net_timestamp)')} AS last_ts, round({HOURS},6) AS hours, round(count(DISTINCT hash)/({HOURS}),6) AS per_hour, round(count(DISTINCT hash)/({HOURS})/60,6) AS per_minute FROM timings")(
    lambda v: said(r6(legacy.unique_rate(v.timings), "hours", "per_hour", "per_minute"), "first_ts", "last_ts"))
query("l5_peers_per_message", "WITH a AS (SELECT hash, count(*) AS receipts FROM timings GROUP BY hash) SELECT receipts, count(*) AS messages, round(count(*)*100.0/(SELECT count(*) FROM a),2) AS pct FROM a GROUP BY receipts")(
    lambda v: r6(legacy.peers_per_message(v.timings), "pct"))
query("l6_top_scids", "SELECT scid, count(*) AS messages, round(count(*)*100.0/(SELECT count(*) FROM metadata WHERE scid IS NOT NULL),6) AS pct FROM metadata WHERE scid IS NOT NULL GROUP BY scid ORDER BY messages DESC, scid LIMIT 10")(
    lambda v: r6(legacy.entity_frequency(v.metadata, "scid", top=10), "pct"))
for _id, _e in (("l6_scid_frequency", "scid"), ("l8_node_frequency", "orig_node")):
    query(_id, f"SELECT {_e}, count(*) AS messages, round(count(*)*100.0/(SELECT count(*) FROM metadata WHERE {_e} IS NOT NULL),6) AS pct FROM metadata WHERE {_e} IS NOT NULL GROUP BY {_e}")(
        lambda v, e=_e: r6(legacy.entity_frequency(v.metadata, e), "pct"))
query("l7_scid_update_summary", "WITH a AS (SELECT m.scid, count(DISTINCT t.hash) AS n, count(DISTINCT orig_timestamp) AS s FROM timings t JOIN metadata m ON t.hash=m.hash WHERE m.type=3 AND m.scid IS NOT NULL AND orig_timestamp IS NOT NULL GROUP BY m.scid) SELECT 'scids' AS metric, CAST(count(*) AS DOUBLE) AS value FROM a UNION ALL SELECT 'scids_with_updates', CAST(count(*) FILTER (s>1) AS DOUBLE) FROM a UNION ALL SELECT 'mean_messages', round(avg(n),2) FROM a UNION ALL SELECT 'max_timestamps', CAST(max(s) AS DOUBLE) FROM a")(
    lambda v: legacy.scid_update_summary(v.timings, v.metadata))
query("l9_rates_by_type", f"WITH h AS (SELECT {HOURS} AS h FROM timings), a AS (SELECT type, count(*) AS receipts, count(DISTINCT t.hash) AS u FROM timings t JOIN metadata m ON t.hash=m.hash GROUP BY type) SELECT CAST(type AS BIGINT) AS type, CASE WHEN type<=3 THEN {NAMES} ELSE 'other' END AS type_name, receipts, u AS unique_messages, round(receipts/h,6) AS receipts_per_hour, round(receipts/(h*60),6) AS receipts_per_minute, round(u/h,6) AS unique_per_hour, round(u/(h*60),6) AS unique_per_minute FROM a, h")(
    lambda v: longs(r6(legacy.rates_by_type(v.timings, v.metadata), "receipts_per_hour", "receipts_per_minute", "unique_per_hour", "unique_per_minute")))
query("l10_active_peers_15m", f"WITH a AS (SELECT time_bucket(INTERVAL 15 MINUTE, net_timestamp) AS b, count(DISTINCT peer_hash) AS peers FROM timings GROUP BY 1) SELECT {ts('b')} AS interval_start, {ts('b + INTERVAL 15 MINUTE')} AS interval_end, peers FROM a")(
    lambda v: said(legacy.active_peers(v.timings), "interval_start", "interval_end"))
# the driver's peers rarely ping twice, so peers are taken as they are; types 4 and 5 are signups and errors there
PAIRS = f"r AS (SELECT t.*, m.type FROM timings t JOIN metadata m ON t.hash=m.hash WHERE (m.type=4 AND dir=2) OR (m.type=5 AND dir=1)), w AS (SELECT *, last_value(CASE WHEN type=4 THEN row_inc END IGNORE NULLS) OVER (PARTITION BY peer ORDER BY row_inc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ping_row, last_value(CASE WHEN type=4 THEN net_timestamp END IGNORE NULLS) OVER (PARTITION BY peer ORDER BY row_inc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ping_ts FROM r), pp AS (SELECT peer, ping_row, row_inc AS pong_row, {delay('net_timestamp', 'ping_ts')} AS s FROM w WHERE type=5 AND ping_row IS NOT NULL)"
query("l11_ping_pong_pairs", f"WITH {PAIRS} SELECT peer, ping_row, pong_row, round(s,6) AS response_seconds FROM pp")(
    lambda v: r6(legacy.ping_pong_pairs(v.timings, v.metadata), "response_seconds"))
query("l11_ping_pong_first_only", f"WITH {PAIRS} SELECT peer, ping_row, min(pong_row) AS pong_row, round(arg_min(s, pong_row),6) AS response_seconds FROM pp GROUP BY peer, ping_row")(
    lambda v: r6(legacy.ping_pong_pairs(v.timings, v.metadata, first_only=True), "response_seconds"))
query("l12_ping_pong_stats", f"WITH {PAIRS} SELECT peer, count(*) AS pairs, " + ", ".join(f"round(quantile_cont(s,{p}) + 1e-8,6) AS p{n}" for n, p in ((5, .05), (25, .25), (50, .5), (75, .75), (95, .95))) + " FROM pp GROUP BY peer")(
    lambda v: legacy.ping_pong_stats(legacy.ping_pong_pairs(v.timings, v.metadata)))

# Exact propagation

PROP = f"pr AS (SELECT t.hash, m.type, fs.first_seen, count(DISTINCT peer) AS peers, {', '.join(f'quantile_cont({delay('net_timestamp', 'first_seen')}, {p}) AS {n}' for n, p in propagation.PROBS.items())} FROM timings t JOIN metadata m ON t.hash=m.hash JOIN message_first_seen fs ON t.hash=fs.hash WHERE dir=1 AND m.type IN (1,2,3) AND net_timestamp <= first_seen + INTERVAL 1 HOUR GROUP BY ALL HAVING count(DISTINCT peer) >= 2)"
_prop = lambda v: propagation.propagation(v.timings, v.metadata, v.message_first_seen, peer_cutoff=2, exact=True)
query("p1_outer_propagation", f"WITH {PROP} SELECT hash, CAST(type AS BIGINT) AS type, {ts('first_seen')} AS first_seen, peers, {', '.join(f'round({n} + 1e-8,6) AS {n}' for n in P)} FROM pr")(
    lambda v: longs(said(percentiles(_prop(v)), "first_seen")))
# every message whose sketched number of peers is near the exact one; all must be
_near_peers = lambda v: propagation.propagation(v.timings, v.metadata, v.message_first_seen, peer_cutoff=1).select("hash", "peers").join(_prop(v).select("hash", F.col("peers").alias("exact")), "hash")
query("p1_outer_propagation_approx", f"WITH {PROP} SELECT hash, true AS close FROM pr")(
    lambda v: _near_peers(v).select("hash", (F.abs(F.col("peers") - F.col("exact")) <= F.greatest(F.lit(1.0), 0.1 * F.col("exact"))).alias("close")))
_MED = ", ".join(f"round(quantile_cont({n},0.5),4) AS {n}" for n in P)
query("p1s_summarize_delay", f"WITH {PROP} SELECT {_MED}, count(*) AS messages, CAST(floor(quantile_cont(peers,0.5)) AS BIGINT) AS median_peers FROM pr")(lambda v: propagation.summarize_delay(_prop(v)))
_TALL = f"SELECT 'all' AS label, {_MED}, count(*) AS messages, CAST(floor(quantile_cont(peers,0.5)) AS BIGINT) AS median_peers FROM pr UNION ALL SELECT {NAMES}, {_MED}, count(*), CAST(floor(quantile_cont(peers,0.5)) AS BIGINT) FROM pr GROUP BY type"
query("p1t_propagation_by_type", f"WITH {PROP} {_TALL}")(
    lambda v: propagation.propagation_by_type(v.timings, v.metadata, v.message_first_seen, peer_cutoff=2, exact=True))
OWN = "og AS (SELECT t.*, m.type FROM timings t JOIN metadata m ON t.hash=m.hash WHERE dir=2 AND ((m.type=2 AND m.orig_node=t.collector) OR (m.type IN (1,3) AND EXISTS (SELECT 1 FROM owned o WHERE o.collector=t.collector AND o.scid=m.scid))))"
ELSE = f"{OWN}, oo AS (SELECT DISTINCT og.hash, og.collector AS owner, fs.first_seen AS t0 FROM og JOIN message_first_seen fs ON og.hash=fs.hash), ee AS (SELECT oo.hash, owner, t0, r.collector AS receiver, r.net_timestamp AS rt, {delay('r.net_timestamp', 't0')} AS d FROM oo LEFT JOIN timings r ON r.hash=oo.hash AND r.dir=1 AND r.collector<>owner AND r.net_timestamp>=t0 AND r.net_timestamp<=t0+INTERVAL 1 HOUR)"
query("p2_collector_originated_propagation", f"WITH {ELSE}, rc AS (SELECT hash, count(DISTINCT receiver) AS n FROM ee WHERE receiver IS NOT NULL GROUP BY 1 HAVING count(DISTINCT receiver)>=1) SELECT (SELECT count(*) FROM rc) AS qualifying_messages, count(*) AS total_receipts, (SELECT quantile_cont(n,0.5) FROM rc) AS median_reach, {pcts('d')} FROM ee JOIN rc ON ee.hash=rc.hash WHERE receiver IS NOT NULL")(
    lambda v: percentiles(propagation.originated_propagation(v.timings, v.metadata, v.message_first_seen, v.owned, cutoff=1)))
query("p1b_delay_boxes", f"WITH {PROP} SELECT 'All' AS label, {_MED} FROM pr UNION ALL SELECT 'Updates', {_MED} FROM pr WHERE type=3")(
    lambda v: propagation.delay_boxes(All=propagation.summarize_delay(_prop(v)), Updates=propagation.summarize_delay(_prop(v).where("type = 3"))))
query("p3_distinct_outbound", f"SELECT {day('net_timestamp')} AS day, CAST(type AS BIGINT) AS type, count(DISTINCT t.hash) AS distinct_hash, count(DISTINCT t.inner_hash) AS distinct_inner_hash, count(DISTINCT collector) AS distinct_collector FROM timings t JOIN metadata m ON t.hash=m.hash WHERE dir=2 AND m.type IN (1,2,3) GROUP BY 1,2")(
    lambda v: longs(said(propagation.distinct_outbound(v.timings, v.metadata), "day")))
query("p4_collector_origination", f"WITH {OWN} SELECT {day('net_timestamp')} AS day, CAST(type AS BIGINT) AS type, collector, count(*) AS receipts, count(DISTINCT hash) AS distinct_outer, count(DISTINCT inner_hash) AS distinct_inner FROM og GROUP BY 1,2,3")(
    lambda v: longs(said(propagation.origination(v.timings, v.metadata, v.owned), "day")))
query("p5_collector_fanout", f"WITH {ELSE}, x AS (SELECT {day('t0')} AS day, owner, hash, count(DISTINCT receiver) AS n FROM ee GROUP BY 1,2,3), c AS (SELECT day, owner, count(*) AS originated, count(*) FILTER (n>=1) AS qualifying FROM x GROUP BY 1,2), f AS (SELECT {day('t0')} AS day, owner, count(DISTINCT receiver) AS receivers, count(rt) AS receipts, {pcts('d')} FROM ee GROUP BY 1,2) SELECT c.day, c.owner, originated, qualifying, receivers, receipts, {', '.join(P)} FROM c JOIN f ON c.day=f.day AND c.owner=f.owner")(
    lambda v: said(percentiles(propagation.fanout(v.timings, v.metadata, v.message_first_seen, v.owned, cutoff=1)), "day"))

# Rates and activity

RATE = "SELECT time_bucket(INTERVAL {w}, net_timestamp) AS b, type, count(*) AS receipts, count(DISTINCT t.hash) AS o, count(DISTINCT t.inner_hash) AS i FROM timings t JOIN metadata m ON t.hash=m.hash WHERE dir=1 AND m.type IN (1,2,3) GROUP BY 1,2"
query("p6_message_rate_hourly", f"WITH a AS ({RATE.format(w='1 HOUR')}) SELECT {ts('b')} AS bucket, CAST(type AS BIGINT) AS type, receipts, o AS distinct_outer, i AS distinct_inner FROM a")(
    lambda v: longs(said(rates.message_rate(v.timings, v.metadata), "bucket")))
query("p6a_rate_series_mean", f"WITH a AS ({RATE.format(w='1 HOUR')}) SELECT CAST(type AS BIGINT) AS type, round(avg(receipts),6) AS mean FROM a GROUP BY type")(
    lambda v: longs(r6(rates.series_mean(rates.message_rate(v.timings, v.metadata)), "mean")))
PC = "pc AS (SELECT time_bucket(INTERVAL 10 MINUTE, net_timestamp) AS b, collector, count(DISTINCT peer_hash) AS peers FROM timings WHERE dir=1 GROUP BY 1,2), ph AS (SELECT date_trunc('hour', b) AS h, collector, max(peers) AS peers FROM pc GROUP BY 1,2)"
query("c1_peer_count_10m", f"WITH {PC} SELECT {ts('b')} AS bucket, collector, peers FROM pc")(lambda v: said(rates.peer_count_10m(v.timings), "bucket"))
query("p7_peer_count_hourly", f"WITH {PC} SELECT {ts('h')} AS hour, collector, peers FROM ph")(lambda v: said(rates.peer_count_hourly(rates.peer_count_10m(v.timings)), "hour"))
query("p7b_peer_count_total", f"WITH {PC} SELECT {ts('h')} AS hour, collector, peers FROM ph UNION ALL SELECT {ts('h')}, 'total', CAST(sum(peers) AS BIGINT) FROM ph GROUP BY h")(
    lambda v: said(rates.peer_count_total(rates.peer_count_hourly(rates.peer_count_10m(v.timings))), "hour"))
for _n, _t, _e, _k in ((8, 3, "scid", "channel_update"), (9, 2, "orig_node", "node_announcement"), (10, 1, "scid", "channel_announcement")):
    _from = f"FROM timings t JOIN metadata m ON t.hash=m.hash WHERE dir=1 AND m.type={_t} AND m.{_e} IS NOT NULL"
    _daily = f"SELECT {day('net_timestamp')} AS day, m.{_e}, count(DISTINCT t.inner_hash) AS messages {_from} GROUP BY 1,2"
    _shown, _show = (f"upper(to_hex({_e})) AS scid_hex", True) if _e == "scid" and _n == 8 else (_e, False)
    query(f"p{_n}_{_k}_daily", f"WITH a AS ({_daily}) SELECT day, {_shown}, messages FROM a")(
        lambda v, t=_t, e=_e, x=_show: said((lambda d: d.withColumn("scid_hex", F.hex("scid")).drop("scid") if x else d)(rates.entity_counts(v.timings, v.metadata, t, e)), "day"))
    query(f"p{_n + 3}_{_k}_total", f"SELECT m.{_e}, count(DISTINCT t.inner_hash) AS messages {_from} GROUP BY 1")(
        lambda v, t=_t, e=_e: rates.entity_counts(v.timings, v.metadata, t, e, per_day=False))
    query(f"p14_avg_daily_active_{_k}", f"WITH a AS ({_daily}) SELECT {_e}, round(avg(messages),1) AS avg_daily FROM a GROUP BY 1")(
        lambda v, t=_t, e=_e: rates.avg_daily_active(rates.entity_counts(v.timings, v.metadata, t, e), e))
    query(f"p15_avg_daily_range_{_k}", f"SELECT m.{_e}, round(count(DISTINCT t.inner_hash)/30.0,2) AS avg_daily {_from} GROUP BY 1")(
        lambda v, t=_t, e=_e: rates.avg_daily_range(rates.entity_counts(v.timings, v.metadata, t, e, per_day=False), e, 30))
query("p16_bucket_counts", "WITH n AS (SELECT hash, count(*) AS c FROM timings GROUP BY hash), e(bucket, low, high) AS (VALUES (0,1.0,1.0),(1,1.0,10.0),(2,10.0,100.0),(3,100.0,1000.0),(4,1000.0,NULL)), a AS (SELECT CASE WHEN c<=1 THEN 0 WHEN c<=10 THEN 1 WHEN c<=100 THEN 2 WHEN c<=1000 THEN 3 ELSE 4 END AS b, count(*) AS n, sum(c) AS s FROM n WHERE c>=1 GROUP BY 1) SELECT CAST(bucket AS BIGINT) AS bucket, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, coalesce(n,0) AS entity_count, CAST(coalesce(s,0) AS DOUBLE) AS message_sum, round(coalesce(s,0)*100.0/(SELECT sum(s) FROM a),1) AS message_pct FROM e LEFT JOIN a ON bucket=b")(
    lambda v: longs(rates.bucket_counts(v.timings.groupBy("hash").agg(F.count(F.lit(1)).alias("c")), "c")))

# Roll-ups: sketches give estimates, so those queries are checked for closeness in the tests; exact ones have SQL

_g = lambda v, key="hash", per=False: rollups.propagation_rollup(v.timings, v.metadata, key, per)
for _key, _per, _id in (("hash", False, "c2a_propagation_global"), ("hash", True, "c2b_propagation_collector"), ("inner_hash", False, "c3a_inner_global"), ("inner_hash", True, "c3b_inner_collector")):
    _c = ", collector" if _per else ""
    query(_id, f"WITH a AS (SELECT date_trunc('hour', net_timestamp) AS b, t.{_key}, type{_c}, count(*) AS receipts, min(net_timestamp) AS f FROM timings t JOIN metadata m ON t.hash=m.hash WHERE dir=1 AND m.type IN (1,2,3) GROUP BY ALL) SELECT {ts('b')} AS bucket, {_key}, CAST(type AS BIGINT) AS type{_c}, receipts, {ts('f')} AS first_seen FROM a")(
        lambda v, k=_key, p=_per: longs(said(_g(v, k, p).drop("times", "orig_timestamp"), "bucket", "first_seen")))
query("c4_message_rate_10m", f"WITH a AS ({RATE.format(w='10 MINUTE')}) SELECT {ts('b')} AS bucket, CAST(type AS BIGINT) AS type, receipts, o AS outer, i AS inner FROM a".replace("AS outer", 'AS "outer"').replace("AS inner", 'AS "inner"'))(
    lambda v: longs(said(rollups.message_rate_rollup(v.timings, v.metadata).select("bucket", "type", "receipts", F.hll_sketch_estimate("outer_hll").alias("outer"), F.hll_sketch_estimate("inner_hll").alias("inner")), "bucket")))
query("c4_exact", f"WITH a AS ({RATE.format(w='10 MINUTE')}) SELECT {ts('b')} AS bucket, CAST(type AS BIGINT) AS type, receipts, o AS distinct_outer, i AS distinct_inner FROM a")(
    lambda v: longs(said(rollups.exact_rollup(v.timings, v.metadata, "10 minutes", "type"), "bucket")))
for _id, _e, _ty, _keys in (("c5_exact", "orig_node", "(2)", "m.orig_node"), ("c6_exact", "scid", "(1,3)", "m.scid, CAST(m.type AS BIGINT) AS type")):
    query(_id, f"SELECT {ts(HOUR)} AS bucket, {_keys}, count(*) AS receipts, count(DISTINCT t.hash) AS distinct_outer, count(DISTINCT t.inner_hash) AS distinct_inner FROM timings t JOIN metadata m ON t.hash=m.hash WHERE dir=1 AND m.type IN {_ty} AND m.{_e} IS NOT NULL GROUP BY ALL")(
        lambda v, e=_e: longs(said(rollups.exact_rollup(v.timings, v.metadata, "1 hour", *([e] if e == "orig_node" else [e, "type"]), types=(2,) if e == "orig_node" else (1, 3)), "bucket")))
_act = lambda v, e: rollups.activity_rollup(v.timings, v.metadata, e)
# receipts of one entity kind, with the hours, days and half days they fall in
_ACT = "ac AS (SELECT t.*, m.type, m.{e} FROM timings t JOIN metadata m ON t.hash=m.hash WHERE dir=1 AND m.type IN {ty} AND m.{e} IS NOT NULL)"
_NODE, _SCID = _ACT.format(e="orig_node", ty="(2)"), _ACT.format(e="scid", ty="(1,3)")
_SUMS = 'count(*) AS receipts, count(DISTINCT hash) AS "outer", count(DISTINCT inner_hash) AS "inner"'
query("c5_orig_node_activity", f"WITH {_NODE} SELECT {ts(HOUR)} AS bucket, orig_node, count(*) AS receipts, count(DISTINCT hash) AS \"outer\" FROM ac GROUP BY 1,2")(
    lambda v: said(_act(v, "orig_node").select("bucket", "orig_node", "receipts", F.hll_sketch_estimate("outer_hll").alias("outer")), "bucket"))
query("c6_scid_activity", f"WITH {_SCID} SELECT {ts(HOUR)} AS bucket, scid, CAST(type AS BIGINT) AS type, count(*) AS receipts, count(DISTINCT hash) AS \"outer\" FROM ac GROUP BY 1,2,3")(
    lambda v: longs(said(_act(v, "scid").select("bucket", "scid", "type", "receipts", F.hll_sketch_estimate("outer_hll").alias("outer")), "bucket")))
query("c7_outbound_origin", f"WITH a AS (SELECT date_trunc('hour', net_timestamp) AS b, t.hash, collector, type, min(net_timestamp) AS f FROM timings t JOIN metadata m ON t.hash=m.hash WHERE dir=2 AND m.type IN (1,2,3) GROUP BY ALL) SELECT {ts('b')} AS bucket, hash, collector, CAST(type AS BIGINT) AS type, {ts('f')} AS first_sent FROM a")(
    lambda v: longs(said(rollups.outbound_origin_rollup(v.timings, v.metadata), "bucket", "first_sent")))
_RECEIPTS = _IN = "inb AS (SELECT t.*, m.type, m.orig_node, m.scid, date_trunc('hour', net_timestamp) AS hour, time_bucket(INTERVAL 10 MINUTE, net_timestamp) AS ten FROM timings t JOIN metadata m ON t.hash=m.hash WHERE dir=1 AND m.type IN (1,2,3))"
_STATS = {
    "propagation": "SELECT DISTINCT hour AS b, hash, type FROM inb", "rate": "SELECT DISTINCT ten AS b, type FROM inb",
    "node": "SELECT DISTINCT hour AS b, orig_node FROM inb WHERE type=2 AND orig_node IS NOT NULL", "scid": "SELECT DISTINCT hour AS b, scid, type FROM inb WHERE type IN (1,3) AND scid IS NOT NULL",
    "peers": "SELECT DISTINCT time_bucket(INTERVAL 10 MINUTE, net_timestamp) AS b, collector FROM timings WHERE dir=1",
}
query("t0_ca_stats", f"WITH {_IN} " + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows, {ts('min(b)')} AS first_bucket, {ts('max(b)')} AS last_bucket FROM ({q})".replace("AS rows", 'AS "rows"') for n, q in _STATS.items()))(
    lambda v: said(rollups.ca_stats(propagation=_g(v), rate=rollups.message_rate_rollup(v.timings, v.metadata), node=_act(v, "orig_node"), scid=_act(v, "scid"), peers=rollups.peer_count_rollup(v.timings)), "first_bucket", "last_bucket"))
# A sketch's quantiles are exact up to 200 receipts of a message only, so these queries take them from the receipts
def _disc(since: str, prefix: str = "", probs: tuple[float, ...] = tuple(propagation.PROBS.values())) -> str:
    return ", ".join(f"round((quantile_disc(epoch_us(net_timestamp), {p}) - epoch_us({since}))/1e6, 6) AS {prefix}p{round(100 * p):02d}" for p in probs)


def _near(key: str) -> str:
    return f"SELECT {key}, type, count(*) AS receipts, min(net_timestamp) AS first_seen, {_disc('min(net_timestamp)')} FROM (SELECT *, min(hour) OVER (PARTITION BY {key}) AS fb FROM inb) WHERE hour <= fb + INTERVAL 1 HOUR GROUP BY {key}, type"


query("t1_outer_propagation", f"WITH {_IN}, a AS ({_near('hash')}) SELECT hash, CAST(type AS BIGINT) AS type, receipts, {ts('first_seen')} AS first_seen, p05, p25, p50, p75, p95 FROM a WHERE receipts >= 2")(
    lambda v: longs(said(r6(rollups.exact_propagation(v.timings, v.metadata, 2), "p05", "p25", "p50", "p75", "p95"), "first_seen")))
query("t2_inner_propagation", f"WITH {_IN}, a AS ({_near('inner_hash')}) SELECT inner_hash, CAST(type AS BIGINT) AS type, receipts, {ts('first_seen')} AS first_seen, p05, p25, p50, p75, p95 FROM a WHERE receipts >= 2")(
    lambda v: longs(said(r6(rollups.exact_propagation(v.timings, v.metadata, 2, "inner_hash"), "p05", "p25", "p50", "p75", "p95"), "first_seen")))
_T3 = """oo AS (SELECT t.hash, min(net_timestamp) AS t0 FROM timings t JOIN metadata m ON t.hash=m.hash WHERE dir=2 AND m.type IN (1,2,3) GROUP BY 1),
    ob AS (SELECT inb.*, oo.t0, min(net_timestamp) OVER (PARTITION BY inb.hash, hour, collector) AS f FROM inb JOIN oo ON inb.hash=oo.hash)"""
query("t3_outbound_origin_propagation", f"WITH {_IN}, {_T3} SELECT hash, {ts('t0')} AS t0, count(*) AS total_peers, {_disc('t0')} FROM ob WHERE f>=t0 AND f<=t0+INTERVAL 1 HOUR GROUP BY hash, ob.t0 HAVING count(*)>=2")(
    lambda v: said(r6(rollups.exact_outbound_propagation(v.timings, v.metadata, 2), *P), "t0"))
_Q3 = (0.25, 0.5, 0.75)
_T4 = f"""{_IN}, fb AS (SELECT hash, min(hour) AS first_bucket FROM inb GROUP BY 1), nb AS (SELECT inb.* FROM inb JOIN fb ON inb.hash=fb.hash WHERE hour <= first_bucket + INTERVAL 1 HOUR),
    al AS (SELECT hash, type, count(*) AS peers_all, min(net_timestamp) AS all_first_seen, {_disc('min(net_timestamp)', 'all_', _Q3)} FROM nb GROUP BY hash, type HAVING count(*) >= 2),
    sg AS (SELECT hash, collector, count(*) AS peers_single, min(net_timestamp) AS single_first_seen, {_disc('min(net_timestamp)', 'single_', _Q3)} FROM nb GROUP BY hash, collector),
    cm AS (SELECT al.*, sg.* EXCLUDE (hash), single_p50-all_p50 AS diff_p50, CASE WHEN all_p50<>0 THEN single_p50/all_p50 END AS ratio_p50 FROM al JOIN sg ON al.hash=sg.hash)"""
_MEDIANS = (*(f"{a}_p{n}" for a in ("single", "all") for n in (25, 50, 75)), "diff_p50", "ratio_p50")
query("t4_collector_comparison", f"WITH {_T4} SELECT * REPLACE (CAST(type AS BIGINT) AS type, {ts('single_first_seen')} AS single_first_seen, {ts('all_first_seen')} AS all_first_seen, round(diff_p50,6) AS diff_p50, round(ratio_p50,6) AS ratio_p50) FROM cm")(
    lambda v: longs(said(r6(rollups.exact_comparison(v.timings, v.metadata, 2), *_MEDIANS), "single_first_seen", "all_first_seen")))
query("t4s_comparison_summary", f"WITH {_T4} SELECT collector, " + ", ".join(f"round(quantile_cont({c},0.5),4) AS {c}" for c in _MEDIANS) + ", count(*) AS messages FROM cm GROUP BY 1")(
    lambda v: rollups.comparison_summary(rollups.exact_comparison(v.timings, v.metadata, 2)))
for _id, _key in (("t5_publication_delay_outer", "hash"), ("t6_publication_delay_inner", "inner_hash")):
    query(_id, f"WITH a AS (SELECT t.{_key}, type, min(net_timestamp) AS f, min(orig_timestamp) AS o, count(*) AS n FROM timings t JOIN metadata m ON t.hash=m.hash WHERE dir=1 AND m.type IN (2,3) AND orig_timestamp IS NOT NULL GROUP BY 1,2) SELECT {_key}, CAST(type AS BIGINT) AS type, round({delay('f', 'o')},6) AS delay, n AS total_receipts FROM a WHERE f>=o")(
        lambda v, k=_key: longs(r6(rollups.publication_delay(_g(v, k), k), "delay")))
query("t7_message_rate_6h", f"WITH {_IN} SELECT {ts('time_bucket(INTERVAL 6 HOUR, net_timestamp)')} AS bucket6, CAST(type AS BIGINT) AS type, round(count(*)/6.0,6) AS receipts_per_hour, count(DISTINCT hash) AS unique_outer, count(DISTINCT inner_hash) AS unique_inner FROM inb GROUP BY time_bucket(INTERVAL 6 HOUR, net_timestamp), type")(
    lambda v: longs(said(r6(rollups.message_rate_6h(rollups.message_rate_rollup(v.timings, v.metadata)), "receipts_per_hour"), "bucket6")))
query("t8_peer_count", f"WITH {PC} SELECT {ts('h')} AS hour, collector, peers FROM ph")(lambda v: said(rollups.peer_count_from_rollup(rollups.peer_count_rollup(v.timings)), "hour"))
query("t9_top_nodes", f"WITH {_NODE} SELECT orig_node, {_SUMS} FROM ac GROUP BY 1")(lambda v: rollups.activity_totals(_act(v, "orig_node"), "orig_node"))
query("t9b_daily_nodes", f"WITH {_NODE} SELECT {ts(DAY)} AS bucket, orig_node, {_SUMS} FROM ac GROUP BY 1,2")(lambda v: said(rollups.activity_totals(_act(v, "orig_node"), "orig_node", width="1 day"), "bucket"))
_updates = lambda v: rollups.activity_totals(_act(v, "scid").where("type = 3"), "scid", width="1 day")
query("t9c_daily_scids", f"WITH {_SCID} SELECT {ts(DAY)} AS bucket, scid, {_SUMS} FROM ac WHERE type=3 GROUP BY 1,2")(lambda v: said(_updates(v), "bucket"))
_T10 = f"{_SCID}, se AS (SELECT {ts('time_bucket(INTERVAL 12 HOUR, net_timestamp)')} AS bucket, scid, CAST(type AS BIGINT) AS type, {_SUMS} FROM ac GROUP BY 1,2,3)"
query("t10_top_scids", f"WITH {_T10} SELECT * FROM se")(lambda v: longs(said(rollups.activity_totals(_act(v, "scid"), "scid", "type", width="12 hours"), "bucket")))
query("t10b_top_n_series", f"WITH {_T10}, rk AS (SELECT type, scid, row_number() OVER (PARTITION BY type ORDER BY sum(receipts) DESC, scid) AS k FROM se GROUP BY 1,2) SELECT se.* FROM se JOIN rk ON se.type=rk.type AND se.scid=rk.scid WHERE k<=10")(
    lambda v: longs(said(rollups.top_n_series(rollups.activity_totals(_act(v, "scid"), "scid", "type", width="12 hours")), "bucket")))
query("t11a_outer_inner_ratio", f"WITH {_SCID}, dd AS (SELECT {ts(DAY)} AS bucket, scid, {_SUMS} FROM ac WHERE type=3 GROUP BY 1,2) SELECT scid, round(avg(\"outer\"/\"inner\"),6) AS mean_ratio, count(*) AS days_active FROM dd WHERE \"inner\">0 GROUP BY 1")(
    lambda v: r6(rollups.outer_inner_ratio(_updates(v)), "mean_ratio"))
# few messages of a channel are distinct here, so the least number is 2 and not 10
query("t11b_scid_comparison", f"WITH {_SCID}, pt AS (SELECT scid, type, count(DISTINCT hash) AS u FROM ac GROUP BY 1,2) SELECT scid, CAST(coalesce(sum(u) FILTER (type=1),0) AS BIGINT) AS announcements, CAST(coalesce(sum(u) FILTER (type=3),0) AS BIGINT) AS updates, CAST(sum(u) AS BIGINT) AS total FROM pt GROUP BY 1 HAVING sum(u)>=2 ORDER BY total DESC, scid LIMIT 25")(
    lambda v: longs(rollups.scid_comparison(_act(v, "scid"), min_messages=2)))
_LOOK = "SELECT t.collector, t.net_timestamp, t.row_inc, t.hash, m.type, m.size, s.raw, t.peer FROM timings t JOIN metadata m ON t.hash=m.hash JOIN messages s ON t.hash=s.hash WHERE dir=1 AND m.type=3 AND m.scid=7"
query("t12_lookup_messages", f"WITH a AS ({_LOOK}) SELECT collector, {ts('net_timestamp')} AS net_timestamp, row_inc, hash, CAST(type AS BIGINT) AS type, CAST(size AS BIGINT) AS size, raw, peer FROM a")(
    lambda v: longs(said(rollups.lookup(v.timings, v.metadata, v.messages, "2100-01-01", "200 years", scid=7), "net_timestamp")))
query("t12_lookup_newest", f"WITH a AS ({_LOOK}), b AS (SELECT *, row_number() OVER (PARTITION BY collector ORDER BY net_timestamp DESC, row_inc DESC) AS k FROM a) SELECT collector, {ts('net_timestamp')} AS net_timestamp, row_inc, hash, CAST(type AS BIGINT) AS type, CAST(size AS BIGINT) AS size, raw, peer FROM b WHERE k=1")(
    lambda v: longs(said(rollups.lookup(v.timings, v.metadata, v.messages, "2100-01-01", "200 years", scid=7, newest=True), "net_timestamp")))

# State and diagnostics

query("k2_first_seen", f"SELECT hash, {ts('min(net_timestamp)')} AS first_seen FROM timings GROUP BY hash")(lambda v: said(ingest.first_seen(v.timings), "first_seen"))
_CONN = "cn AS (SELECT collector, peer, min(net_timestamp) AS started FROM timings GROUP BY 1,2)"
_conns = lambda v: v.timings.groupBy("collector", "peer").agg(F.min("net_timestamp").alias("started"))
query("k4_warmup_filter", f"WITH {_CONN} SELECT t.row_inc FROM timings t JOIN cn ON t.collector=cn.collector AND t.peer=cn.peer WHERE t.net_timestamp >= started + INTERVAL 10 MINUTE")(
    lambda v: ingest.warmup_filter(v.timings, _conns(v)).select("row_inc"))
query("k5_liveness", f"WITH a AS (SELECT collector, max(net_timestamp) AS m FROM timings WHERE hash%10=1 GROUP BY 1) SELECT collector, {ts('m')} AS ts FROM a WHERE m >= (SELECT max(net_timestamp) FROM timings) - INTERVAL 1 DAY")(
    lambda v: said(ingest.liveness(v.timings.where("hash % 10 = 1").select("collector", F.col("net_timestamp").alias("ts"), "row_inc"), str(v.timings.agg(F.max("net_timestamp").cast("string")).first()[0]), "1 day").select("collector", "ts"), "ts"))
query("k6_batch_rates", f"WITH a AS (SELECT time_bucket(INTERVAL 10 MINUTE, net_timestamp) AS b, count(*) AS receipts FROM timings GROUP BY 1) SELECT {ts('b')} AS bucket, receipts FROM a")(lambda v: said(ingest.batch_rates(v.timings), "bucket"))
query("d1_rows_per_day", f"SELECT {day('net_timestamp')} AS day, count(*) AS receipts FROM timings GROUP BY 1 ORDER BY 1 DESC LIMIT 21")(lambda v: said(diagnostics.rows_per_day(v.timings), "day"))
query("d3_first_seen_window", f"SELECT upper(to_hex(hash)) AS hash_hex, {ts('first_seen')} AS first_seen FROM message_first_seen WHERE first_seen > TIMESTAMP '2000-01-01' AND first_seen < TIMESTAMP '2100-01-01'")(
    lambda v: said(diagnostics.first_seen_window(v.message_first_seen, "2000-01-01", "2100-01-01", None), "first_seen"))
query("d4_receipts_for_hash", "WITH h AS (SELECT min(hash) AS h FROM timings) SELECT row_inc, peer FROM timings, h WHERE hash=h")(
    lambda v: diagnostics.receipts_for_hash(v.timings, v.timings.agg(F.min("hash")).first()[0], "2000-01-01", "2100-01-01", None).select("row_inc", "peer"))
query("d5_frequency_bins", "WITH n AS (SELECT orig_node, count(*) AS c FROM metadata WHERE orig_node IS NOT NULL GROUP BY 1) SELECT CAST(CASE WHEN c<=5 THEN 0 WHEN c<=10 THEN 1 WHEN c<=50 THEN 2 ELSE 3 END AS BIGINT) AS bin, count(*) AS total FROM n GROUP BY 1")(
    lambda v: longs(diagnostics.frequency_bins(legacy.entity_frequency(v.metadata, "orig_node"), [0, 5, 10, 50], "messages")))
_AGES = ["hour", "day", "week", "two_weeks", "month", "three_months", "six_months", "year", "other"]
_AGE = "CASE WHEN age<=3600 THEN 0 WHEN age<=86400 THEN 1 WHEN age<=7*86400 THEN 2 WHEN age<=14*86400 THEN 3 WHEN age<=28*86400 THEN 4 WHEN age<=84*86400 THEN 5 WHEN age<=168*86400 THEN 6 WHEN age<=336*86400 THEN 7 ELSE 8 END"
query("d7_recency_table", f"WITH n AS (SELECT {_AGE} AS k FROM (SELECT {NOW}-first_seen AS age FROM features WHERE first_seen IS NOT NULL)), c AS (SELECT k, count(*) AS nodes FROM n GROUP BY 1) SELECT [{', '.join(repr(x) for x in _AGES)}][k+1] AS age, nodes, CAST(sum(nodes) OVER (ORDER BY k) AS BIGINT) AS running, round(coalesce((SELECT sum(nodes) FILTER (k<=4) FROM c),0)*100.0/(SELECT sum(nodes) FROM c),6) AS pct_within_month FROM c")(
    lambda v: r6(graph.recency_table(v.features.withColumnRenamed("first_seen", "last_update"), NOW), "pct_within_month"))

# Graph

_E = "e AS (SELECT scid, node_one AS src, node_two AS dst, coalesce(capacity,0) AS capacity FROM channels), v AS (SELECT src AS p, capacity FROM e UNION ALL SELECT dst, capacity FROM e)"
_edges = lambda v: graph.build_graph(v.channels)[1]
query("g1_vertices", f"WITH {_E} SELECT DISTINCT p AS pubkey FROM v")(lambda v: graph.build_graph(v.channels)[0])
query("g1_edges", f"WITH {_E} SELECT scid, src, dst, capacity FROM e")(_edges)
query("g2_edge_features", "SELECT count(*) FILTER (capacity>0) AS with_capacity, CAST(0 AS BIGINT) AS one_sided, count(*) AS channels FROM channels")(lambda v: graph.edge_features(v.channels))
def _box_cox(rows: str, points: int = 17, refine: int = 3) -> str:
    """CTEs up to bc (columns of rows, capacity_bc): each grid of lambda is the last one's best, one step to either side."""
    made = "CASE WHEN abs({g})<1e-12 THEN ln(capacity) ELSE (pow(capacity, {g})-1)/{g} END"
    out, low, step = [f"xx AS (SELECT CAST(capacity AS DOUBLE) AS capacity FROM {rows} WHERE capacity>0)"], "-2.0", 4.0 / (points - 1)
    for k in range(refine + 1):
        out.append(f"g{k} AS (SELECT g, -0.5*ln(greatest(var_pop({made.format(g='g')}),1e-300))+(g-1)*avg(ln(capacity)) AS fit FROM xx, (SELECT {low}+i*{step!r} AS g FROM range({points}) AS r(i){f', b{k - 1}' if k else ''}) GROUP BY g)")
        out.append(f"b{k} AS (SELECT arg_max(g, fit) AS best FROM g{k})")
        low, step = f"best-{step!r}", 2 * step / (points - 1)
    out.append(f"mm AS (SELECT *, CASE WHEN capacity>0 THEN {made.format(g='best')} END AS y FROM {rows}, b{refine})")
    return ", ".join([*out, "bc AS (SELECT * EXCLUDE (best, y), (y-avg(y) OVER ())/stddev_pop(y) OVER () AS capacity_bc FROM mm)"])


query("g3_vertex_strength", f"WITH {_E}, {_box_cox('e')}, ve AS (SELECT src AS p, capacity, capacity_bc FROM bc UNION ALL SELECT dst, capacity, capacity_bc FROM bc) SELECT p AS pubkey, count(*) AS degree, CAST(sum(capacity) AS BIGINT) AS total_capacity, round(coalesce(sum(capacity_bc),0)/count(*),6) AS mean_normal_capacity FROM ve GROUP BY p")(
    lambda v: r6(graph.vertex_strength(_edges(v)), "mean_normal_capacity"))
query("g4_box_cox", f"WITH {_E}, {_box_cox('e')} SELECT scid, src, dst, capacity, round(capacity_bc,6) AS capacity_bc FROM bc")(lambda v: r6(graph.box_cox(_edges(v), "capacity")[0], "capacity_bc"))
query("g5_log_standardize", f"WITH {_E} SELECT scid, round((ln(capacity)-(SELECT avg(ln(capacity)) FROM e))/(SELECT stddev_pop(ln(capacity)) FROM e),6) AS capacity_log FROM e")(
    lambda v: r6(graph.log_standardize(_edges(v), "capacity").select("scid", "capacity_log"), "capacity_log"))
_CC = f"WITH RECURSIVE {_E}, b AS (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e), rr(x, y) AS (SELECT x, x FROM b UNION SELECT rr.x, b.y FROM rr JOIN b ON rr.y=b.x), cc AS (SELECT x AS pubkey, min(y) AS component FROM rr GROUP BY x)"
query("g6_connected_components")(lambda v: graph.components_of(_edges(v)))
SQL["g6_connected_components"] = "WITH RECURSIVE " + with_views("SELECT 1 FROM channels").split("WITH ", 1)[1].rsplit(" SELECT 1", 1)[0] + ", " + _CC.split("WITH RECURSIVE ", 1)[1] + " SELECT pubkey, component, count(*) OVER (PARTITION BY component) AS size FROM cc"
query("g7_graph_stats")(lambda v: graph.graph_stats(_edges(v)))
SQL["g7_graph_stats"] = SQL["g6_connected_components"].rsplit(" SELECT pubkey, component", 1)[0] + ", dg AS (SELECT p, count(*) AS d FROM v GROUP BY p), cs AS (SELECT component, count(*) AS n FROM cc GROUP BY 1) SELECT (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM dg) AS nodes, round((SELECT avg(d) FROM dg),6) AS mean_degree, (SELECT min(d) FROM dg) AS min_degree, (SELECT max(d) FROM dg) AS max_degree, (SELECT quantile_cont(d,0.5) FROM dg) AS median_degree, (SELECT count(*) FROM cs) AS components, (SELECT max(n) FROM cs) AS largest"
QUERIES["g7_graph_stats"] = lambda spark, sf_dir, plain=QUERIES["g7_graph_stats"]: r6(plain(spark, sf_dir), "mean_degree")
query("g7_path_stats")(lambda v: r6(graph.path_stats(_edges(v), graph.build_graph(v.channels)[0].where("pubkey in ('c1', 'c500', 'c1000')"), 6), "mean_hops"))
SQL["g7_path_stats"] = SQL["g6_connected_components"].split(", rr(x, y)", 1)[0] + ", hp(s, y, h) AS (SELECT DISTINCT x, x, 0 FROM b WHERE x IN ('c1', 'c500', 'c1000') UNION SELECT hp.s, b.y, h+1 FROM hp JOIN b ON hp.y=b.x WHERE h<6), sh AS (SELECT s, y, min(h) AS h FROM hp GROUP BY 1,2 HAVING min(h)>0) SELECT count(*) AS pairs, round(avg(h),6) AS mean_hops, CAST(max(h) AS BIGINT) AS eccentricity FROM sh"
query("g8b_distinct_asns", "SELECT asn, count(*) AS nodes FROM features WHERE asn IS NOT NULL GROUP BY 1")(lambda v: graph.distinct_asns(v.features))
query("g8_annotate_vertices", f"WITH {_E}, d AS (SELECT DISTINCT p AS pubkey FROM v) SELECT d.pubkey, active, CAST(floor(({NOW}-first_seen)/86400.0) AS BIGINT) AS age_days, asn, CASE WHEN f.pubkey IS NULL THEN NULL WHEN sockets IS NULL THEN 'none' WHEN sockets LIKE '%onion%' AND sockets LIKE '[%' THEN 'both' WHEN sockets LIKE '%onion%' THEN 'tor' ELSE 'clearnet' END AS net_type FROM d LEFT JOIN features f ON d.pubkey=f.pubkey")(
    lambda v: graph.annotate(graph.build_graph(v.channels)[0], v.features, NOW).select("pubkey", "active", "age_days", "asn", "net_type"))
_M = "JOIN membership a ON a.pubkey=src JOIN membership b ON b.pubkey=dst"
query("g9_community_matrix", f"WITH {_E}, l AS (SELECT level_0, dense_rank() OVER (ORDER BY level_0)-1 AS k FROM (SELECT DISTINCT level_0 FROM membership)), p AS (SELECT x.k AS i, y.k AS j FROM e {_M} JOIN l x ON x.level_0=a.level_0 JOIN l y ON y.level_0=b.level_0), q AS (SELECT i, j FROM p UNION ALL SELECT j, i FROM p WHERE i<>j) SELECT CAST(i AS BIGINT) AS block_a, CAST(j AS BIGINT) AS block_b, count(*) AS edges FROM q GROUP BY 1,2")(
    lambda v: longs(graph.community_matrix(_edges(v), v.membership)))
query("g10_edge_scope", f"WITH {_E} SELECT scid, src, dst, CAST(CASE WHEN a.level_2<>b.level_2 THEN 3 WHEN a.level_1<>b.level_1 THEN 2 WHEN a.level_0<>b.level_0 THEN 1 ELSE 0 END AS BIGINT) AS scope FROM e {_M}")(lambda v: longs(graph.edge_scope(_edges(v), v.membership)))
query("g11_communities_wide", "SELECT pubkey, level_0, level_1, level_2 FROM membership")(
    lambda v: graph.communities_wide(v.membership.unpivot("pubkey", ["level_0", "level_1", "level_2"], "level", "community"), ["level_0", "level_1", "level_2"]))
query("g12_community_members", "SELECT m.level_0, m.pubkey, f.alias, f.sockets FROM membership m LEFT JOIN features f ON m.pubkey=f.pubkey")(lambda v: graph.community_members(v.membership, v.features.select("pubkey", "alias", "sockets")))
query("g13_sampling_plan", "WITH s AS (SELECT level_0, count(*) AS size FROM membership GROUP BY 1), p AS (SELECT level_0, size, size*1.0/(SELECT sum(size) FROM s) AS p FROM s), x AS (SELECT *, 200*p AS e, sqrt(200*p*(1-p)) AS d FROM p) SELECT level_0, size, round(p,6) AS proportion, round(e,6) AS expected, round(d,6) AS stddev, CAST(CASE WHEN p>=0.08 THEN round(e-d) WHEN p>=0.02 THEN round(e) ELSE greatest(round(e+d),1) END AS BIGINT) AS connection_count FROM x")(
    lambda v: r6(graph.sampling_plan(v.membership, 200), "proportion", "expected", "stddev"))
_MAP = lambda v: v.membership.select("level_0").distinct().withColumn("collector", F.concat(F.lit("u"), F.col("level_0").cast("string")))
query("g14_assignments", "WITH s AS (SELECT level_0, count(*) AS size FROM membership GROUP BY 1), p AS (SELECT level_0, size, size*1.0/(SELECT sum(size) FROM s) AS p FROM s), x AS (SELECT *, 200*p AS e, sqrt(200*p*(1-p)) AS d FROM p), li AS (SELECT level_0, m.pubkey, count(*) OVER (PARTITION BY level_0) AS able FROM membership m JOIN features f ON m.pubkey=f.pubkey WHERE sockets IS NOT NULL) SELECT concat('u',x.level_0) AS collector, x.level_0, size, CAST(CASE WHEN p>=0.08 THEN round(e-d) WHEN p>=0.02 THEN round(e) ELSE greatest(round(e+d),1) END AS BIGINT) AS connection_count, pubkey, able FROM x LEFT JOIN li ON x.level_0=li.level_0")(
    lambda v: (lambda a: a.join(a.groupBy("collector").agg(F.max("rank").alias("able")), "collector").select("collector", "level_0", "size", "connection_count", "pubkey", "able"))(graph.assignments(_MAP(v), graph.sampling_plan(v.membership, 200), v.membership, v.features)))
query("g15_merge_nodes", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY pubkey ORDER BY coalesce(last_update,-1) DESC, collector) AS k FROM node_views) SELECT pubkey, CAST(last_update AS BIGINT) AS last_update, alias FROM r WHERE k=1")(
    lambda v: graph.merge_nodes(v.node_views).withColumn("last_update", F.col("last_update").cast("long")))
query("g15_merge_directions", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY scid, direction ORDER BY last_update DESC, collector, fees_base DESC, fees_ppm DESC, cltv DESC) AS k FROM chan_views) SELECT scid, CAST(direction AS BIGINT) AS direction, last_update, fees_base, fees_ppm, cltv FROM r WHERE k=1")(
    lambda v: longs(graph.merge_directions(v.chan_views)))
query("g15_merge_channels", "WITH t AS (SELECT scid, max(last_update) AS last_update FROM chan_tops GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY scid ORDER BY last_update DESC, collector) AS k FROM chan_tops WHERE capacity IS NOT NULL) SELECT t.scid, t.last_update, capacity FROM t LEFT JOIN r ON t.scid=r.scid AND k=1")(
    lambda v: graph.merge_channels(v.chan_tops))
_G16 = """nm AS (SELECT DISTINCT collector FROM node_views UNION SELECT DISTINCT collector FROM chan_views),
    mn AS (SELECT pubkey, last_update AS mu, alias AS ma FROM (SELECT *, row_number() OVER (PARTITION BY pubkey ORDER BY coalesce(last_update,-1) DESC, collector) AS k FROM node_views) WHERE k=1),
    nn AS (SELECT nm.collector, mu, ma, o.pubkey AS held, o.last_update AS ou, o.alias AS oa FROM mn CROSS JOIN nm LEFT JOIN node_views o ON o.pubkey=mn.pubkey AND o.collector=nm.collector),
    md AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scid, direction ORDER BY last_update DESC, collector, fees_base DESC, fees_ppm DESC, cltv DESC) AS k FROM chan_views) WHERE k=1),
    od AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY collector, scid, direction ORDER BY last_update DESC, fees_base DESC, fees_ppm DESC, cltv DESC) AS k FROM chan_views) WHERE k=1),
    hd AS (SELECT DISTINCT collector, scid FROM od),
    dd AS (SELECT hd.collector, od.scid AS own, (od.fees_base, od.fees_ppm, od.cltv) = (md.fees_base, md.fees_ppm, md.cltv) AS same FROM hd JOIN md ON md.scid=hd.scid LEFT JOIN od ON od.collector=hd.collector AND od.scid=hd.scid AND od.direction=md.direction),
    a AS (SELECT collector, count(held) AS known_nodes, count(*) FILTER (held IS NULL) AS missing_nodes, count(*) FILTER (held IS NULL OR (mu IS NOT NULL AND ou IS NULL)) AS missing_node_info, count(*) FILTER (ou IS NOT NULL AND ma IS DISTINCT FROM oa) AS stale_node_info, count(*) FILTER (held IS NOT NULL AND mu IS NULL OR ou IS NOT NULL AND ma IS NOT DISTINCT FROM oa) AS matching_node_info FROM nn GROUP BY 1),
    b AS (SELECT collector, count(*) FILTER (own IS NULL) AS missing_directions, count(*) FILTER (own IS NOT NULL AND NOT same) AS stale_directions, count(*) FILTER (own IS NOT NULL AND same) AS matching_directions FROM dd GROUP BY 1),
    c AS (SELECT collector, count(*) AS held FROM hd GROUP BY 1), u AS (SELECT collector, CAST(sum(2-ways) AS BIGINT) AS nobody FROM hd JOIN (SELECT scid, count(*) AS ways FROM md GROUP BY 1) w ON hd.scid=w.scid GROUP BY 1)"""
query("g16_graph_diff", f"WITH {_G16} SELECT nm.collector, known_nodes, missing_nodes, missing_node_info, stale_node_info, matching_node_info, coalesce(held,0) AS known_channels, (SELECT count(DISTINCT scid) FROM md)-coalesce(held,0) AS missing_channels, coalesce(missing_directions,0) AS missing_directions, coalesce(stale_directions,0) AS stale_directions, coalesce(matching_directions,0)+coalesce(nobody,0) AS matching_directions FROM nm JOIN a ON a.collector=nm.collector LEFT JOIN b ON b.collector=nm.collector LEFT JOIN c ON c.collector=nm.collector LEFT JOIN u ON u.collector=nm.collector")(
    lambda v: graph.graph_diff(v.node_views, v.chan_views))
query("g17_channel_utxo_filter", "SELECT scid, node_one, node_two, CASE WHEN u.block IS NULL THEN 'missing' WHEN spent THEN 'spent' ELSE 'kept' END AS state, CASE WHEN NOT spent THEN value END AS capacity FROM channels c LEFT JOIN utxos u ON u.block=(c.scid>>40) AND u.tx=((c.scid>>16)&16777215) AND u.vout=(c.scid&65535)")(lambda v: graph.utxo_filter(v.channels, v.utxos))
query("g17_used_nodes", "SELECT pubkey, alias FROM features WHERE pubkey IN (SELECT node_one FROM channels UNION SELECT node_two FROM channels)")(lambda v: graph.used_nodes(v.features.select("pubkey", "alias"), v.channels))
_INTERVALS = _IV = "iv AS (SELECT local_port, remote_ip, remote_port, uuid, min(epoch) AS f, max(epoch) AS l FROM samples GROUP BY 1,2,3,4), ga AS (SELECT p.*, iv.uuid, iv.f, greatest(iv.f-p.ts, p.ts-iv.l, 0) AS g FROM packets p LEFT JOIN iv USING (local_port, remote_ip, remote_port)), rk AS (SELECT *, row_number() OVER (PARTITION BY pkt_id ORDER BY CASE WHEN g>60 THEN 1 ELSE 0 END, CASE WHEN g>60 THEN g ELSE 0 END, f, uuid) AS k FROM ga), fl AS (SELECT * FROM rk WHERE k=1)"
_flows = lambda v: attribution.attribute_flows(v.packets, v.samples)
query("g18_flow_attribution", f"WITH {_IV} SELECT pkt_id, uuid, coalesce(uuid IS NOT NULL AND g<=60, false) AS in_window FROM fl")(lambda v: _flows(v).select("pkt_id", "uuid", "in_window"))
query("g18_flow_totals", f"WITH {_IV} SELECT uuid, count(*) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes, count(DISTINCT (local_port, remote_ip, remote_port)) AS connections, count(DISTINCT remote_ip) AS peers FROM fl WHERE uuid IS NOT NULL GROUP BY 1")(lambda v: attribution.flow_totals(_flows(v)))
query("g18_unattributed", f"WITH {_IV} SELECT remote_ip, CAST(remote_port AS BIGINT) AS remote_port, count(*) AS packets FROM fl WHERE uuid IS NULL GROUP BY 1,2 ORDER BY packets DESC, 1, 2 LIMIT 20")(lambda v: longs(attribution.unattributed(_flows(v))))
query("g19_unannounced", "SELECT DISTINCT p AS pubkey FROM (SELECT node_one AS p FROM channels UNION SELECT node_two FROM channels) WHERE p NOT IN (SELECT pubkey FROM features)")(lambda v: graph.lists(v.features, v.channels)["unannounced"])
query("g20_reachable_split", "SELECT pubkey, address, CASE WHEN NOT regexp_matches(address, '^\\S+:[0-9]{1,5}$') THEN 'unparseable' WHEN address LIKE '[%' THEN 'maybe_reachable' ELSE 'unreachable' END AS kind FROM (SELECT pubkey, unnest(string_split(sockets, ',')) AS address FROM features WHERE sockets IS NOT NULL)")(
    lambda v: graph.reachable_split(v.features))
query("f3_scid_format", "SELECT scid, concat(scid>>40,'x',(scid>>16)&16777215,'x',scid&65535) AS text, scid AS back FROM channels")(lambda v: v.channels.select("scid", fn.scid_format("scid").alias("text"), fn.scid_parse(fn.scid_format("scid")).alias("back")))
query("f20_explode_sockets", "SELECT pubkey, unnest(string_split(sockets, ',')) AS address FROM features WHERE sockets IS NOT NULL")(lambda v: fn.explode_sockets(v.features).select("pubkey", "address"))
query("s14_compact_traffic", f"SELECT {ts('first_seen')} AS first_seen, m.hash, inner_hash, CAST(type AS BIGINT) AS type, CAST(size AS BIGINT) AS size, orig_node, scid FROM metadata m JOIN message_first_seen f ON m.hash=f.hash WHERE type IN (1,2,3)")(
    lambda v: longs(said(files.compact_traffic(v.metadata, v.message_first_seen), "first_seen")))
