"""The driver's tables seen as gossip tables: Spark frames, and the same views as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: View name to SQL; {TS}, {EPOCH}, {MK}, {SHIP}, {SCID}, {BLOCK} and {TX} are filled in for each engine.
VIEWS = {
    "g_base": """SELECT event_id, {TS} AS ts, user_id, event_type, value,
        CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS typ,
        CAST(floor({EPOCH}/21600) AS BIGINT) AS b6 FROM events""",
    "timings": """SELECT ts AS net_timestamp, event_id AS row_inc, b6*10+typ AS hash, CAST(floor(b6/2) AS BIGINT)*10+typ AS inner_hash,
        concat('n',user_id%8) AS collector, concat('p',user_id) AS peer, CASE WHEN event_id%4=0 THEN 2 ELSE 1 END AS dir,
        user_id AS peer_hash, CASE WHEN typ IN (2,3) THEN {MK}((b6*21600+(b6%5)*600)*1000000) END AS orig_timestamp FROM g_base""",
    "metadata": """SELECT DISTINCT b6*10+typ AS hash, CAST(floor(b6/2) AS BIGINT)*10+typ AS inner_hash, typ AS type,
        CAST(100+b6%300 AS INT) AS size, CASE WHEN typ=2 THEN concat('n',b6%20) END AS orig_node,
        CASE WHEN typ IN (1,3) THEN b6%40 END AS scid FROM g_base""",
    "message_first_seen": "SELECT hash, min(net_timestamp) AS first_seen FROM timings GROUP BY hash",
    "messages": "SELECT hash, concat('raw-', hash) AS raw FROM metadata",
    "owned": "SELECT * FROM (VALUES ('n1',1),('n3',5),('n5',7),('n7',11)) AS o(collector, scid)",
    "channels": """SELECT {SCID} AS scid, concat('c',o_custkey) AS node_one,
        concat('c',o_custkey+1+o_orderkey%3) AS node_two, CAST(round(o_totalprice) AS BIGINT) AS capacity
        FROM orders""",
    "samples": """SELECT CAST(floor({EPOCH}) AS BIGINT) AS epoch, concat('u',user_id%7) AS uuid, 40000+user_id%50 AS local_port,
        concat('10.0.0.',user_id%20) AS remote_ip, 9735 AS remote_port FROM events WHERE event_type IN ('view','click')""",
    "packets": """SELECT event_id AS pkt_id, {EPOCH} AS ts, CASE WHEN event_type='error' THEN 41000 ELSE 40000 END+user_id%50 AS local_port,
        concat('10.0.0.',user_id%20) AS remote_ip, 9735 AS remote_port, CAST(floor(value) AS BIGINT) AS bytes
        FROM events WHERE event_type NOT IN ('view','click')""",
    "captured": """SELECT pkt_id, ts, bytes, CASE WHEN pkt_id%13=0 THEN '198.51.100.9' WHEN pkt_id%2=0 THEN '203.0.113.5' ELSE remote_ip END AS src_ip,
        CASE WHEN pkt_id%2=0 THEN local_port ELSE remote_port END AS src_port, CASE WHEN pkt_id%2=0 THEN remote_ip WHEN pkt_id%13=0 THEN remote_ip ELSE '203.0.113.5' END AS dst_ip,
        CASE WHEN pkt_id%2=0 THEN remote_port ELSE local_port END AS dst_port FROM packets""",
    "links": """SELECT concat('c',o_custkey) AS src, concat('c',o_custkey+1+o_orderkey%200) AS dst FROM orders""",
    "features": """SELECT concat('c',c_custkey) AS pubkey, CAST(c_custkey%50 AS BIGINT) AS active, CAST(1700000000+c_custkey*86400 AS BIGINT) AS first_seen,
        CASE WHEN c_custkey%7>0 THEN CAST(c_nationkey AS BIGINT) END AS asn, CASE c_custkey%4 WHEN 1 THEN concat('10.0.',c_custkey%250,'.7:9735')
        WHEN 2 THEN concat('abc',c_custkey,'.onion:9735') WHEN 3 THEN concat('[2001:db8::1]:9735,xyz',c_custkey,'.onion:9735') END AS sockets,
        concat('LNT',c_custkey%9,'alias') AS alias FROM customer""",
    "membership": """SELECT concat('c',c_custkey) AS pubkey, c_custkey%12 AS level_0, c_custkey%4 AS level_1, c_custkey%2 AS level_2 FROM customer""",
    "chan_views": """SELECT concat('n',l_suppkey%5) AS collector, l_orderkey AS scid, CASE WHEN l_linestatus='O' THEN 1 ELSE 2 END AS direction,
        CAST(floor({SHIP}/86400) AS BIGINT) AS last_update, CAST(round(l_discount*1000) AS BIGINT) AS fees_base, CAST(round(l_tax*1000) AS BIGINT) AS fees_ppm,
        CAST(l_quantity AS BIGINT) AS cltv, l_linenumber FROM lineitem""",
    "chan_tops": """SELECT collector, scid, max(last_update) AS last_update, max(CASE WHEN l_linenumber%3>0 THEN fees_base*1000+cltv END) AS capacity
        FROM chan_views GROUP BY collector, scid""",
    "node_views": """SELECT concat('n',k.c) AS collector, concat('c',c_custkey) AS pubkey, CASE WHEN (c_custkey+k.c)%6>0 THEN 1000+(c_custkey*7+k.c*3)%50 END AS last_update,
        CASE WHEN (c_custkey+k.c)%6>0 THEN concat('a',c_custkey%5,'-',(c_custkey*k.c)%3) END AS alias
        FROM customer, (SELECT * FROM (VALUES (0),(1),(2),(3),(4)) AS t(c)) AS k WHERE (c_custkey*3+k.c)%4>0""",
    "utxos": """SELECT {BLOCK} AS block, {TX} AS tx, o_orderkey%2 AS vout, o_orderstatus='F' AS spent, CAST(round(o_totalprice) AS BIGINT)+1 AS value
        FROM orders WHERE o_orderstatus<>'P'""",
}
# An order key from 2**23 on overflows DuckDB's BIGINT, so that the SQL has no result. A scid is an unsigned number of 64 bits
# (block of 24, transaction of 24, output of 16), kept in the bits of a long; of keys from 2**24 on, what the block
# cannot hold goes to the transaction, so that no two orders share a scid. Below 2**23 both are the same number.
_BLOCK, _TX = "(o_orderkey & 16777215)", "(shiftright(o_orderkey, 24)*1000+o_custkey%1000)"
_SPARK = {"SCID": f"(shiftleft({_BLOCK}, 40) | shiftleft({_TX}, 16) | o_orderkey%2)", "BLOCK": _BLOCK, "TX": _TX, "TS": "CAST(ts AS TIMESTAMP)", "EPOCH": "(unix_micros(CAST(ts AS TIMESTAMP))/1e6)", "MK": "timestamp_micros", "SHIP": "(unix_micros(CAST(l_shipdate AS TIMESTAMP))/1e6)"}
_DUCK = {"SCID": "o_orderkey*1099511627776+(o_custkey%1000)*65536+o_orderkey%2", "BLOCK": "o_orderkey", "TX": "o_custkey%1000", "TS": "ts", "EPOCH": "epoch(ts)", "MK": "make_timestamp", "SHIP": "epoch(l_shipdate)"}
TABLES = ("events", "orders", "customer", "lineitem")


class Views:
    """Frames by name: ``Views(spark, sf_dir).timings``. Only the views that are asked for are planned."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in VIEWS:
                sql = VIEWS[name].format(**_SPARK)
                used = {t: getattr(self, t) for t in (*VIEWS, *TABLES) if t != name and f"FROM {t}" in sql}
                for t in used:
                    sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
                self._made[name] = self._spark.sql(sql, **used)
            else:
                self._made[name] = self._spark.read.parquet(f"{self._dir}/{name}.parquet")
        return self._made[name]


def with_views(sql: str, *more: str) -> str:
    """DuckDB SQL with the views it names, and those they name, as CTEs."""
    need: list[str] = []

    def add(text: str) -> None:
        import re

        for v in VIEWS:
            if re.search(rf"\b{v}\b", text) and v not in need:
                add(VIEWS[v].replace(" AS " + v, ""))
                need.append(v)

    add(sql)
    ctes = [f"{v} AS ({VIEWS[v].format(**_DUCK)})" for v in need] + list(more)
    if not ctes:
        return sql
    head = f"WITH {', '.join(ctes)} "
    return head + sql if not sql.lstrip().upper().startswith("WITH ") else f"WITH {', '.join(ctes)}, " + sql.lstrip()[5:]
