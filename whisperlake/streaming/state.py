"""Streams that keep state: liveness with timers, the warm-up filter, exact distinct counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "collector string, event string, at timestamp"


def liveness_events(heartbeats: DataFrame, expiry: int = 600) -> DataFrame:
    """K5 in batch: (collector, event, at): online at a heartbeat after none for ``expiry`` seconds, expired that long after the last.

    The last heartbeat of a collector counts as expired only where another heartbeat, of anyone, is later than that.
    """
    rows = heartbeats.where("collector is not null and ts is not null").select("collector", "ts").distinct()
    w = Window.partitionBy("collector").orderBy("ts")
    both = rows.withColumns({"before": F.lag("ts").over(w), "after": F.lead("ts").over(w)})
    late = lambda a, b: F.col(a).cast("double") > F.col(b).cast("double") + expiry
    gone = (F.col("ts").cast("double") + expiry).cast("timestamp")
    online = both.where(F.col("before").isNull() | late("ts", "before")).select("collector", F.lit("online").alias("event"), F.col("ts").alias("at"))
    ended = both.where(late("after", "ts")).select("collector", F.lit("expired").alias("event"), gone.alias("at"))
    top = rows.agg(F.max("ts").alias("top"))
    last = both.where("after is null").crossJoin(F.broadcast(top)).where(late("top", "ts")).select("collector", F.lit("expired").alias("event"), gone.alias("at"))
    return online.unionByName(ended).unionByName(last)


def liveness_stream(heartbeats: DataFrame, expiry: int = 600, lateness: str = "10 minutes") -> DataFrame:
    """K5: the events of ``liveness_events`` as a stream (update mode): heartbeats wait for the watermark, so that late ones take their place; a timer expires those that fall silent.

    State of a collector: its heartbeats above the watermark, and the last below it.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = state.get if state.exists else (0, [])
        waiting = set(waiting)
        for f in frames:
            waiting.update(int(x.value // 1000) for x in f["ts"])
        mark = state.getCurrentWatermarkMs() * 1000
        out = []
        for t in sorted(x for x in waiting if x <= mark):
            if last and t > last + expiry * 1_000_000:
                out.append(("expired", last + expiry * 1_000_000))
                last = 0
            if not last:
                out.append(("online", t))
            last = max(last, t)
        waiting = sorted(x for x in waiting if x > mark)
        if last and last + expiry * 1_000_000 < mark and (not waiting or waiting[0] > last + expiry * 1_000_000):
            out.append(("expired", last + expiry * 1_000_000))
            last = 0
        if last or waiting:
            state.update((last, waiting))
            soon = min([*waiting[:1], *([last + expiry * 1_000_000] if last else [])])
            state.setTimeoutTimestamp(max(soon // 1000 + 1, mark // 1000 + 1))
        else:
            state.remove()
        if out:
            yield pd.DataFrame({"collector": key[0], "event": [e for e, _ in out], "at": pd.to_datetime([t for _, t in out], unit="us")})

    rows = heartbeats.where("collector is not null and ts is not null").select("collector", "ts").withWatermark("ts", lateness)
    return rows.groupBy("collector").applyInPandasWithState(step, EVENTS, "last long, waiting array<long>", "update", GroupStateTimeout.EventTimeTimeout)


def warmup_stream(t: DataFrame, connections: DataFrame, delay: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """K4 as a stream: receipts without those of a peer whose connection began less than ``delay`` before.

    A receipt is kept when both watermarks have passed it, as until then a connection may still come. Receipts later than
    ``lateness`` are dropped; those without a collector, peer or time have no connection and are kept by the batch form only.
    """
    c = connections.select(F.col("collector").alias("c"), F.col("peer").alias("p"), "started").withWatermark("started", lateness)
    young = (F.col("collector") == F.col("c")) & (F.col("peer") == F.col("p")) & (F.col("net_timestamp") >= F.col("started")) & (F.col("net_timestamp") < F.expr(f"started + interval {delay}"))
    return t.withWatermark("net_timestamp", lateness).join(c, young, "leftOuter").where("started is null").select(*t.columns)


def peer_count_stream(t: DataFrame, width: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """C1 exactly, as a stream: peers are made distinct within their window, then counted; a window is given out when the watermark passes it."""
    rows = t.where("dir = 1").withWatermark("net_timestamp", lateness).select(F.window("net_timestamp", width).alias("w"), "collector", "peer_hash")
    once = rows.dropDuplicates(["w", "collector", "peer_hash"])
    counts = once.groupBy("w", "collector").agg(F.count("peer_hash").alias("peers"))
    return counts.select(F.col("w.start").alias("bucket"), "collector", "peers")
