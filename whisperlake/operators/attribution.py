"""Packet flows matched to the instance that owned their socket at the time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["local_port", "remote_ip", "remote_port"]


def intervals(samples: DataFrame) -> DataFrame:
    """(key, uuid, first, last) from socket samples."""
    return samples.groupBy(*KEY, "uuid").agg(F.min("epoch").alias("first"), F.max("epoch").alias("last"))


def attribute_flows(packets: DataFrame, samples: DataFrame, grace: int = 60, width: int = 600) -> DataFrame:
    """Every packet with its owner: of the intervals of its socket that hold it (give or take ``grace`` seconds) the one
    that began first, else the nearest; null, and not in a window, where the socket was never sampled. Ties go to the one
    that began first, then to the smaller uuid.

    An interval can be the first of those that hold a packet only if it ends later than all that began before it. Along
    these the ends ascend, so the first that ends late enough is one step of an as-of join, and it holds the packet or none
    does. The nearest are two more such steps, to the next beginning and to the last end. Packets and intervals are sorted
    together in bins of ``width`` seconds of a socket; what lies beyond its bin a packet gets from one row for each bin.
    """
    own = intervals(samples).where(" and ".join(f"{c} is not null" for c in KEY))
    order = Window.partitionBy(*KEY).orderBy("first", "uuid").rowsBetween(Window.unboundedPreceding, -1)
    longest = own.withColumn("before", F.max("last").over(order)).where("before is null or last > before")
    who = F.struct("first", "uuid")
    # (kind of step, at): hold is looked up among later ones, next too, past among earlier ones
    steps = longest.select(*KEY, (F.col("last") + grace).cast("double").alias("at"), who.alias("hold"))
    steps = steps.unionByName(own.groupBy(*KEY, F.col("first").cast("double").alias("at")).agg(F.min(who).alias("next")), allowMissingColumns=True)
    steps = steps.unionByName(own.groupBy(*KEY, F.col("last").cast("double").alias("at")).agg(F.min(who).alias("past")), allowMissingColumns=True)
    steps = steps.withColumn("past_at", F.when(F.col("past").isNotNull(), F.col("at")))
    bin_of = lambda c: F.floor(F.col(c).cast("double") / width)
    both = packets.withColumns({"_packet": F.lit(True), "at": F.col("ts").cast("double")}).unionByName(steps, allowMissingColumns=True).withColumn("_bin", bin_of("at"))
    names = ("hold", "next", "past", "past_at")
    # within a bin; of rows at one time the packets come between what begins and what has ended, so that both are seen
    place = [*KEY, "_bin"]
    ahead = Window.partitionBy(*place).orderBy(F.col("at").desc(), F.col("_packet").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy(*place).orderBy(F.col("at"), F.col("_packet").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumns({f"_{n}": F.last(n, ignorenulls=True).over(ahead if n in ("hold", "next") else behind) for n in names}).where("_packet")
    # a row for each bin that has a step: the first and the last of it, carried to the bins before and after
    some = lambda n: F.when(F.col(n).isNotNull(), F.struct("at", n))
    ends = steps.withColumn("_bin", bin_of("at")).groupBy(*place).agg(*(F.min(some(n)).getField(n).alias(n) for n in ("hold", "next")), *(F.max(some(n)).getField(n).alias(n) for n in ("past", "past_at")))
    bins = near.select(*place).distinct().unionByName(ends, allowMissingColumns=True).groupBy(*place).agg(*(F.first(n, ignorenulls=True).alias(n) for n in names))
    over = Window.partitionBy(*KEY).orderBy("_bin")
    later, sooner = over.rowsBetween(1, Window.unboundedFollowing), over.rowsBetween(Window.unboundedPreceding, -1)
    carried = bins.select(*place, *(F.first(n, ignorenulls=True).over(later).alias(f"far_{n}") for n in ("hold", "next")), *(F.last(n, ignorenulls=True).over(sooner).alias(f"far_{n}") for n in ("past", "past_at")))
    found = near.alias("p").join(carried.alias("c"), [F.col(f"p.{c}").eqNullSafe(F.col(f"c.{c}")) for c in place], "left")
    step = lambda n: F.coalesce(F.col(f"_{n}"), F.col(f"far_{n}"))
    hold, ts = step("hold"), F.col("p.ts")
    inside = F.coalesce(hold["first"] - grace <= ts, F.lit(False))
    choice = lambda gap, w: F.when(w.isNotNull(), F.struct(gap.cast("double").alias("gap"), w["first"].alias("first"), w["uuid"].alias("uuid")))
    nearest = F.least(choice(step("next")["first"] - ts, step("next")), choice(ts - step("past_at"), step("past")))
    return found.select(*(F.col(f"p.{c}") for c in packets.columns), F.when(inside, hold["uuid"]).otherwise(nearest["uuid"]).alias("uuid"), inside.alias("in_window"))


def oriented(packets: DataFrame, public_ip: str) -> DataFrame:
    """Rows (src_ip, src_port, dst_ip, dst_port) with our end as local; rows of which neither end is ours go."""
    ours = F.col("src_ip") == public_ip
    side = lambda a, b: F.when(ours, F.col(a)).otherwise(F.col(b))
    return packets.where(ours | (F.col("dst_ip") == public_ip)).select("*", side("src_port", "dst_port").alias("local_port"), side("dst_ip", "src_ip").alias("remote_ip"), side("dst_port", "src_port").alias("remote_port"))


def captured_flows(packets: DataFrame, samples: DataFrame, public_ip: str, grace: int = 60) -> tuple[DataFrame, DataFrame]:
    """Captured rows attributed, and the remotes that no instance had: (flows of which one end is ours, (remote_ip, packets)).

    The remote of a row of which neither end is ours is its destination.
    """
    flows = attribute_flows(oriented(packets, public_ip), samples, grace)
    neither = packets.where(~(F.col("src_ip").eqNullSafe(public_ip) | F.col("dst_ip").eqNullSafe(public_ip))).select(F.col("dst_ip").alias("remote_ip"))
    lost = flows.where("uuid is null").select("remote_ip").unionByName(neither)
    return flows, lost.groupBy("remote_ip").agg(F.count(F.lit(1)).alias("packets"))


def flow_totals(flows: DataFrame) -> DataFrame:
    """Per instance: packets, bytes, connections and peers."""
    return flows.where("uuid is not null").groupBy("uuid").agg(F.count(F.lit(1)).alias("packets"), F.sum("bytes").alias("bytes"), F.countDistinct(*KEY).alias("connections"), F.countDistinct("remote_ip").alias("peers"))


def unattributed(flows: DataFrame, top: int = 20) -> DataFrame:
    return flows.where("uuid is null").groupBy("remote_ip", "remote_port").agg(F.count(F.lit(1)).alias("packets")).orderBy(F.desc("packets"), "remote_ip", "remote_port").limit(top)
