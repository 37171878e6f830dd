"""Packets to flows on event time.

A flow of a remote address ends with a FIN or RST packet, after 30 s of silence, or when a packet is
more than 120 s younger than the flow's first packet (that packet opens the next flow). The first two
rules are local; the age rule chains flows, and is solved by pointer doubling over distinct packet
times so that even a flood from one address is never folded in a single task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade import constants as K
from palisade.functions.text import flag_set
from palisade.operators.scale import US, ordered_scan, previous_within, time_bucket
from palisade.session import materialize


def mark_sessions(packets: DataFrame, idle: int = K.FLOW_IDLE_SECONDS, key: str = "remote_ip") -> DataFrame:
    """Append ``session_us`` and ``session_packet``: first packet of the run unbroken by silence, FIN or RST."""
    order = ["t_us", "packet_id"]
    prev = previous_within(packets, [key], order, "t_us", idle + 1, ["t_us", "flags"])
    gap = F.col("t_us") - F.col("prev_t_us")
    closed = flag_set(F.coalesce("prev_flags", F.lit(0)), K.FLAG_FIN | K.FLAG_RST)
    opens = F.col("prev_t_us").isNull() | (gap > idle * US) | closed
    marked = prev.withColumn("__open", F.when(opens, F.struct("t_us", "packet_id"))).withColumn("__bucket", time_bucket(F.col("t_us"), idle))
    filled = ordered_scan(marked, [key], "__bucket", order, fill={"__s": "__open"})
    idle_us = F.when(~opens & (gap > K.IDLE_GAP_SECONDS * US), gap)
    return filled.select(*packets.columns, idle_us.alias("idle_us"), F.col("__s.t_us").alias("session_us"), F.col("__s.packet_id").alias("session_packet"))


def flow_starts(sessions: DataFrame, idle: int, max_age: int, key: str) -> DataFrame:
    """Start times of all flows: session starts and, within long sessions, the chain of age cuts."""
    sess = [key, "session_us", "session_packet"]
    spans = sessions.groupBy(*sess).agg(F.max("t_us").alias("end_us"))
    roots = spans.select(*sess, F.col("session_us").alias("start_us"))
    long = spans.where(F.col("end_us") - F.col("session_us") > max_age * US)
    longest = long.agg(F.max(F.col("end_us") - F.col("session_us"))).first()[0]
    if longest is None:
        return roots
    # Distinct packet times of long sessions; each points to the first time more than max_age later.
    times = sessions.join(long.select(*sess), sess, "left_semi").select(*sess, "t_us").distinct()
    # Scanned backwards in time, the next start of a packet is the last time met before its probe.
    gone = max_age * US + 1
    marks = times.select(*sess, F.col("t_us").alias("x_us"), F.lit(0).alias("__kind"), F.col("t_us").alias("__time"), F.lit(None).cast("bigint").alias("at_us"))
    probes = times.select(*sess, (F.col("t_us") + gone).alias("x_us"), F.lit(1).alias("__kind"), F.lit(None).cast("bigint").alias("__time"), F.col("t_us").alias("at_us"))
    both = marks.unionByName(probes).withColumn("__back", -F.col("x_us")).withColumn("__bucket", -F.floor(F.col("x_us") / F.lit(max_age * US)))
    ahead = ordered_scan(both, sess, "__bucket", ["__back", "__kind"], fill={"next_us": "__time"})
    jump = ahead.where((F.col("__kind") == 1) & F.col("next_us").isNotNull()).select(*sess, "at_us", "next_us")
    reached = roots.join(long.select(*sess), sess, "left_semi")
    rounds = max(1, math.ceil(math.log2(longest / (max_age * US) + 1)))
    jump = materialize(jump, "jump")
    for i in range(rounds):
        # After round i the set holds every start within 2**(i+1) - 1 cuts of the session start.
        hop = jump.withColumnRenamed("at_us", "start_us")
        step = reached.join(hop, [*sess, "start_us"]).select(*sess, F.col("next_us").alias("start_us"))
        reached = reached.unionByName(step).distinct()
        if i + 1 < rounds:
            far = jump.select(*sess, F.col("at_us").alias("next_us"), F.col("next_us").alias("far_us"))
            jump = materialize(jump.join(far, [*sess, "next_us"]).select(*sess, "at_us", F.col("far_us").alias("next_us")), "jump")
            if i % 4 == 3:
                reached = materialize(reached, "starts")
    return roots.unionByName(reached).distinct()


def assign_flows(packets: DataFrame, idle: int = K.FLOW_IDLE_SECONDS, max_age: int = K.FLOW_MAX_SECONDS, key: str = "remote_ip") -> DataFrame:
    """Every packet with its session and the start of its flow."""
    sess = [key, "session_us", "session_packet"]
    sessions = materialize(mark_sessions(packets, idle, key), "sessions")
    starts = flow_starts(sessions, idle, max_age, key).select(*sess, F.col("start_us").alias("t_us"), F.col("start_us").alias("__start"), F.lit(-1).cast("bigint").alias("packet_id"))
    both = sessions.unionByName(starts, allowMissingColumns=True).withColumn("__bucket", time_bucket(F.col("t_us"), max_age))
    filled = ordered_scan(both, sess, "__bucket", ["t_us", "packet_id"], fill={"flow_us": "__start"})
    return filled.where(F.col("packet_id") >= 0).drop("__bucket", "__start")


def flow_features(assigned: DataFrame, min_packets: int = K.FLOW_MIN_PACKETS, key: str = "remote_ip") -> DataFrame:
    """The 16 features per flow as one hash aggregate (partial sums on the map side)."""
    fwd, bwd, n = F.col("direction") == "fwd", F.col("direction") == "bwd", F.col("length")
    first = F.col("t_us") == F.col("flow_us")
    idle = F.when(~first, F.col("idle_us"))
    g = assigned.groupBy(key, "session_us", "session_packet", "flow_us").agg(
        F.count(F.lit(1)).alias("n"), F.max("t_us").alias("last_us"),
        F.count(F.when(fwd, 1)).alias("nf"), F.count(F.when(bwd, 1)).alias("nb"),
        F.sum(F.when(fwd, n)).alias("lf"), F.sum(F.when(bwd, n)).alias("lb"), F.sum(n).alias("total"),
        F.count(F.when(flag_set(F.col("flags"), K.FLAG_SYN), 1)).alias("syn"),
        F.count(F.when(flag_set(F.col("flags"), K.FLAG_ACK), 1)).alias("ack"),
        F.count(F.when(flag_set(F.col("flags"), K.FLAG_PSH), 1)).alias("psh"),
        F.stddev_pop(n).alias("sd"), F.avg(idle).alias("im"), F.stddev_pop(idle).alias("isd"))
    secs = F.greatest((F.col("last_us") - F.col("flow_us")) / F.lit(1e6), F.lit(1e-9))
    d = lambda c: F.col(c).cast("double")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    values = {
        "flow duration": secs * 1e6, "total fwd packets": d("nf"), "total backward packets": d("nb"),
        "total length of fwd packets": zero("lf"), "total length of bwd packets": zero("lb"),
        "fwd packet length mean": F.when(F.col("nf") > 0, F.col("lf") / F.col("nf")).otherwise(0.0),
        "bwd packet length mean": F.when(F.col("nb") > 0, F.col("lb") / F.col("nb")).otherwise(0.0),
        "flow bytes/s": F.col("total") / secs, "flow packets/s": F.col("n") / secs,
        "syn flag count": d("syn"), "ack flag count": d("ack"), "psh flag count": d("psh"),
        "packet length mean": F.col("total") / F.col("n"), "packet length std": zero("sd"),
        "idle mean": zero("im"), "idle std": zero("isd"),
    }
    return g.where(F.col("n") >= min_packets).select(
        key, F.col("flow_us"), F.col("session_packet"), *[values[c].alias(c) for c in K.FLOW_FEATURES])


def flows(packets: DataFrame, idle: int = K.FLOW_IDLE_SECONDS, max_age: int = K.FLOW_MAX_SECONDS, min_packets: int = K.FLOW_MIN_PACKETS,
          key: str = "remote_ip") -> DataFrame:
    """Packets (packet_id, remote_ip, t_us, length, flags, direction) to one row of features per flow."""
    return flow_features(assign_flows(packets, idle, max_age, key), min_packets, key)
