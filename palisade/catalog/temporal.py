"""Per-address ordered queries, blacklists, correlation and flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade import constants as K
from palisade.catalog.registry import query
from palisade.catalog.twins import sql_in
from palisade.operators import flows as FL
from palisade.operators import temporal as W
from palisade.sources import adapters as A
from palisade.sources import readers

EV = ["event_id", "ip", "t_us"]


def slim(spark, d):
    return A.attack_events(spark, d).select(*EV)


@query("w01_sequences", """SELECT ip, t_us, event_id, position, 10 AS steps, first_score, final_score AS last_score, round(total, 4) AS total_score FROM (
SELECT *, row_number() OVER (PARTITION BY ip ORDER BY t_us, event_id) AS position, first_value(final_score) OVER w AS first_score, sum(final_score) OVER w AS total
FROM attack_events WINDOW w AS (PARTITION BY ip ORDER BY t_us, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) WHERE position >= 10""")
def _(spark, d):
    out = W.sequences(A.attack_events(spark, d), ["ip"], "t_us", "event_id", ["final_score", "network_score"])
    s = F.col("sequence")
    total = F.aggregate(s, F.lit(0.0), lambda acc, x: acc + x[0])
    return out.select("ip", "t_us", "event_id", "position", F.size(s).alias("steps"), s[0][0].alias("first_score"), s[9][0].alias("last_score"), F.round(total, 4).alias("total_score"))


@query("w02_gaps", """SELECT packet_id, gap_us, CASE WHEN gap_us > 1000000 THEN gap_us END AS idle_us FROM (
SELECT packet_id, CASE WHEN t_us - p < 30000000 THEN t_us - p END AS gap_us FROM (
SELECT *, lag(t_us) OVER (PARTITION BY remote_ip ORDER BY t_us, packet_id) AS p FROM packets))""")
def _(spark, d):
    return W.gaps(A.packets(spark, d)).select("packet_id", "gap_us", "idle_us")


@query("w03_newest_per_ip", """SELECT event_id, ip, ts_us, CAST(row_rank AS INTEGER) AS row_rank FROM (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY ts_us DESC, event_id DESC) AS row_rank FROM attack_events)
WHERE row_rank <= 50""")
def _(spark, d):
    return W.newest_n(A.attack_events(spark, d).select("event_id", "ip", "ts_us"), ["ip"], K.CORRELATION_HISTORY_CAP)


@query("w03_first_per_ip", """SELECT event_id, ip, ts_us FROM (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY ts_us, event_id) AS r FROM attack_events) WHERE r = 1""")
def _(spark, d):
    return W.first_per_key(A.attack_events(spark, d).select("event_id", "ip", "ts_us"), ["ip"])


_SETS = f"""SELECT event_id, ip, t_us, layer, "type", score, list_sort(list_distinct(list(layer) OVER w)) AS layers_seen,
list_sort(list_distinct(list(CASE WHEN "type" NOT IN {sql_in(K.BENIGN_CORRELATION_TYPES)} THEN "type" END) OVER w)) AS types_seen, count(*) OVER w AS history_count
FROM correlation_events WINDOW w AS (PARTITION BY ip ORDER BY t_us RANGE BETWEEN 10000000 PRECEDING AND CURRENT ROW)"""
_AMPLIFY = f"""SELECT event_id, array_to_string(layers_seen, ',') AS layers_seen, array_to_string(types_seen, ',') AS types_seen, history_count, correlated, distinct_types, multiplier, round(least(score * multiplier, 1.0), 4) AS amplified_score FROM (
SELECT *, CASE WHEN correlated THEN CASE WHEN distinct_types >= 4 THEN 1.7 WHEN distinct_types = 3 THEN 1.5 WHEN distinct_types = 2 THEN 1.3 ELSE 1.0 END ELSE 1.0 END::DOUBLE AS multiplier FROM (
SELECT *, list_contains(layers_seen, 'network') AND list_contains(layers_seen, 'application') AS correlated, CAST(greatest(len(types_seen), 1) AS INTEGER) AS distinct_types
FROM ({{sets}})))"""


def joined_sets(df):
    """Sets as comma lists, for output."""
    return df.withColumn("layers_seen", F.array_join("layers_seen", ",")).withColumn("types_seen", F.array_join("types_seen", ","))


@query("w04_trailing_sets", f"SELECT event_id, array_to_string(layers_seen, ',') AS layers_seen, array_to_string(types_seen, ',') AS types_seen, history_count FROM ({_SETS})")
def _(spark, d):
    return joined_sets(W.trailing_sets(A.correlation_events(spark, d))).select("event_id", "layers_seen", "types_seen", "history_count")


@query("w05_sliding_count", """SELECT event_id, n AS request_count, n > 4 AS rate_limited FROM (
SELECT event_id, count(*) OVER (PARTITION BY ip ORDER BY t_us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS n FROM attack_events)""")
def _(spark, d):
    return W.sliding_count(slim(spark, d), limit=4).select("event_id", "request_count", "rate_limited")


@query("k02_rate_limited_sliding", """SELECT event_id, ip, n AS request_count FROM (
SELECT event_id, ip, count(*) OVER (PARTITION BY ip ORDER BY t_us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS n FROM attack_events) WHERE n > 8""")
def _(spark, d):
    return W.sliding_count(slim(spark, d), limit=8).where("rate_limited").select("event_id", "ip", "request_count")


_SESSION = """SELECT event_id, ip, t_us, row_number() OVER (PARTITION BY ip, sess ORDER BY t_us, event_id) AS session_requests FROM (
SELECT *, sum(CASE WHEN p IS NULL OR t_us - p >= {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY ip ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING) AS sess FROM (
SELECT event_id, ip, t_us, lag(t_us) OVER (PARTITION BY ip ORDER BY t_us, event_id) AS p FROM attack_events))"""


@query("w06_session_count", f"SELECT event_id, session_requests, session_requests > 20 AS rate_limited FROM ({_SESSION.format(gap=60000000)})")
def _(spark, d):
    return W.session_count(slim(spark, d), limit=20).select("event_id", "session_requests", "rate_limited")


@query("w06_session_count_short", f"SELECT event_id, session_requests, session_requests > 3 AS rate_limited FROM ({_SESSION.format(gap=15000000)})")
def _(spark, d):
    return W.session_count(slim(spark, d), seconds=15, limit=3).select("event_id", "session_requests", "rate_limited")


HISTORY_AT = 600 * 1_000_000


@query("w07_history", f'SELECT event_id, ip, t_us, layer, "type", score FROM correlation_events WHERE t_us BETWEEN {HISTORY_AT - 60_000_000} AND {HISTORY_AT} ORDER BY ip, t_us')
def _(spark, d):
    return W.history(A.correlation_events(spark, d), HISTORY_AT)


@query("j01_blacklist_join", f"""SELECT e.event_id, e.ip, e.t_us, EXISTS (SELECT 1 FROM blacklist b WHERE b.ip = e.ip AND b.blocked_us <= e.t_us
AND coalesce(b.expires_us, {W.FOREVER_US}) > e.t_us AND coalesce(b.unblocked_us, {W.FOREVER_US}) > e.t_us) AS is_blacklisted FROM attack_events e""")
def _(spark, d):
    return W.blacklist_join(slim(spark, d), A.blacklist(spark, d))


_ASOF = """SELECT e.event_id, CASE WHEN e.t_us - t.t_us < 60000000 THEN t.score ELSE 0.0 END AS threat_score, CASE WHEN e.t_us - t.t_us < 60000000 THEN t.attack_type END AS threat_type
FROM attack_events e ASOF LEFT JOIN network_threats t ON e.ip = t.ip AND e.t_us >= t.t_us"""


@query("j02_asof_threat", _ASOF)
def _(spark, d):
    return W.asof_threat(slim(spark, d), A.network_threats(spark, d)).select("event_id", "threat_score", "threat_type")


@query("j12_lookup_state", f"""SELECT a.event_id, a.threat_score, s.session_requests, s.session_requests > 20 AS rate_limited, EXISTS (SELECT 1 FROM blacklist b WHERE b.ip = s.ip AND b.blocked_us <= s.t_us
AND coalesce(b.expires_us, {W.FOREVER_US}) > s.t_us AND coalesce(b.unblocked_us, {W.FOREVER_US}) > s.t_us) AS is_blacklisted
FROM ({_ASOF}) a JOIN ({_SESSION.format(gap=60000000)}) s ON a.event_id = s.event_id""")
def _(spark, d):
    out = W.lookup_state(slim(spark, d), A.blacklist(spark, d), A.network_threats(spark, d), limit=20)
    return out.select("event_id", "is_blacklisted", "session_requests", "rate_limited", "threat_score")


@query("d22_correlate", _AMPLIFY.format(sets=_SETS))
def _(spark, d):
    out = joined_sets(W.correlate(A.correlation_events(spark, d)))
    return out.select("event_id", "layers_seen", "types_seen", "history_count", "correlated", "distinct_types", "multiplier", "amplified_score")



@query("k03_correlate_capped", f"""SELECT c.event_id, string_agg(DISTINCT c2.layer, ',' ORDER BY c2.layer) AS layers_seen,
coalesce(string_agg(DISTINCT c2."type", ',' ORDER BY c2."type") FILTER (WHERE c2."type" NOT IN {sql_in(K.BENIGN_CORRELATION_TYPES)}), '') AS types_seen, count(*) AS history_count
FROM (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY t_us, event_id) AS rn FROM correlation_events) c
JOIN (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY t_us, event_id) AS rn FROM correlation_events) c2
ON c.ip = c2.ip AND c2.rn BETWEEN c.rn - 2 AND c.rn AND c2.t_us >= c.t_us - 10000000 GROUP BY c.event_id""")
def _(spark, d):
    return joined_sets(W.correlate(A.correlation_events(spark, d), cap=3)).select("event_id", "layers_seen", "types_seen", "history_count")


@query("k06_newest_buffer", "SELECT event_id, ip, t_us FROM attack_events ORDER BY t_us DESC, event_id DESC LIMIT 10000")
def _(spark, d):
    return W.newest_buffer(slim(spark, d), ts_us="t_us")


_FLOW_SQL = """WITH RECURSIVE ordered AS (
  SELECT *, row_number() OVER (PARTITION BY remote_ip ORDER BY t_us, packet_id) AS rn FROM packets),
walk AS (
  SELECT remote_ip, rn, packet_id, t_us, flags, t_us AS flow_us, packet_id AS session_packet, CAST(NULL AS BIGINT) AS idle_us FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.remote_ip, o.rn, o.packet_id, o.t_us, o.flags,
    CASE WHEN (w.flags & 5) <> 0 OR o.t_us - w.t_us > 30000000 OR o.t_us - w.flow_us > 120000000 THEN o.t_us ELSE w.flow_us END,
    CASE WHEN (w.flags & 5) <> 0 OR o.t_us - w.t_us > 30000000 THEN o.packet_id ELSE w.session_packet END,
    CASE WHEN (w.flags & 5) <> 0 OR o.t_us - w.t_us > 30000000 OR o.t_us - w.flow_us > 120000000 THEN NULL WHEN o.t_us - w.t_us > 1000000 THEN o.t_us - w.t_us END
  FROM walk w JOIN ordered o ON o.remote_ip = w.remote_ip AND o.rn = w.rn + 1),
f AS (SELECT w.remote_ip, w.flow_us, w.session_packet, count(*) AS n, max(w.t_us) AS last_us,
  count(*) FILTER (WHERE p.direction = 'fwd') AS nf, count(*) FILTER (WHERE p.direction = 'bwd') AS nb,
  coalesce(sum(p.length) FILTER (WHERE p.direction = 'fwd'), 0)::DOUBLE AS lf, coalesce(sum(p.length) FILTER (WHERE p.direction = 'bwd'), 0)::DOUBLE AS lb, sum(p.length)::DOUBLE AS total,
  count(*) FILTER (WHERE (p.flags & 2) <> 0) AS syn, count(*) FILTER (WHERE (p.flags & 16) <> 0) AS ack, count(*) FILTER (WHERE (p.flags & 8) <> 0) AS psh,
  stddev_pop(p.length) AS sd, avg(w.idle_us) AS im, stddev_pop(w.idle_us) AS isd
  FROM walk w JOIN packets p ON p.packet_id = w.packet_id GROUP BY w.remote_ip, w.flow_us, w.session_packet HAVING count(*) >= 4)
SELECT remote_ip, flow_us, session_packet, round((last_us - flow_us)::DOUBLE, 3) AS "flow duration", nf::DOUBLE AS "total fwd packets", nb::DOUBLE AS "total backward packets",
  lf AS "total length of fwd packets", lb AS "total length of bwd packets", round(CASE WHEN nf > 0 THEN lf / nf ELSE 0 END, 4) AS "fwd packet length mean",
  round(CASE WHEN nb > 0 THEN lb / nb ELSE 0 END, 4) AS "bwd packet length mean", round(total / greatest((last_us - flow_us) / 1e6, 1e-9), 4) AS "flow bytes/s",
  round(n / greatest((last_us - flow_us) / 1e6, 1e-9), 4) AS "flow packets/s", syn::DOUBLE AS "syn flag count", ack::DOUBLE AS "ack flag count", psh::DOUBLE AS "psh flag count",
  round(total / n, 4) AS "packet length mean", round(sd, 4) AS "packet length std", round(coalesce(im, 0), 2) AS "idle mean", round(coalesce(isd, 0), 2) AS "idle std" FROM f"""

FLOW_DIGITS = {"flow duration": 3, "idle mean": 2, "idle std": 2}


def rounded_flows(df):
    return df.select("remote_ip", "flow_us", "session_packet", *[F.round(f"`{c}`", FLOW_DIGITS.get(c, 4)).alias(c) for c in K.FLOW_FEATURES])


@query("k01_flows", _FLOW_SQL)
def _(spark, d):
    return rounded_flows(FL.flows(A.packets(spark, d)))


@query("s05_packets", "SELECT packet_id, remote_ip, t_us, length, flags, direction FROM packets WHERE packet_id % 50 <> 7")
def _(spark, d):
    return readers.packets(A.raw_packets(spark, d), "192.168.0.10")


@query("f19_flag_set", """SELECT flags, (flags & 1) <> 0 AS fin, (flags & 2) <> 0 AS syn, (flags & 4) <> 0 AS rst, (flags & 8) <> 0 AS psh, (flags & 16) <> 0 AS ack, count(*) AS n
FROM packets GROUP BY 1, 2, 3, 4, 5, 6""")
def _(spark, d):
    from palisade.functions.text import flag_set
    bits = {"fin": K.FLAG_FIN, "syn": K.FLAG_SYN, "rst": K.FLAG_RST, "psh": K.FLAG_PSH, "ack": K.FLAG_ACK}
    counts = A.packets(spark, d).groupBy("flags").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("flags", *[flag_set(F.col("flags"), b).alias(n) for n, b in bits.items()], "n")
