"""Event search and dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade import constants as K
from palisade.catalog.registry import query
from palisade.catalog.twins import lit, sql_in
from palisade.operators import dashboards as D
from palisade.operators.scale import percentiles
from palisade.sources import adapters as A

AS_OF_US = A.EPOCH_2024_US + 30 * 86_400 * 1_000_000
DAY = f"ts_us >= {AS_OF_US} - 86400000000"
FORTNIGHT = 14 * 86_400
TWO_WEEKS = f"ts_us >= {AS_OF_US} - 1209600000000"
EVENT_COLS = ["request_id", "ip", "method", "path", "timestamp", "final_score", "action", "block_reason", "best_label"]
EVENT_LIST = 'request_id, ip, method, path, "timestamp", final_score, action, block_reason, best_label'
ISO = """strftime(make_timestamp({0}), '%Y-%m-%dT%H:%M:%S') || CASE WHEN {0} % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST({0} % 1000000 AS VARCHAR), 6, '0') END || '+00:00'"""


def events(spark, d):
    return A.attack_events(spark, d)


def last_day(spark, d):
    return D.within(events(spark, d), AS_OF_US, 86_400)


def last_weeks(spark, d):
    return D.within(events(spark, d), AS_OF_US, FORTNIGHT)


@query("p01_search_events", f"""SELECT {EVENT_LIST} FROM attack_events
WHERE action = 'BLOCK' AND (best_label ILIKE '%SQL%' OR block_reason ILIKE '%SQL%') ORDER BY "timestamp" DESC, request_id LIMIT 100""")
def _(spark, d):
    return D.search_events(events(spark, d), action="block", attack_type="SQL").select(*EVENT_COLS)


@query("p01_search_events_ip", f"""SELECT {EVENT_LIST} FROM attack_events WHERE ip = '10.0.0.8' ORDER BY "timestamp" DESC, request_id LIMIT 500""")
def _(spark, d):
    return D.search_events(events(spark, d), limit=500, ip="10.0.0.8").select(*EVENT_COLS)


@query("p02_search_nested", f"""SELECT {EVENT_LIST} FROM attack_events e
WHERE lower(block_reason) LIKE '%xss%' OR EXISTS (SELECT 1 FROM event_layers l WHERE l.event_id = e.event_id AND lower(l.label) LIKE '%xss%')
ORDER BY "timestamp" DESC, request_id LIMIT 200""")
def _(spark, d):
    return D.search_events_nested(events(spark, d), limit=200, attack_type="XSS").select(*EVENT_COLS)


@query("p03_filter_contains", f"""SELECT {EVENT_LIST} FROM attack_events WHERE contains(ip, '.0.1') AND action = 'THROTTLE'
AND contains(best_label, 's') ORDER BY "timestamp" DESC, request_id LIMIT 100""")
def _(spark, d):
    return D.filter_contains(events(spark, d), ip=".0.1", action="THROTTLE", label="s").select(*EVENT_COLS)


@query("p04_within_day", f"SELECT {EVENT_LIST} FROM attack_events WHERE {DAY}")
def _(spark, d):
    return last_day(spark, d).select(*EVENT_COLS)


@query("t01_newest_events", f'SELECT {EVENT_LIST} FROM attack_events ORDER BY "timestamp" DESC, request_id LIMIT 500')
def _(spark, d):
    return D.newest(events(spark, d), 500).select(*EVENT_COLS)


@query("a01_summary", f"""SELECT count(*) AS total_requests, count(*) FILTER (WHERE action = 'BLOCK') AS blocked_attacks,
count(*) FILTER (WHERE action = 'ALLOW') AS allowed_requests, count(*) FILTER (WHERE action IN ('THROTTLE','CAPTCHA','DELAY')) AS throttled_captcha,
round(count(*) FILTER (WHERE action = 'BLOCK') / count(*) * 100, 1) AS block_rate_pct, round(coalesce(avg(latency_ms), 0), 1) AS avg_latency_ms
FROM attack_events WHERE {DAY} HAVING count(*) > 0""")
def _(spark, d):
    return D.summary(last_day(spark, d))


_RPM = f"""SELECT CAST(({AS_OF_US} - ts_us) // 60000000 AS INTEGER) AS mins_ago, count(*) AS total, count(*) FILTER (WHERE action = 'BLOCK') AS blocked
FROM attack_events WHERE ts_us >= {AS_OF_US} - 1800000000 GROUP BY 1"""


@query("a02_rpm", _RPM)
def _(spark, d):
    return D.rpm(events(spark, d), AS_OF_US)


@query("a03_rpm_dense", f"""SELECT CAST(s.slot AS INTEGER) AS slot, coalesce(r.total, 0) AS total, coalesce(r.blocked, 0) AS blocked
FROM (SELECT unnest(generate_series(0, 29)) AS slot) s LEFT JOIN ({_RPM}) r ON r.mins_ago = 29 - s.slot""")
def _(spark, d):
    return D.rpm_dense(events(spark, d), AS_OF_US)


@query("a04_top_ips", f"""SELECT ip, requests, blocked, max_score, coalesce({ISO.format('last')}, '') AS last_attack_iso FROM (
SELECT ip, count(*) AS requests, count(*) FILTER (WHERE action = 'BLOCK') AS blocked, round(max(final_score), 4) AS max_score,
max(ts_us) FILTER (WHERE action = 'BLOCK') AS last FROM attack_events WHERE {TWO_WEEKS} GROUP BY ip
ORDER BY blocked DESC, max_score DESC, ip LIMIT 20)""")
def top_threat_ips(spark, d):
    return D.top_ips(last_weeks(spark, d))


@query("a05_top_ips_argmax", f"""SELECT ip, requests, blocked, round(top, 4) AS max_score, CASE WHEN top > 0 THEN {ISO.format('"at"')} ELSE '' END AS last_attack_iso
FROM (SELECT e.ip, count(*) AS requests, count(*) FILTER (WHERE action = 'BLOCK') AS blocked, max(m.top) AS top,
min(ts_us) FILTER (WHERE final_score = m.top) AS "at" FROM attack_events e JOIN (SELECT ip, max(final_score) AS top FROM attack_events WHERE {TWO_WEEKS} GROUP BY ip) m
ON e.ip = m.ip WHERE {TWO_WEEKS} GROUP BY e.ip ORDER BY blocked DESC, e.ip LIMIT 20)""")
def _(spark, d):
    return D.top_ips_argmax(last_weeks(spark, d))


@query("a06_attack_types", f"""SELECT best_label, count(*) AS cnt FROM attack_events WHERE {TWO_WEEKS} AND best_label NOT IN {sql_in(K.BENIGN_CHART_LABELS)}
GROUP BY 1 ORDER BY cnt DESC, best_label LIMIT 10""")
def _(spark, d):
    return D.attack_types(last_weeks(spark, d))


@query("a07_attack_types_nested", f"""SELECT label, count(*) AS cnt FROM (
SELECT l.event_id, arg_min(CASE WHEN l.label <> '' THEN l.label ELSE e.block_reason END, l.pos) AS label FROM event_layers l JOIN attack_events e ON e.event_id = l.event_id
WHERE {TWO_WEEKS} AND (l.triggered OR l.score > 0.5) AND (CASE WHEN l.label <> '' THEN l.label ELSE e.block_reason END) NOT IN {sql_in(K.BENIGN_EVENT_LABELS)}
GROUP BY l.event_id) GROUP BY label""")
def _(spark, d):
    return D.attack_types_nested(last_weeks(spark, d))


@query("a08_layer_counts", f"""SELECT l.layer, count(*) AS cnt FROM event_layers l JOIN attack_events e ON e.event_id = l.event_id
WHERE {TWO_WEEKS} AND l.triggered GROUP BY 1""")
def _(spark, d):
    return D.layer_counts(last_weeks(spark, d))


@query("a09_layer_first", f"""SELECT layer, count(*) AS cnt FROM (SELECT l.event_id, arg_min(l.layer, l.pos) AS layer
FROM event_layers l JOIN attack_events e ON e.event_id = l.event_id WHERE {TWO_WEEKS} AND l.triggered GROUP BY l.event_id) GROUP BY 1""")
def _(spark, d):
    return D.layer_first(last_weeks(spark, d))


@query("a19_geo_feed", """SELECT ip, ts_us, event_id, final_score, action, best_label FROM (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY ts_us DESC, event_id DESC) AS r
FROM attack_events WHERE action = 'BLOCK' OR final_score > 0.4) WHERE r = 1 ORDER BY ts_us DESC, event_id DESC LIMIT 25""")
def _(spark, d):
    return D.geo_feed(events(spark, d))


@query("a21_dashboard_cube", f"""SELECT action, best_label, ip, CAST(minute AS BIGINT) AS minute, CAST(grouping(action, best_label, ip, minute) AS BIGINT) AS grouping_id, count(*) AS cnt,
count(*) FILTER (WHERE action = 'BLOCK') AS blocked, max(final_score) AS max_score
FROM (SELECT *, ts_us // 60000000 AS minute FROM attack_events WHERE {DAY}) GROUP BY GROUPING SETS ((), (action), (best_label), (ip), (minute))""")
def _(spark, d):
    return D.dashboard_cube(last_day(spark, d))


@query("j11_explode_layers", "SELECT request_id, CAST(pos AS INTEGER) AS pos, layer, score, label, confidence, triggered FROM event_layers")
def _(spark, d):
    stored = events(spark, d).select("request_id", F.to_json("layer_scores").alias("layer_json"))
    return D.explode_layers(D.parse_layers(stored, "layer_json"), "request_id")


@query("a11_class_dist", "SELECT best_label, count(*) AS cnt, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM attack_events GROUP BY 1")
def _(spark, d):
    return D.class_dist(events(spark, d), "best_label")


@query("a12_imbalance", """SELECT max(c) AS max_class, min(c) AS min_class, round(max(c) / min(c), 4) AS ratio,
CASE WHEN max(c) / min(c) > 100 THEN 'high' WHEN max(c) / min(c) > 20 THEN 'moderate' ELSE 'acceptable' END AS verdict
FROM (SELECT label, count(*) AS c FROM flow_table GROUP BY 1)""")
def _(spark, d):
    return D.imbalance(A.flow_table(spark, d), "label")


FOCUS = ["flow bytes/s", "flow packets/s", "total fwd packets", "syn flag count", "flow duration", "packet length mean"]


@query("a13_feature_ranges", " UNION ALL ".join(
    f"""SELECT label, {lit(f)} AS feature, round(avg("{f}"), 6) AS mean, round(stddev_samp("{f}"), 6) AS std, round(min("{f}"), 6) AS "min",
round(max("{f}"), 6) AS "max", count("{f}") AS n FROM flow_table GROUP BY label""" for f in FOCUS))
def _(spark, d):
    return D.feature_ranges(A.flow_table(spark, d), "label", FOCUS)


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("a14_describe", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS "min",
quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75, max({c}) AS "max" FROM lineitem""" for c in NUMERIC))
def _(spark, d):
    df = A.table(spark, d, "lineitem").select(*NUMERIC)
    wide = df.agg(*[F.struct(F.count(c).alias("count"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_samp(c), 6).alias("std"),
                             F.min(c).alias("min"), F.max(c).alias("max")).alias(c) for c in NUMERIC])
    stats = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in NUMERIC])).alias("r")).select("r.column", "r.s.*")
    q = percentiles(df, NUMERIC, [0.25, 0.5, 0.75]).groupBy("column").agg(*[
        F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
    return stats.join(q, "column")


PROBS = [0.01, 0.05, 0.5, 0.95, 0.99, 0.999]


@query("a15_percentiles", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {p}::DOUBLE AS prob, round(quantile_cont("{c}", {p}), 6) AS value FROM flow_table"""
    for c in ["flow duration", "flow bytes/s", "packet length std"] for p in PROBS))
def _(spark, d):
    out = percentiles(A.flow_table(spark, d), ["flow duration", "flow bytes/s", "packet length std"], PROBS)
    return out.select("column", "prob", F.round("value", 6).alias("value"))


@query("a16_latency_stats", """SELECT count(latency_ms) AS n, round(avg(latency_ms), 6) AS mean_ms, quantile_cont(latency_ms, 0.5) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms,
round(quantile_cont(latency_ms, 0.99), 6) AS p99_ms, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms, round(stddev_samp(latency_ms), 6) AS std_ms,
round(1000.0::DOUBLE / avg(latency_ms), 6) AS per_second FROM attack_events""")
def _(spark, d):
    ev = events(spark, d)
    base = ev.agg(F.count("latency_ms").alias("n"), F.round(F.avg("latency_ms"), 6).alias("mean_ms"), F.min("latency_ms").alias("min_ms"),
                  F.max("latency_ms").alias("max_ms"), F.round(F.stddev_samp("latency_ms"), 6).alias("std_ms"),
                  F.round(F.lit(1000.0) / F.avg("latency_ms"), 6).alias("per_second"))
    q = percentiles(ev, ["latency_ms"], [0.5, 0.95, 0.99]).agg(*[
        F.round(F.max(F.when(F.col("prob") == p, F.col("value"))), 6).alias(n) for p, n in ((0.5, "p50_ms"), (0.95, "p95_ms"), (0.99, "p99_ms"))])
    return base.crossJoin(q)


@query("a20_per_file_counts", """SELECT f AS source_file, label, count(*) AS cnt FROM (
SELECT 'orders.parquet' AS f, o_orderpriority AS label FROM orders UNION ALL SELECT 'customer.parquet', c_mktsegment FROM customer) GROUP BY 1, 2""")
def _(spark, d):
    from palisade.sources.readers import per_file_counts
    o = A.table(spark, d, "orders").select(F.col("o_orderpriority").alias("label"))
    c = A.table(spark, d, "customer").select(F.col("c_mktsegment").alias("label"))
    return per_file_counts(o, "label").unionByName(per_file_counts(c, "label"))
