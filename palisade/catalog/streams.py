"""Streaming twins (run over everything available) and source/sink round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade import constants as K
from palisade.catalog.detection import USER_RULES, signature_sql
from palisade.catalog.registry import query
from palisade.catalog.temporal import _FLOW_SQL, _SESSION, rounded_flows
from palisade.catalog.twins import sql_in
from palisade.operators import enrich as EN
from palisade.operators import evaluate as E
from palisade.operators import fusion as FU
from palisade.operators.rules import RuleBook
from palisade.session import fresh_dir
from palisade.sources import adapters as A
from palisade.sources import readers, sinks
from palisade.streaming import jobs as J
from palisade.streaming import ordered as OR
from palisade.streaming import state as ST

HALF_TIME_US = 360_000_000
FAR_US = 100 * 86_400 * 1_000_000


def staged(df, name):
    """Write rows to the shared folder as the files a stream reads."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return path


def stream_of(df, name, max_files=None):
    return J.file_stream(df.sparkSession, staged(df, name), df.schema, max_files)


DELAY, SLICES, FILES = 60, 4, 4


def disordered(df, name, key, tie):
    """A stream whose rows come up to ``DELAY`` seconds late, in several triggers; ends with a row far in the future.

    A row comes at its time plus a hash of its id; slices of the times of coming are written one after the other, and
    a trigger reads one slice. The last row, of a key of its own, moves the watermark past all others.
    """
    comes = F.col("t_us") + F.pmod(F.xxhash64(tie), F.lit(DELAY * 1_000_000))
    first, last = df.agg(F.min(comes), F.max(comes)).first()
    df = df.select("*", F.floor((comes - F.lit(first or 0)) * SLICES / F.lit((last or 0) - (first or 0) + 1)).alias("slice"))
    path = fresh_dir(df.sparkSession, name)
    for i in range(SLICES):
        df.where(F.col("slice") == i).drop("slice").repartition(FILES).write.mode("append").parquet(path)
    end = df.drop("slice").limit(1).select(*[F.lit("far").alias(c) if c == key else (F.lit(last or 0) + FAR_US).cast("bigint").alias(c) if c == "t_us" else F.col(c) for c in df.columns if c != "slice"])
    end.write.mode("append").parquet(path)
    return J.with_event_time(J.file_stream(df.sparkSession, path, df.drop("slice").schema, FILES), delay=f"{DELAY} seconds")


@query("k01_flow_stream_disordered", _FLOW_SQL)
def _(spark, d):
    return rounded_flows(J.run_to_table(OR.flows_in_order(disordered(A.packets(spark, d), "packets", "remote_ip", "packet_id")), "flows"))


@query("k02_rate_stream_disordered", f"SELECT event_id, session_requests, session_requests > 20 AS rate_limited FROM ({_SESSION.format(gap=60000000)})")
def _(spark, d):
    s = disordered(A.attack_events(spark, d).select("event_id", "ip", "t_us"), "requests", "ip", "event_id")
    return J.run_to_table(OR.session_rates_in_order(s, limit=20), "rates").select("event_id", "session_requests", "rate_limited")


@query("k02_sliding_stream", """SELECT event_id, n AS request_count, n > 120 AS rate_limited FROM (
SELECT event_id, count(*) OVER (PARTITION BY ip ORDER BY t_us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS n FROM attack_events)""")
def _(spark, d):
    s = disordered(A.attack_events(spark, d).select("event_id", "ip", "t_us"), "requests", "ip", "event_id")
    return J.run_to_table(OR.sliding_rates_in_order(s), "rates").select("event_id", "request_count", "rate_limited")


ACCESS_OPS = ("block", "block_permanent", "unblock", "captcha", "solve")
#: Every threat of an address is an operation on it, dealt by its id; permanent blocks come seldom.
_ACCESS_OP = "CASE WHEN threat_id % 11 = 0 THEN 'block_permanent' WHEN threat_id % 4 = 0 THEN 'block' WHEN threat_id % 4 = 1 THEN 'unblock' WHEN threat_id % 4 = 2 THEN 'captcha' ELSE 'solve' END"


def access_ops(spark, d):
    gets = A.attack_events(spark, d).select(F.col("ip").alias("key"), "event_id", F.lit("get").alias("op"), "t_us")
    sets = A.network_threats(spark, d).select(F.col("ip").alias("key"), F.col("threat_id").alias("event_id"), F.expr(_ACCESS_OP).alias("op"), "t_us")
    return gets.unionByName(sets)


@query("k04_access_stream", f"""WITH RECURSIVE ops AS (SELECT ip, t_us, threat_id AS id, {_ACCESS_OP} AS op, row_number() OVER (PARTITION BY ip ORDER BY t_us, threat_id) AS k FROM network_threats),
walk AS (
SELECT ip, 0::BIGINT AS k, -1::BIGINT AS t_us, NULL::VARCHAR AS b, NULL::BIGINT AS b_until, NULL::VARCHAR AS c, NULL::BIGINT AS c_until FROM (SELECT DISTINCT ip FROM ops)
UNION ALL
SELECT o.ip, o.k, o.t_us,
 CASE WHEN o.op = 'unblock' THEN NULL WHEN o.op = 'block_permanent' THEN 'permanent' WHEN o.op = 'block' AND coalesce(w.b, '') <> 'permanent' THEN 'temporary' ELSE w.b END,
 CASE WHEN o.op IN ('unblock', 'block_permanent') THEN NULL WHEN o.op = 'block' AND coalesce(w.b, '') <> 'permanent' THEN o.t_us + {K.TTL_BLACKLIST * 1_000_000} ELSE w.b_until END,
 CASE WHEN o.op = 'captcha' THEN 'pending' WHEN o.op = 'solve' AND w.c = 'pending' AND o.t_us < w.c_until THEN 'solved' ELSE w.c END,
 CASE WHEN o.op = 'captcha' OR (o.op = 'solve' AND w.c = 'pending' AND o.t_us < w.c_until) THEN o.t_us + {K.TTL_CAPTCHA * 1_000_000} ELSE w.c_until END
FROM walk w JOIN ops o ON o.ip = w.ip AND o.k = w.k + 1),
states AS (SELECT ip, t_us, arg_max(b, k) AS b, max_by(coalesce(b_until, -1), k) AS b_until, max_by(coalesce(c, ''), k) AS c, max_by(coalesce(c_until, -1), k) AS c_until, max_by(coalesce(b, ''), k) AS b_kind FROM walk WHERE k > 0 GROUP BY ip, t_us)
SELECT e.event_id, coalesce(s.b_kind = 'permanent' OR (s.b_kind = 'temporary' AND e.t_us < s.b_until), false) AS blocked, CASE WHEN s.c <> '' AND e.t_us < s.c_until THEN s.c END AS captcha
FROM attack_events e ASOF LEFT JOIN states s ON e.ip = s.ip AND e.t_us >= s.t_us""")
def _(spark, d):
    s = disordered(access_ops(spark, d), "access", "key", "event_id")
    return J.run_to_table(OR.access_in_order(s), "access-read").select("event_id", "blocked", "captcha")


@query("k01_flow_stream", _FLOW_SQL)
def _(spark, d):
    p = A.packets(spark, d)
    # One packet of another address far in the future moves the watermark past every open flow.
    last = p.limit(1).select(F.lit(-1).cast("bigint").alias("packet_id"), F.lit("far").alias("remote_ip"), F.lit(FAR_US).alias("t_us"),
                             F.lit(0).cast("bigint").alias("length"), F.lit(0).alias("flags"), F.lit("fwd").alias("direction"))
    s = J.with_event_time(stream_of(p.unionByName(last), "packets"), delay="0 seconds")
    return rounded_flows(J.run_to_table(ST.flow_stream(s), "flows"))


@query("k02_rate_stream", f"SELECT event_id, session_requests, session_requests > 20 AS rate_limited FROM ({_SESSION.format(gap=60000000)})")
def _(spark, d):
    s = J.with_event_time(stream_of(A.attack_events(spark, d).select("event_id", "ip", "t_us"), "requests"))
    return J.run_to_table(ST.rate_stream(s, limit=20), "rates").select("event_id", "session_requests", "rate_limited")


_CORRELATED = f"""SELECT event_id, correlated, distinct_types, multiplier, round(least(score * multiplier, 1.0), 4) AS amplified_score, history_count FROM (
SELECT *, CASE WHEN correlated THEN CASE WHEN distinct_types >= 4 THEN 1.7 WHEN distinct_types = 3 THEN 1.5 WHEN distinct_types = 2 THEN 1.3 ELSE 1.0 END ELSE 1.0 END::DOUBLE AS multiplier FROM (
SELECT c.event_id, c.score, count(*) FILTER (WHERE c2.layer = 'network') > 0 AND count(*) FILTER (WHERE c2.layer = 'application') > 0 AS correlated,
greatest(1, count(DISTINCT c2."type") FILTER (WHERE c2."type" NOT IN {sql_in(K.BENIGN_CORRELATION_TYPES)})) AS distinct_types, count(*) AS history_count
FROM (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY t_us, event_id) AS rn FROM correlation_events) c JOIN (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY t_us, event_id) AS rn FROM correlation_events) c2
ON c.ip = c2.ip AND c2.rn BETWEEN c.rn - 49 AND c.rn AND c2.t_us >= c.t_us - 10000000 GROUP BY c.event_id, c.score))"""


@query("k03_correlation_stream", _CORRELATED)
def _(spark, d):
    s = J.with_event_time(stream_of(A.correlation_events(spark, d), "correlation"))
    return J.run_to_table(ST.correlation_stream(s), "correlated").drop("ip")


@query("k03_correlation_stream_disordered", _CORRELATED)
def _(spark, d):
    s = disordered(A.correlation_events(spark, d), "correlation", "ip", "event_id")
    return J.run_to_table(OR.correlation_in_order(s), "correlated").drop("ip")


_TTL = """SELECT e.event_id, e.ip AS "key", CASE WHEN e.t_us - t.t_us < {us} THEN t.v END AS value FROM attack_events e ASOF LEFT JOIN (SELECT ip, t_us, CAST(threat_id AS VARCHAR) AS v FROM network_threats) t ON e.ip = t.ip AND e.t_us >= t.t_us"""


def ttl_ops(spark, d):
    gets = A.attack_events(spark, d).select(F.col("ip").alias("key"), "event_id", F.lit("get").alias("op"), F.lit(None).cast("string").alias("value"), "t_us")
    sets = A.network_threats(spark, d).select(F.col("ip").alias("key"), F.col("threat_id").alias("event_id"), F.lit("set").alias("op"), F.col("threat_id").cast("string").alias("value"), "t_us")
    return gets.unionByName(sets)


@query("k04_ttl_stream", _TTL.format(us=K.TTL_NETWORK_THREAT * 1_000_000))
def _(spark, d):
    s = J.with_event_time(stream_of(ttl_ops(spark, d), "ops"))
    return J.run_to_table(ST.ttl_stream(s, K.TTL_NETWORK_THREAT), "values")


@query("k04_ttl_stream_request_log", _TTL.format(us=K.TTL_REQUEST_LOG * 1_000_000))
def _(spark, d):
    s = J.with_event_time(stream_of(ttl_ops(spark, d), "ops"))
    return J.run_to_table(ST.ttl_stream(s, K.TTL_REQUEST_LOG), "values")


def timed_events(spark, d, *extra):
    e = A.attack_events(spark, d).select("request_id", "ts_us", "action", *extra)
    last = e.limit(1).select(*[(F.lit(A.EPOCH_2024_US + FAR_US) if c == "ts_us" else F.lit("far").alias(c)).alias(c) if c in ("request_id", "ts_us", "action") else F.col(c) for c in e.columns])
    return e.unionByName(last)


@query("k05_rpm_stream", """SELECT date_trunc('minute', event_time) AS "minute", count(*) AS total, count(*) FILTER (WHERE action = 'BLOCK') AS blocked FROM attack_events GROUP BY 1""")
def _(spark, d):
    s = J.with_event_time(stream_of(timed_events(spark, d), "events"), "ts_us", "0 seconds")
    return J.run_to_table(J.rpm_stream(s), "rpm").select(F.col("minute").cast("timestamp_ntz").alias("minute"), "total", "blocked")


@query("k07_dedupe_stream", "SELECT DISTINCT request_id, action FROM attack_events")
def _(spark, d):
    e = A.attack_events(spark, d).select("request_id", "action", "ts_us")
    s = J.with_event_time(stream_of(e.unionByName(e), "events"), "ts_us")
    return J.run_to_table(J.dedupe_stream(s).drop("event_time"), "distinct").select("request_id", "action")


# None of the stored user rules fires on these requests, so the twin is the fixed rule book.
@query("k08_score_stream", f"SELECT doc_id, decision, score, pattern_group, rule_id FROM ({signature_sql(RuleBook())})")
def _(spark, d):
    req, out = A.requests(spark, d), fresh_dir(spark, "verdicts")
    rules = staged(A.rule_store(spark, d), "rules")
    J.score_stream(stream_of(req, "requests", 2), rules, out, fresh_dir(spark, "verdicts-progress"), available_now=True).awaitTermination()
    return spark.read.parquet(out).select("doc_id", "decision", "score", "pattern_group", "rule_id")


_RELOADED = f"""SELECT doc_id, decision, score, pattern_group, rule_id, late AS with_user_rules FROM (
SELECT s.*, false AS late FROM ({signature_sql(RuleBook())}) s JOIN request_rows r ON r.doc_id = s.doc_id WHERE r.t_us < {HALF_TIME_US}
UNION ALL SELECT s.*, true FROM ({signature_sql(RuleBook(USER_RULES))}) s JOIN request_rows r ON r.doc_id = s.doc_id WHERE r.t_us >= {HALF_TIME_US})"""


@query("k08_rule_reload", _RELOADED)
def _(spark, d):
    """User rules are added when half of the requests are judged: they fire from the next trigger on, never before."""
    req, rules = A.requests(spark, d), staged(A.rule_store(spark, d), "rules")
    source, out, progress = fresh_dir(spark, "requests"), fresh_dir(spark, "verdicts"), fresh_dir(spark, "verdicts-progress")
    run = lambda: J.score_stream(J.file_stream(spark, source, req.schema, 2), rules, out, progress, available_now=True).awaitTermination()
    before = RuleBook.from_table(spark.read.parquet(rules)).version
    req.where(F.col("t_us") < HALF_TIME_US).write.mode("append").parquet(source)
    run()
    newer = spark.createDataFrame([(i, p, t, "active", A.EPOCH_2024_US * 2) for i, p, t in USER_RULES], "rule_id string, pattern string, attack_type string, status string, created_us long")
    newer.write.mode("append").parquet(rules)
    req.where(F.col("t_us") >= HALF_TIME_US).write.mode("append").parquet(source)
    run()
    return spark.read.parquet(out).select("doc_id", "decision", "score", "pattern_group", "rule_id", (F.col("rules_version") != before).alias("with_user_rules"))


@query("k06_newest_stream", "SELECT event_id, ip, t_us FROM attack_events ORDER BY t_us DESC, event_id DESC LIMIT 10000")
def _(spark, d):
    e = A.attack_events(spark, d).select("event_id", "ip", "t_us")
    source, table = fresh_dir(spark, "events"), fresh_dir(spark, "newest")
    e.repartition(2 * FILES).write.parquet(source)
    J.newest_stream(J.file_stream(spark, source, e.schema, FILES), table, fresh_dir(spark, "newest-progress"), ts_us="t_us", available_now=True).awaitTermination()
    return J.newest_of(spark, table)


@query("k09_late_rows", "SELECT count(*) AS n, count(*) FILTER (WHERE action = 'BLOCK') AS blocked FROM attack_events")
def _(spark, d):
    s = J.with_event_time(stream_of(A.attack_events(spark, d).select("request_id", "ts_us", "action"), "events"), "ts_us")
    kept = J.run_to_table(s, "on-time")
    return kept.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("action") == "BLOCK", 1)).alias("blocked"))


# -- sources and sinks ---------------------------------------------------------------------------------

@query("s01_read_flows_csv", """SELECT source, count(*) AS n, round(sum("Flow Duration"), 2) AS total, count("Flow IAT Max") AS iat FROM (
SELECT *, CASE WHEN row_id % 2 = 0 THEN 'a' ELSE 'b' END AS source FROM (SELECT row_id, "Flow Duration", CASE WHEN row_id % 2 = 0 THEN "Flow IAT Max" END AS "Flow IAT Max" FROM raw_flows)) GROUP BY 1""")
def _(spark, d):
    # Two CSV files with different, padded headers in one folder.
    raw, root = A.raw_flows(spark, d), fresh_dir(spark, "capture")
    pad = lambda df: df.toDF(*[f" {c} " for c in df.columns])
    even = raw.where("row_id % 2 = 0").select("row_id", "Flow Duration", "Flow IAT Max", F.lit("a").alias("source"))
    odd = raw.where("row_id % 2 = 1").select("row_id", "Flow Duration", F.lit("b").alias("source"))
    for part in (even, odd):
        pad(part).coalesce(1).write.mode("append").option("header", True).csv(root)
    flows = readers.read_flows_csv(spark, root)
    return flows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("`Flow Duration`").try_cast("double")), 2).alias("total"), F.count("Flow IAT Max").alias("iat"))


@query("s02_normalize_columns", "SELECT o_orderkey AS flow_id, o_totalprice AS flow_bytes_s, o_custkey AS src_port FROM orders")
def _(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias(" Flow ID"), F.col("o_totalprice").alias("Flow-Bytes S "), F.col("o_custkey").alias("Src Port"))
    return readers.normalize_columns(o, "snake")


@query("s03_read_headerless", """SELECT o_orderpriority AS service, count(*) AS n, sum(o_custkey)::DOUBLE AS src_bytes, round(avg(o_totalprice), 4) AS dst_bytes FROM orders GROUP BY 1""")
def _(spark, d):
    path = fresh_dir(spark, "connections")
    o = A.table(spark, d, "orders")
    take = {"protocol_type": F.lit("tcp"), "service": F.col("o_orderpriority"), "flag": F.lit("SF"), "label": F.lit("normal"), "src_bytes": F.col("o_custkey"), "dst_bytes": F.col("o_totalprice")}
    o.select(*[take.get(c, F.lit(0.0)).alias(c) for c in K.CONNECTION_COLUMNS]).write.csv(path)
    c = readers.read_headerless(spark, path)
    return c.groupBy("service").agg(F.count(F.lit(1)).alias("n"), F.sum("src_bytes").alias("src_bytes"), F.round(F.avg("dst_bytes"), 4).alias("dst_bytes"))


def hits_by_method(h):
    return h.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("threat_intel.ti_found"), 1)).alias("found"), F.sum(F.length("raw_body")).alias("chars"))


_HITS = "SELECT method, count(*) AS n, count(*) FILTER (WHERE doc_id % 3 = 0) AS found, sum(length(body)) ::BIGINT AS chars FROM request_rows GROUP BY 1"


@query("s04_read_honeypot_json", _HITS)
def _(spark, d):
    path = fresh_dir(spark, "honeypot")
    A.honeypot(spark, d).drop("doc_id").write.json(path)
    return hits_by_method(readers.read_honeypot_json(spark, path, multiline=False))


@query("s04_read_honeypot_array", _HITS)
def _(spark, d):
    path = fresh_dir(spark, "honeypot")
    h = A.honeypot(spark, d)
    element = F.concat(F.lit("  "), F.replace(F.to_json(F.struct(*[c for c in h.columns if c != "doc_id"]), {"pretty": "true"}), F.lit("\n"), F.lit("\n  ")))
    # Each log file is an array of the hits of 2,000 document numbers.
    logs = h.select(F.floor(F.col("doc_id") / 2000).alias("log"), element.alias("e")).groupBy("log").agg(F.array_join(F.collect_list("e"), ",\n").alias("es"))
    logs.select("log", F.concat(F.lit("[\n"), "es", F.lit("\n]")).alias("value")).write.partitionBy("log").text(path)
    return hits_by_method(readers.read_honeypot_array(spark, path))


@query("s06_event_rows", """SELECT request_id, ip, method, path, final_score, action, block_reason, latency_ms, best_label, regex_conf
FROM attack_events WHERE event_id % 41 <> 3""")
def _(spark, d):
    e = A.attack_events(spark, d)
    doc = e.select("event_id", F.to_json(F.struct("request_id", "ip", "method", "path", "timestamp", "final_score", "action", "block_reason", "short_circuited", "network_score", "latency_ms", "best_label",
                                                  F.struct("regex_conf", "app_lgbm_score", "net_lgbm_score", "deep_anomaly").alias("scores"), "layer_scores")).alias("value"))
    queue = doc.select(F.when(F.col("event_id") % 41 == 3, F.concat(F.lit("{broken"), "value")).otherwise(F.col("value")).alias("value"))
    rows = sinks.to_event_rows(sinks.parse_events(queue))
    return rows.select("request_id", "ip", "method", "path", "final_score", "action", "block_reason", "latency_ms", "best_label", "regex_conf")


@query("s07_append_dedup", "SELECT request_id, action, \"timestamp\" FROM attack_events")
def _(spark, d):
    table = fresh_dir(spark, "event-table")
    e = A.attack_events(spark, d).select("request_id", "action", "timestamp")
    sinks.append_dedup(e.where("action <> 'BLOCK'"), table)
    sinks.append_dedup(e.unionByName(e), table)
    return spark.read.parquet(table)


@query("s09_event_sink", "SELECT action, count(*) AS n FROM attack_events GROUP BY 1")
def _(spark, d):
    table = fresh_dir(spark, "event-table")
    e = A.attack_events(spark, d).select("request_id", "action", "timestamp")
    J.event_sink(stream_of(e.unionByName(e), "queue", 4), table, fresh_dir(spark, "event-progress"), available_now=True).awaitTermination()
    return spark.read.parquet(table).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("s08_upsert_latest", """SELECT ip, block_reason AS reason, ts_us AS blocked_us, ts_us + 3600000000 AS expires_us, CAST(NULL AS BIGINT) AS unblocked_us FROM (
SELECT *, row_number() OVER (PARTITION BY ip ORDER BY ts_us DESC) AS r FROM attack_events WHERE action = 'BLOCK') WHERE r = 1""")
def _(spark, d):
    rows = FU.derive_blacklist(A.attack_events(spark, d)).select("ip", "reason", "blocked_us", "expires_us", "unblocked_us")
    half = F.lit(A.EPOCH_2024_US + 15 * 86_400 * 1_000_000)
    old = rows.where(F.col("blocked_us") < half).withColumn("unblocked_us", F.col("blocked_us") + 1)
    return sinks.upsert_latest(old, rows.where(F.col("blocked_us") >= half).unionByName(rows))


_FLAT = """SELECT doc_id, ip, method, path, '{"page":"' || q_page || '"}' AS q, CASE WHEN doc_id % 3 = 0 THEN 'True' ELSE 'False' END AS ti_found, CASE WHEN doc_id % 3 = 0 THEN 'reputation' ELSE '' END AS ti_source,
CASE WHEN doc_id % 3 = 0 THEN '{"count":' || (doc_id % 30) || '}' ELSE '' END AS ti_raw FROM request_rows"""


@query("s10_flatten_honeypot", f"SELECT ip, method, path, q AS query_params, '{{}}' AS form_data, ti_found, ti_source, ti_raw, count(*) AS n FROM ({_FLAT}) GROUP BY ALL")
def _(spark, d):
    hits = A.honeypot(spark, d).withColumn("query_params", F.map_filter("query_params", lambda k, _: k == "page")).withColumn("tags", F.array(F.lit("SQLi:0.5"), F.lit("XSS:0.25")))
    path = fresh_dir(spark, "export")
    sinks.write_csv(sinks.flatten_honeypot(hits), path)
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path).na.fill("")
    cols = ["ip", "method", "path", "query_params", "form_data", "ti_found", "ti_source", "ti_raw"]
    return back.where("tags = 'SQLi:0.5|XSS:0.25'").groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


@query("s11_write_partitions", f"""SELECT CASE WHEN l = 'BENIGN' THEN 'benign' WHEN l IN {sql_in(K.NOVEL_LABELS)} THEN 'novel' ELSE 'known' END AS route, count(*) AS n, 32 AS feature_count FROM (SELECT trim("Label") AS l FROM raw_flows)
WHERE l IN {sql_in(list(K.KNOWN_LABELS) + K.NOVEL_LABELS)} GROUP BY 1""")
def _(spark, d):
    from palisade.catalog.datasets import mapped
    path = fresh_dir(spark, "dataset")
    sinks.write_partitions(EN.route(mapped(spark, d)), path)
    manifest = spark.read.json(f"{path}/manifest").select(F.col("feature_count").cast("int").alias("feature_count"))
    return spark.read.parquet(f"{path}/data").groupBy("route").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(manifest))


@query("s12_write_report", "SELECT true_label, count(*) AS total FROM scored GROUP BY 1")
def _(spark, d):
    path = fresh_dir(spark, "report")
    sinks.write_report(E.detection_by_type(A.scored(spark, d), "true_label", "score", 0.5), path)
    return spark.read.schema("true_label string, total bigint").json(path)
