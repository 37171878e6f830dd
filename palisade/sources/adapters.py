"""The given tables seen as domain tables: events, packets, flows, payloads, requests, scores.

Only integer arithmetic, digests and fixed lists are used, so a SQL twin of each adapter is easy to
write. All of them are narrow projections (``flow_table`` adds one pre-aggregated join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade import constants as K
from palisade.functions.scores import action
from palisade.operators.scale import spread

EPOCH_2024_US = 1_704_067_200_000_000
TIME_SQUEEZE = 3600

EVENT_LABELS = {"error": "sqli", "purchase": "xss", "signup": "portscan", "click": "clean", "view": "norm"}
METHODS = ["GET", "POST", "PUT", "DELETE", "PATCH"]

# Attack strings spliced into given texts: (class, text).
SNIPPETS = [
    ("norm", ""),
    ("sqli", "' UNION SELECT NULL, username, password FROM users--"),
    ("norm", "page=1&limit=20"),
    ("xss", "<script>alert('xss')</script>"),
    ("norm", ""),
    ("cmdi", "; cat /etc/passwd | whoami"),
    ("path-traversal", "../../../../etc/shadow"),
    ("norm", "a+b=c 100%25 sure"),
    ("sqli", "1%27%20OR%20%271%27%3D%271"),
    ("xss", "<img src=x onerror=alert(document.cookie)>"),
    ("sqli", "id=1 having 1=1"),
    ("cmdi", "ls && echo done"),
    ("path-traversal", "%2e%2e%2f%2e%2e%2fetc%2fpasswd"),
    ("norm", "SELECT * FROM products WHERE id=123"),
    ("xss", "&#x6a;avascript%3Aalert(1)"),
    ("sqli", "1; DROP/**/TABLE users"),
    ("norm", "/api/users/profile?id=456"),
    ("xss", 'onfoo="x" width=1'),
]
AGENTS = ["Mozilla/5.0", "curl/8.0", "Mozilla/5.0 (X11)", "sqlmap/1.7", "python-requests/2.31", "Safari/17", "Nikto/2.1.6", "Opera/9"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], index: Column) -> Column:
    """values[index mod n] as an expression."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def user_ip(user: Column) -> Column:
    return F.concat(F.lit("10.0."), F.floor(user / 256).cast("string"), F.lit("."), F.pmod(user, F.lit(256)).cast("string"))


def label_of(event_type: Column) -> Column:
    out = None
    for k, v in EVENT_LABELS.items():
        out = F.when(event_type == k, v) if out is None else out.when(event_type == k, v)
    return out.otherwise("unknown")


def base_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    return ev.select(
        "event_id", "user_id", "event_type", "value", "ts",
        F.unix_micros(ts).alias("ts_us"),
        F.floor((F.unix_micros(ts) - F.lit(EPOCH_2024_US)) / F.lit(TIME_SQUEEZE)).cast("bigint").alias("t_us"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        user_ip(F.col("user_id")).alias("ip"))


def attack_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One detection event per row of ``events``."""
    e = base_events(spark, sf_dir)
    score = F.least(F.lit(10000), F.floor(F.col("cents") / 2)) / F.lit(10000.0)
    e = (e.withColumn("final_score", score).withColumn("best_label", label_of(F.col("event_type")))
          .withColumn("action", action(F.col("final_score"))))
    k, lab = F.col("k"), F.col("best_label")
    layer = lambda name, s, label, conf, trig: F.struct(
        F.lit(name).alias("layer"), s.cast("double").alias("score"), label.alias("label"),
        conf.cast("double").alias("confidence"), trig.alias("triggered"))
    regex = F.pmod(F.col("cents"), F.lit(10000)) / F.lit(10000.0)
    layers = F.array(
        layer(K.LAYER_STATIC, F.when(k >= 90, 1.0).otherwise(0.0),
              F.when(k >= 90, "pattern_match").when(k < 20, "suspicious").otherwise("clean"), F.lit(1.0), k >= 90),
        layer(K.LAYER_REGEX, regex, F.when(k % 2 == 0, lab).otherwise("clean"), regex, k % 10 == 3),
        layer(K.LAYER_ANOMALY, k / 100.0, F.when(k > 50, "anomaly").otherwise("clean"), F.lit(0.5), F.lit(False)),
        layer(K.LAYER_CLASSIFIER, F.col("final_score"), lab, F.col("final_score"), F.lit(False)))
    return e.select(
        F.md5(F.col("event_id").cast("string")).alias("request_id"), "event_id", "ip",
        pick(METHODS, F.col("event_id")).alias("method"),
        F.concat(F.lit("/"), "event_type", F.lit("/"), F.col("user_id").cast("string")).alias("path"),
        (F.col("ts_us") / F.lit(1e6)).alias("timestamp"), F.col("ts").alias("event_time"), "ts_us", "t_us",
        "final_score", "action",
        F.when(F.col("action") == "BLOCK", F.concat(F.lit("Detected "), lab)).otherwise("").alias("block_reason"),
        (k >= 90).alias("short_circuited"), (k / 100.0).alias("network_score"),
        F.when(F.col("event_id") % 97 != 0, F.col("value")).alias("latency_ms"), "best_label",
        regex.alias("regex_conf"), F.col("final_score").alias("app_lgbm_score"),
        (k / 100.0).alias("net_lgbm_score"), (k / 100.0).alias("deep_anomaly"),
        layers.alias("layer_scores"), "k", "cents")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as packets between a remote address and one local host; 720 s in all."""
    e = base_events(spark, sf_dir)
    k = F.col("k")
    return e.select(
        F.col("event_id").alias("packet_id"), F.col("ip").alias("remote_ip"), "t_us",
        F.floor(F.col("cents") / 10).cast("bigint").alias("length"),
        F.when(k < 3, 17).when(k < 10, 2).when(k < 40, 24).otherwise(16).alias("flags"),
        F.when(F.col("event_id") % 3 == 0, "bwd").otherwise("fwd").alias("direction"))


def raw_packets(spark: SparkSession, sf_dir: str, local_ip: str = "192.168.0.10") -> DataFrame:
    """Captured packets with source and destination; some carry no IP header."""
    p = packets(spark, sf_dir)
    back = F.col("direction") == "bwd"
    some = F.col("packet_id") % 50 != 7
    return p.select(
        "packet_id", "t_us", "length", "flags",
        F.when(some, F.when(back, F.lit(local_ip)).otherwise(F.col("remote_ip"))).alias("src_ip"),
        F.when(some, F.when(back, F.col("remote_ip")).otherwise(F.lit(local_ip))).alias("dst_ip"))


def correlation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer, type and score per address on the squeezed clock."""
    e = attack_events(spark, sf_dir)
    return e.select("event_id", "ip", "t_us",
                    F.when(F.col("best_label") == "portscan", "network").otherwise("application").alias("layer"),
                    F.col("best_label").alias("type"),
                    (F.least(F.lit(1000), F.floor(F.col("cents") / 20)) / F.lit(1000.0)).alias("score"))


def network_threats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the network layer: the scan events, half of the address space."""
    e = attack_events(spark, sf_dir).where(F.col("best_label") == "portscan")
    return e.select(F.col("event_id").alias("threat_id"), "ip", "t_us", F.col("network_score").alias("score"),
                    F.col("best_label").alias("attack_type"))


def blacklist(spark: SparkSession, sf_dir: str, ttl_seconds: int = 20) -> DataFrame:
    """Block intervals on the squeezed clock; every 50th is permanent, every 7th is lifted half way."""
    e = attack_events(spark, sf_dir).where(F.col("action") == "BLOCK")
    half = F.lit(ttl_seconds * 500_000)
    return e.select(
        F.col("event_id").alias("block_id"), "ip", F.col("t_us").alias("blocked_us"),
        F.when(F.col("event_id") % 50 != 0, F.col("t_us") + ttl_seconds * 1_000_000).alias("expires_us"),
        F.when(F.col("event_id") % 7 == 0, F.col("t_us") + half).alias("unblocked_us"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of documents, conversations and pages with attack strings spliced in."""
    d = spread(table(spark, sf_dir, "documents")).select(
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("payload_id"), F.lit("documents").alias("source"),
        F.col("text").alias("text"), F.col("doc_id").alias("n"))
    c = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv-"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("payload_id"),
        F.lit("conversations").alias("source"), F.col("text"), (F.col("conv_id") * 7 + F.col("turn")).alias("n"))
    g = spread(table(spark, sf_dir, "pages")).select(
        F.concat(F.lit("page-"), F.col("page_id")).alias("payload_id"), F.lit("pages").alias("source"),
        F.col("html").alias("text"), F.col("page_id").alias("n"))
    u = d.unionByName(c).unionByName(g)
    return u.select("payload_id", "source",
                    F.concat(F.col("text"), F.lit(" "), pick([t for _, t in SNIPPETS], F.col("n"))).alias("payload"),
                    pick([c for c, _ in SNIPPETS], F.col("n")).alias("attack_type"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One HTTP request per document: whole text as body, attack strings in body, path or query."""
    d = spread(table(spark, sf_dir, "documents"))
    n = F.col("doc_id")
    texts = [t for _, t in SNIPPETS]
    body = F.concat(F.col("text"), F.lit(" "), pick(texts, n))
    return d.select(
        F.md5(F.concat(F.lit("r"), n.cast("string"))).alias("request_id"), n.alias("doc_id"),
        user_ip(F.pmod(n, F.lit(150))).alias("ip"),
        F.pmod(n * 700_001, F.lit(720_000_000)).alias("t_us"),
        pick(["GET", "POST", "PUT", "GET", "POST"], n).alias("method"),
        F.when(n % 29 == 5, F.lit("/files/../../etc/hosts")).when(n % 31 == 6, F.lit("/health"))
         .otherwise(F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("lang"))).alias("path"),
        F.create_map(F.lit("user-agent"), pick(AGENTS, F.floor(n / 3)),
                     F.lit("x-forwarded-for"), F.concat(F.lit(" 172.16.0."), (n % 200).cast("string"), F.lit(", 10.9.9.9")),
                     F.lit("accept"), F.lit("*/*")).alias("headers"),
        F.create_map(F.lit("page"), (n % 10).cast("string"),
                     F.lit("q"), pick(texts, F.floor(n / 18))).alias("query_params"),
        body.alias("body"),
        F.when(n % 2 == 0, "10.9.9.9").otherwise("203.0.113.7").alias("peer_ip"))


def flow_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as flows: line items play the packets; line items are reduced before the join."""
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    fwd = F.col("l_linenumber") % 2 == 1
    day = F.unix_micros(F.col("l_shipdate").cast("timestamp")) / F.lit(86_400_000_000)
    per_order = li.groupBy("l_orderkey").agg(
        F.greatest(F.max(day) - F.min(day), F.lit(1.0)).alias("secs"),
        F.count(F.when(fwd, 1)).cast("double").alias("total fwd packets"),
        F.count(F.when(~fwd, 1)).cast("double").alias("total backward packets"),
        F.coalesce(F.sum(F.when(fwd, q)), F.lit(0.0)).alias("total length of fwd packets"),
        F.coalesce(F.sum(F.when(~fwd, q)), F.lit(0.0)).alias("total length of bwd packets"),
        F.coalesce(F.avg(F.when(fwd, q)), F.lit(0.0)).alias("fwd packet length mean"),
        F.coalesce(F.avg(F.when(~fwd, q)), F.lit(0.0)).alias("bwd packet length mean"),
        F.sum(q).alias("bytes"), F.count(F.lit(1)).alias("pkts"),
        F.count(F.when(F.col("l_returnflag") == "A", 1)).cast("double").alias("syn flag count"),
        F.count(F.when(F.col("l_returnflag") == "N", 1)).cast("double").alias("ack flag count"),
        F.count(F.when(F.col("l_returnflag") == "R", 1)).cast("double").alias("psh flag count"),
        F.avg(q).alias("packet length mean"), F.stddev_pop(q).alias("packet length std"),
        F.avg(F.col("l_discount") * 1_000_000).alias("idle mean"),
        F.stddev_pop(F.col("l_discount") * 1_000_000).alias("idle std"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    j = o.join(per_order, o.o_orderkey == per_order.l_orderkey)
    label = (F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("pkts") >= 4), "ddos")
              .when((F.col("o_orderpriority") == "2-HIGH") & (F.col("pkts") <= 2), "portscan")
              .when((F.col("o_orderpriority") == "3-MEDIUM") & (F.col("bytes") >= 120), "botnet").otherwise("benign"))
    return j.select(
        F.col("o_orderkey").alias("flow_id"), F.col("o_custkey").alias("src_id"), F.col("o_orderdate").alias("day"),
        label.alias("label"),
        *[{"flow duration": F.col("secs") * 1_000_000.0, "flow bytes/s": F.col("bytes") / F.col("secs"),
           "flow packets/s": F.col("pkts") / F.col("secs")}.get(c, F.col(f"`{c}`")).alias(c) for c in K.FLOW_FEATURES])


CLASS_NAMES = ["benign", "ddos", "portscan", "botnet"]


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions to evaluate: binary truth and score, class truth and prediction, four model scores."""
    e = base_events(spark, sf_dir)
    t, k, c, i = F.col("event_type"), F.col("k"), F.col("cents"), F.col("event_id")
    y = F.when(t.isin("error", "purchase"), 1).otherwise(0)
    truth = (F.when(t == "error", "ddos").when(t == "purchase", "portscan").when(t == "signup", "botnet").otherwise("benign"))
    pred = F.when(k < 80, truth).otherwise(pick(CLASS_NAMES, i))
    model = lambda gain, mod: (y * gain + F.pmod(i * 7919 + c * 31, F.lit(mod))) / F.lit(float(10000))
    return e.select(
        i.alias("row_id"), y.alias("y_true"), truth.alias("true_label"), pred.alias("pred_label"),
        ((y * 3000 + k * 50 + F.pmod(c, F.lit(2000))) / F.lit(10000.0)).alias("score"),
        model(2500, 7001).alias("ae"), model(1500, 8009).alias("vae"), model(3500, 6007).alias("occ"),
        model(1000, 9001).alias("iso"))


RAW_LABELS = ["BENIGN", "DDoS", "BENIGN", "DoS Hulk", "PortScan", "BENIGN", "Bot", "Web Attack – XSS", "BENIGN",
              "Heartbleed", "DoS slowloris", "SQL Injection", "Infilteration", "BENIGN", "FTP-BruteForce", "Odd"]


def captured_columns() -> list[str]:
    return [s for s in K.UNIFIED_FEATURES.values() if s]


def raw_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as captured flows: spaced headers, infinities, NaN and negatives left in."""
    o = spread(table(spark, sf_dir, "orders"))
    n, c = F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100).cast("bigint")
    cols = []
    for i, name in enumerate(captured_columns()):
        v = F.pmod(F.floor(c / (i + 1)) + F.col("o_custkey") * (i + 3), F.lit(1000 + 37 * i)) / F.lit(10.0)
        if name == "Flow Bytes/s":
            v = F.when(n % 11 == 0, F.lit(float("inf"))).when(n % 13 == 1, F.lit(float("nan"))).otherwise(v)
        if name == "Init_Win_bytes_forward":
            v = F.when(n % 5 == 0, -1.0).otherwise(v)
        cols.append(v.alias(name))
    return o.select(n.alias("row_id"), *cols, F.concat(F.lit(" "), pick(RAW_LABELS, n)).alias("Label"))


def honeypot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as honeypot hits, with a reputation verdict for every third."""
    r = requests(spark, sf_dir)
    found = F.col("doc_id") % 3 == 0
    return r.select(
        F.concat(F.lit("2024-01-01T00:00:"), F.lpad((F.col("doc_id") % 60).cast("string"), 2, "0"), F.lit("Z")).alias("timestamp"),
        "ip", "method", "path", "query_params", F.create_map().cast("map<string,string>").alias("form_data"), "headers",
        F.col("body").alias("raw_body"),
        F.when(found, F.struct(F.lit("reputation").alias("ti_source"), F.lit(True).alias("ti_found"),
                               F.concat(F.lit('{"count":'), (F.col("doc_id") % 30).cast("string"), F.lit("}")).alias("ti_raw"))).alias("threat_intel"),
        "doc_id")


def intel_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(user_ip(F.col("s_suppkey")).alias("ip"), (F.col("s_suppkey") * 7 % 30).alias("count"),
                    F.lit("2024-01-01").alias("first_seen"), F.lit("2024-01-30").alias("last_seen"))


def intel_abuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where(F.col("c_custkey") % 3 != 0)
    return c.select(user_ip(F.col("c_custkey")).alias("ip"), (F.col("c_custkey") * 13 % 101).alias("abuse_confidence_score"),
                    (F.col("c_custkey") % 17).alias("total_reports"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("country_code"))


OWNERS = ["Tor Project", "NordVPN S.A.", "Acme Hosting", "Amazon AWS", "City Proxy Ltd", "Plain Telecom"]


def intel_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(user_ip(F.col("c_custkey")).alias("ip"), pick(OWNERS, F.col("c_custkey")).alias("org"),
                    pick(["Net One", "proxy net", "Mullvad"], F.col("c_custkey")).alias("isp"))


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = attack_events(spark, sf_dir).where((F.col("final_score") >= K.ANALYSIS_FLOOR) & ~F.col("short_circuited"))
    return e.select(F.col("request_id").alias("event_id"), F.when(F.col("k") % 3 == 0, "pending").otherwise("complete").alias("status"),
                    pick(["CRITICAL", "HIGH", "MEDIUM"], F.col("event_id")).alias("severity"), "ts_us", "best_label", "final_score")


PROPOSALS = [r"union\s+select\s+\d+", r".*", r"(?i)xp_\w+", r"a", r"[unclosed", r"/api/|/health|GET|POST", r"\bwhoami\b", r"e", r"<svg/onload"]


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule patterns suggested by analyses."""
    a = analyses(spark, sf_dir)
    n = F.pmod(F.floor(F.col("ts_us") / 1000), F.lit(1000))
    return a.select(F.concat(pick(PROPOSALS, n), F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("x"), (n % 40).cast("string")))).alias("pattern"),
                    F.col("best_label").alias("attack_type"), "event_id", "severity", F.col("final_score").alias("confidence"), F.col("ts_us").alias("proposed_us"))


def rule_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User rules already stored: one per part brand."""
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("n"))
    return p.select(F.substring(F.md5("p_brand"), 1, 8).alias("rule_id"), F.concat(F.lit(r"<svg/onloadx"), (F.col("n") % 40).cast("string")).alias("pattern"),
                    F.lit("xss").alias("attack_type"), F.when(F.col("n") % 4 == 0, "rejected").otherwise("active").alias("status"),
                    (F.lit(EPOCH_2024_US) + F.col("n")).alias("created_us"))
