"""Golden detection cases."""

import re

import pytest
from pyspark.sql import functions as F

from palisade.functions import decode, labels, lexical, scores, text
from palisade.functions import patterns as P
from palisade.operators import enrich, fusion, projections, rules, temporal
from palisade.sources import sinks

REQ = "id int, ip string, method string, path string, body string, headers map<string,string>, query_params map<string,string>"
UA = {"User-Agent": "Mozilla/5.0"}
CASES = [
    ("GET", "/api/users", "", UA, {"page": "1"}, "ALLOW"),
    ("POST", "/api/login", '{"username":"admin","password":"secret123"}', {**UA, "Content-Type": "application/json"}, {}, "ALLOW"),
    ("POST", "/login", "username=admin'--&password=x", UA, {}, "BLOCK"),
    ("GET", "/search", "", UA, {"q": "' UNION SELECT NULL, username, password FROM users--"}, "BLOCK"),
    ("GET", "/product", "", UA, {"id": "1; SELECT SLEEP(5)--"}, "BLOCK"),
    ("GET", "/item", "", UA, {"id": "1%27%20OR%20%271%27%3D%271"}, "BLOCK"),
    ("POST", "/comment", "<script>alert('xss')</script>", UA, {}, "BLOCK"),
    ("POST", "/profile", "<img src=x onerror=alert(document.cookie)>", UA, {}, "BLOCK"),
    ("GET", "/redirect", "", UA, {"url": "javascript:alert(1)"}, "BLOCK"),
    ("GET", "/download", "", UA, {"file": "../../../etc/passwd"}, "BLOCK"),
    ("GET", "/file", "", UA, {"path": "%2e%2e%2f%2e%2e%2fetc%2fpasswd"}, "BLOCK"),
    ("POST", "/ping", "host=127.0.0.1; cat /etc/passwd", UA, {}, "BLOCK"),
    ("POST", "/exec", "cmd=ls | whoami", UA, {}, "BLOCK"),
    ("GET", "/", "", {"User-Agent": "sqlmap/1.7"}, {}, "BLOCK"),
    ("GET", "/", "", {"User-Agent": "Nikto/2.1.6"}, {}, "BLOCK"),
]


@pytest.fixture(scope="module")
def requests(spark):
    return spark.createDataFrame([(i, f"10.0.0.{i}", m, p, b, h, q) for i, (m, p, b, h, q, _) in enumerate(CASES)], REQ)


def test_request_cases(requests):
    out = rules.signature_filter(rules.static_decision(requests)).collect()
    for r in out:
        stopped = r["static_decision"] == "MITIGATE" or r["decision"] == "MITIGATE"
        assert ("BLOCK" if stopped else "ALLOW") == CASES[r["id"]][5], r


def test_guards_never_hide_a_match(spark):
    """The signature with its guard equals the bare pattern on every snippet, in any case."""
    from palisade.sources.adapters import SNIPPETS
    base = [t for _, t in SNIPPETS] + [b for _, _, b, *_ in CASES] + [v for *_, q, _ in CASES for v in q.values()]
    base += [r"..\..\..\x", r"a\X00", "C:\\WINDOWS\\x", "/PROC/self", "data : TEXT/HTML", "nc -e 10.0.0.1 4444", "python -c 1.2.3.4 8080", "$PATH", "> /etc/x", "`abc`", "a|sort", ";ping", "0xDEADbeef", "GROUP BY x HAVING", "..%2f", "%252E%252E%255C", "into outfile '", "EXEC sp_executesql"]
    df = spark.createDataFrame([(t,) for t in base] + [(t.upper(),) for t in base], "t string")
    tests = []
    for (_, _, p, _), g in zip(P.SIGNATURES, P.SIGNATURE_GUARDS, strict=True):
        bare = F.col("t").rlike(P.portable(p))
        tests.append(F.count(F.when(bare & ~text.has(F.lower("t"), *g), 1)))
    assert not any(df.agg(*tests).first())


def test_guards_in_batches_never_hide_a_match(spark):
    """Each signature and honeypot pattern that matches a text has its guard met there, in any case and for odd letters."""
    from palisade.sources.adapters import SNIPPETS
    odd = ["un\u0130on select x", "\u017felect 1 from t", "; who\u0430mi", "; \u212aill", "' or 1=1 --", "' and '1'='1", "; ALTER x", "\" exec", "group by a having", "having 1=1", "onload = 'alert", "eval (1",
           "document . cookie", "<svg a onx =", "<a href = data", "confirm (", "expression (", "&& nc -l", "perl 1.2.3.4 80", ">/tmp/", "| wc", "; dig", "' #", "'--", "\" or \"1\"=\"1", "and 5 = 5", "# x",
           "?u=http://a", "&target=https://b", "169.254.169.254", "php://x", "DATA://", "&inc=", "?file=", "password=", "/wp-login.php", "|| ID", "../../", "system32\\\\cmd.exe", "onx =", "alert  ("]
    base = [t for _, t in SNIPPETS] + [b for _, _, b, *_ in CASES] + odd
    df = spark.createDataFrame([(t,) for t in base] + [(t.upper(),) for t in base], "t string")
    book = rules.RuleBook()
    checks = [([r[2] for r in book.rules], book.guards()), ([P.portable(p) for ps in P.HONEYPOT_FAMILIES.values() for p in ps], [g for f in P.HONEYPOT_FAMILIES for g in P.HONEYPOT_GUARDS[f]])]
    for pats, guards in checks:
        assert len(pats) == len(guards)
        rows = df.select("t", F.array(*[F.col("t").rlike(P.jvm(p)) for p in pats]).alias("hit"), text.guards_met(F.array("t"), guards)[0].alias("met")).collect()
        assert not [(r["t"], pats[i]) for r in rows for i, hit in enumerate(r["hit"]) if hit and i not in r["met"]]
        assert sum(len(r["met"]) for r in rows) < len(rows) * len(pats) / 2
    assert df.select(text.guards_met(F.array(F.lit(None).cast("string"), "t"), [[], [["zz"]]]).alias("m")).first()["m"] == [[], [0]]


def test_honeypot_patterns_run_once(spark, small):
    from palisade.catalog import load

    times = lambda name: load()[0][name](spark, small)._jdf.queryExecution().optimizedPlan().toString().count(r"169\.254\.169")
    assert times("d10_honeypot_tags") == 1 and times("a10_honeypot_metrics") == 0


def test_literals_are_found_in_batches(spark):
    """Counts, presence and entropy equal plain Python for odd texts; the engine tests no literal by itself."""
    import math
    from collections import Counter

    odd = ["", None, "aaaa", "\u212aill \u0130nsert", "...." + "../" * 3, "\U0001f600\U0001f600x", "<p class=a><b>", "on1 =", "\\x41\\xzz", "Stra\u00dfe ; | ||"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string")
    got = {r["i"]: r for r in lexical.lexical_features(df, "t").select("i", "dotdot_count", "has_insert", "html_tag_count", "has_event_handler", "hex_encoding_count", "cmd_char_count", "entropy").collect()}
    for i, t in enumerate(odd):
        t = t or ""
        want = (t.count(".."), int("insert" in t.lower()), len(re.findall("<[^>]+>", t)), int(bool(re.search(r"on\w+\s*=", t.lower()))), len(re.findall(r"\\x[0-9a-fA-F]{2}", t)), sum(t.count(c) for c in lexical.COMMAND_TOKENS))
        assert tuple(got[i])[1:7] == want
        assert abs(got[i]["entropy"] - sum(-c / len(t) * math.log2(c / len(t)) for c in Counter(t).values())) < 1e-9
    assert lexical.lexical_features(df, "t")._jdf.queryExecution().optimizedPlan().toString().count("Contains(") <= 2


def test_user_rules(spark, requests):
    table = spark.createDataFrame([("a", r"secret\d+", "leak", "active", 2), ("b", "[broken", "x", "active", 3), ("c", r"(?P<n>page)", "x", "active", 4), ("d", "admin", "x", "rejected", 5)],
                                  "rule_id string, pattern string, attack_type string, status string, created_us long")
    hits = rules.signature_filter(requests, rules.RuleBook.from_table(table)).where("rule_id is not null").collect()
    assert [(h["id"], h["rule_id"], h["matched_text"], h["decision"]) for h in hits] == [(1, "a", "secret123", "MITIGATE")]


def test_validate_patterns(spark):
    cases = {r"union\s+select\s+\d+": True, ".*": False, "abc": False, "[unclosed": False, r"/api/|/health|GET|POST": False, "x*abcd*y*|": False, "e" * 501: False, r"\bwhoami\b": True, "(?s).*": False}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "pattern string")
    got = {r["pattern"]: r["is_safe"] for r in rules.validate_patterns(df).collect()}
    assert got == {**cases, None: False}


def test_admit_rules_cap(spark):
    new = spark.createDataFrame([(f"attack{i}x", "sqli", f"e{i}", "HIGH" if i % 2 else "LOW", 0.9, i) for i in range(10)], "pattern string, attack_type string, event_id string, severity string, confidence double, proposed_us long")
    old = spark.createDataFrame([("attack1x",), ("zzz",)], "pattern string")
    assert [r["pattern"] for r in rules.admit_rules(new, old, cap=4).orderBy("created_us").collect()] == ["attack3x", "attack5x"]


def test_fusion_table(spark):
    rows = [(0.0, 0.0, 0.0, 0.0, 0.0, "ALLOW"), (0.9, 0.95, 0.8, 0.0, 0.7125, "BLOCK"), (0.5, 0.6, 0.4, 0.0, 0.41, "THROTTLE"), (0.35, 0.35, 0.25, 0.0, 0.255, "DELAY"), (0.2, 0.3, 0.2, 0.9, 0.375, "THROTTLE")]
    df = spark.createDataFrame(rows, "regex_conf double, app_lgbm_score double, deep_anomaly double, net_lgbm_score double, want double, act string")
    for r in fusion.fuse(df).collect():
        assert abs(r["fused"] - r["want"]) < 1e-9 and r["fused_action"] == r["act"]


def test_action_edges(spark):
    df = spark.createDataFrame([(0.7,), (0.6999,), (0.5,), (0.35,), (0.25,), (0.2499,)], "s double").select(scores.action(F.col("s")).alias("a"))
    assert [r["a"] for r in df.collect()] == ["BLOCK", "CAPTCHA", "CAPTCHA", "THROTTLE", "DELAY", "ALLOW"]


def test_correlation_golden(spark):
    n, a = "network", "application"
    rows = [(1, "one", 0, n, "portscan", .4), (2, "one", 5, n, "ddos", .4), (3, "two", 0, n, "portscan", .5), (4, "two", 10, a, "sqli", .5), (5, "late", 0, n, "portscan", .5), (6, "late", 11, a, "sqli", .5),
            (7, "four", 0, n, "portscan", .9), (8, "four", 1, a, "sqli", .9), (9, "four", 2, a, "xss", .9), (10, "four", 3, a, "cmdi", .9), (11, "norm", 0, n, "clean", .5), (12, "norm", 1, a, "norm", .5)]
    df = spark.createDataFrame([(i, ip, t * 1_000_000, layer, k, s) for i, ip, t, layer, k, s in rows], "event_id long, ip string, t_us long, layer string, type string, score double")
    for cap in (None, 50):
        got = {r["event_id"]: (r["correlated"], r["multiplier"], r["amplified_score"]) for r in temporal.correlate(df, cap=cap).collect()}
        assert got[2] == (False, 1.0, 0.4) and got[4] == (True, 1.3, 0.65) and got[6] == (False, 1.0, 0.5)
        assert got[9] == (True, 1.5, 1.0) and got[10] == (True, 1.7, 1.0) and got[12] == (True, 1.0, 0.5)


def test_correlation_cap_forgets(spark):
    rows = [(0, "x", 0, "network", "portscan", .5)] + [(i, "x", i * 1000, "application", "sqli", .5) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "event_id long, ip string, t_us long, layer string, type string, score double")
    capped = {r["event_id"]: r for r in temporal.correlate(df, cap=50).collect()}
    assert capped[49]["correlated"] and not capped[50]["correlated"] and capped[59]["history_count"] == 50
    assert temporal.correlate(df).where("event_id = 59").first()["correlated"]


def test_decoding(spark):
    df = spark.createDataFrame([("a%zz%41+b", "&lt;b&gt; &amp;amp; &#x41;&notit;"), (None, None)], "s string, h string")
    r, null = df.select(decode.percent_decode(F.col("s")).alias("p"), decode.form_decode(F.col("s")).alias("f"), decode.html_unescape(F.col("h")).alias("h")).collect()
    assert (r["p"], r["f"], r["h"]) == ("a%zzA+b", "a%zzA b", "<b> &amp; A¬it;") and null["p"] is None and null["h"] is None


def test_lexical_golden(spark):
    texts = ["admin' UNION SELECT NULL, password FROM users--", "/api/users/profile?id=456", "' OR '1'='1' --", "SELECT * FROM products WHERE id=123", "; cat /etc/passwd", "../../../../etc/passwd", "", "Größe Ñ ٣"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    r = {x["i"]: x for x in lexical.lexical_features(df, "t").collect()}
    assert len(lexical.LEXICAL_FEATURES) == 64
    assert (r[0]["is_union_injection"], r[0]["has_select_null"], r[0]["is_normal_sql"]) == (1, 1, 0)
    assert (r[1]["is_rest_api_path"], r[1]["sql_keyword_count"]) == (1, 0)
    assert (r[2]["has_or_with_quote"], r[2]["has_always_true"]) == (1, 1)
    assert (r[3]["is_normal_sql"], r[3]["has_quote_and_sql"]) == (1, 0)
    assert (r[4]["is_cmd_injection"], r[4]["has_etc_passwd"]) == (1, 1)
    assert (r[5]["is_path_traversal_attack"], r[5]["dotdot_count"], r[5]["slash_count"]) == (1, 4, 5)
    assert r[6]["length"] == 0 and r[6]["entropy"] == 0 and r[6]["special_char_ratio"] == 0
    assert (r[7]["num_uppercase"], r[7]["num_lowercase"], r[7]["num_digits"], r[7]["num_special_chars"]) == (2, 4, 1, 0)
    e = spark.createDataFrame([("aab",)], "t string").select(text.entropy(F.col("t"))).first()[0]
    assert abs(e - 0.9182958340544896) < 1e-12


def test_salvage(spark):
    df = spark.createDataFrame([('{"k": 1}',), ('```json\n{"k": 2}\n```',), ('Sure: {"k": 3} bye',), ("garbage",), ("{broken",)], "t string")
    got = [r["s"]["k"] if r["s"] else None for r in df.select(text.salvage_json(F.col("t"), "k int").alias("s")).collect()]
    assert got == [1, 2, 3, None, None]


def test_labels(spark):
    df = spark.createDataFrame([("SQL Injection",), ("CmdInjection",), ("PathTraversal",), ("AuthBruteforce",), (None,), ("Other",)], "t string")
    assert [r[0] for r in df.select(labels.standardize_attack(F.col("t"))).collect()] == ["sqli", "cmdi", "path-traversal", None, "norm", "norm"]
    b = spark.createDataFrame([(" BENIGN ",), ("",), ("nan",), ("none",), ("DDoS",), ("0",)], "t string").select(labels.binary_label(F.col("t")))
    assert [r[0] for r in b.collect()] == [0, -1, -1, 0, 1, 0]


def test_technique_fallback(spark):
    df = spark.createDataFrame([("Zero-Day",), ("path-traversal",), ("nope",), (None,)], "l string")
    got = [(r["technique_id"], r["kill_chain_phase"]) for r in enrich.map_attack(df, "l").collect()]
    assert got == [("T1190", "Exploitation"), ("T1083", "Reconnaissance"), (None, None), (None, None)]


def test_payload_and_ip(spark):
    df = spark.createDataFrame([("b", "/x", {"k": "v"}, {"X-Forwarded-For": " 1.1.1.1, 2.2.2.2"}, "9.9.9.9"), ("", "/", {}, {"x-real-ip": "3.3.3.3"}, "9.9.9.9"), (None, "/p", None, None, "8.8.8.8")],
                               "body string, path string, query_params map<string,string>, headers map<string,string>, peer_ip string")
    got = df.select(projections.build_payload(), projections.build_payload("anomaly"), projections.resolve_ip(["9.9.9.9"])).collect()
    assert [tuple(r) for r in got] == [("b /x k=v", "b", "1.1.1.1"), ("", "/", "3.3.3.3"), ("/p", "/p", "8.8.8.8")]


def test_blacklist_edges(spark):
    ev = spark.createDataFrame([(1, "a", 0), (2, "a", 10), (3, "a", 19), (4, "a", 20), (5, "b", 999), (6, "c", 5)], "event_id long, ip string, t_us long")
    bl = spark.createDataFrame([(9, "a", 10, 20, None), (9, "b", 1, None, None), (9, "c", 1, None, 5)], "block_id long, ip string, blocked_us long, expires_us long, unblocked_us long")
    got = {r["event_id"]: r["is_blacklisted"] for r in temporal.blacklist_join(ev, bl).collect()}
    assert got == {1: False, 2: True, 3: True, 4: False, 5: True, 6: False}


def test_append_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0)], "request_id string, timestamp double")
    for _ in range(2):
        sinks.append_dedup(df, str(tmp_path / "t"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).collect())) == [("a", 1.0), ("b", 1.0)]


def test_event_defaults(spark):
    raw = spark.createDataFrame([("{}",), ("nonsense",), ('{"request_id":"' + "x" * 50 + '","latency_ms":null,"action":"BLOCK"}',)], "value string")
    rows = sinks.to_event_rows(sinks.parse_events(raw), now_us=1_000_000).orderBy("action").collect()
    assert [(r["action"], r["best_label"], r["ip"], r["timestamp"], len(r["request_id"])) for r in rows] == [("ALLOW", "clean", "0.0.0.0", 1.0, 0), ("BLOCK", "unknown", "0.0.0.0", 1.0, 50)]
    cut = sinks.to_event_rows(sinks.parse_events(raw), now_us=1_000_000, widths={"request_id": 36}).where("action = 'BLOCK'").first()
    assert len(cut["request_id"]) == 36


def test_patterns_mean_what_python_means(spark):
    """Every signature, and rules with ``$``, ``.``, case folding and named groups, over texts that tell engines apart."""
    import re

    from palisade.functions import patterns as P

    rules = [p for _, _, p, _ in P.SIGNATURES] + [f"(?is){p}" for p in ("words$", "(?P<quo_te>['\"]).*(?P=quo_te)", "a.b", "k1")] + ["a.b", "(?i)sk", "end$"]
    texts = ["harmless words\n", "harmless words\n\n", "' \u2028 select 1", "'\r select", "'\u0085 union", "'\n select", "<\u017fcript>", "<scr\u0131pt >", "javascr\u0130pt:", "a\nb", "a\rb", "a\u2028b",
             "\u212a1", "\u017f\u212a", "'x'", "id;\xa0cat", "union\u3000select\u2003x", "-- \n", "#\u2028", "1 or 1=1", "\u0661=\u0661", "end\n", "end\r", "having \u0661=1", "$(ls)", ""]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", *[F.col("t").rlike(P.jvm(P.portable(p))).alias(f"r{k}") for k, p in enumerate(rules)]).collect()
    for r in got:
        for k, p in enumerate(rules):
            assert r[f"r{k}"] == bool(re.search(p, texts[r["i"]])), (p, texts[r["i"]])


def test_signatures_see_folded_letters(spark):
    rows = [(1, "<\u017fcript>alert(1)"), (2, "javascr\u0130pt:x"), (3, "plain text")]
    df = spark.createDataFrame(rows, "id int, body string").select("id", "body", F.lit("/").alias("path"), F.expr("map('a', 'b')").alias("query_params"), F.expr("map('c', 'd')").alias("headers"))
    got = {r["id"]: r["decision"] for r in rules.signature_filter(df).collect()}
    assert got == {1: "MITIGATE", 2: "MITIGATE", 3: "ALLOW"}


@pytest.mark.parametrize("pattern, texts", [(r"abc\Z", ["abc", "abc\n", "abc\r", "xabc"]), (r"^\W$", ["é", "-", "a", "٣"]), (r"^\D$", ["٣", "3", "x"]), (r"x\Sy", ["x\u2028y", "x y", "xzy"]),
                                            (r"^[\W]$", ["é", "-"]), (r"^[^\W]$", ["é", "-"]), (r"[\s\S]{3}", ["a\nb", "ab"])])
def test_negated_shorthands_mean_what_they_mean_in_python(spark, pattern, texts):
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["hit"] for r in frame.select("t", F.col("t").rlike(P.jvm(P.portable("(?is)" + pattern))).alias("hit")).collect()}
    assert got == {t: bool(re.search(pattern, t, re.IGNORECASE | re.DOTALL)) for t in texts}


def test_rules_that_the_engine_lacks_are_rejected(spark):
    rows = [(r"(a)?(?(1)b|c)x",), (r"\N{DIGIT ONE}abc",), (r"(?a)\wabcdef",), (r"union\s+select",)]
    got = {r["pattern"]: r["is_safe"] for r in rules.validate_patterns(spark.createDataFrame(rows, "pattern string")).collect()}
    assert got == {rows[0][0]: False, rows[1][0]: False, rows[2][0]: False, rows[3][0]: True}
