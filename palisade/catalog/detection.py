"""Decoding, lexical features, rules, fusion and gating."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade import constants as K
from palisade.catalog.registry import query
from palisade.catalog.twins import lit, sql_action, sql_case, sql_in
from palisade.functions import decode as DC
from palisade.functions import labels as L
from palisade.functions import lexical as LX
from palisade.functions import patterns as P
from palisade.functions import scores as S
from palisade.functions import text as TX
from palisade.operators import dashboards as D
from palisade.operators import enrich as EN
from palisade.operators import fusion as FU
from palisade.operators import projections as PR
from palisade.operators import rules as R
from palisade.sources import adapters as A


def rx(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {lit(P.portable(pattern))})"


def rx_any(col: str, pats: list[str]) -> str:
    return "(" + " OR ".join(rx(col, p) for p in pats) + ")"


def contains_any(col: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, {lit(p)})" for p in parts) + ")"


def count_of(col: str, part: str) -> str:
    return f"CAST((length({col}) - length(replace({col}, {lit(part)}, ''))) / {len(part)} AS INTEGER)"


def class_count(col: str, chars: str) -> str:
    return f"CAST(length({col}) - length(regexp_replace({col}, '[{chars}]', '', 'g')) AS INTEGER)"


def present(col: str, parts: list[str]) -> str:
    return "CAST(" + " + ".join(f"CAST(contains({col}, {lit(p)}) AS INTEGER)" for p in parts) + " AS INTEGER)"


def flag(test: str) -> str:
    return f"CAST(({test}) AS INTEGER)"


# -- decoding ----------------------------------------------------------------------------------------

@query("f01_percent_decode", "SELECT payload_id, md5(url_decode(payload)) AS once, md5(url_decode(url_decode(payload))) AS twice FROM payloads")
def _(spark, d):
    p = F.col("payload")
    return A.payloads(spark, d).select("payload_id", F.md5(DC.percent_decode(p)).alias("once"), F.md5(DC.percent_decode(p, 2)).alias("twice"))


@query("f02_form_decode", "SELECT payload_id, md5(url_decode(replace(payload, '+', ' '))) AS decoded FROM payloads")
def _(spark, d):
    return A.payloads(spark, d).select("payload_id", F.md5(DC.form_decode(F.col("payload"))).alias("decoded"))


@query("f04_squash_and_strip", r"""SELECT payload_id, md5(regexp_replace(payload, '[\t\n\r\x0b\f]+', ' ', 'g')) AS squashed, md5(regexp_replace(payload, '(?s)/\*.*?\*/', '', 'g')) AS stripped FROM payloads""")
def _(spark, d):
    p = F.col("payload")
    return A.payloads(spark, d).select("payload_id", F.md5(DC.squash_ws(p)).alias("squashed"), F.md5(DC.strip_comments(p)).alias("stripped"))


def sql_variants(v: str, unescape: str = "replace({0}, '&#x6a;', 'j')") -> str:
    forms = [v, f"url_decode({v})", f"url_decode(url_decode({v}))", f"url_decode(replace({v}, '+', ' '))",
             unescape.format(v), unescape.format(f"url_decode({v})"),
             rf"regexp_replace({v}, '[\t\n\r\x0b\f]+', ' ', 'g')", rf"regexp_replace({v}, '(?s)/\*.*?\*/', '', 'g')"]
    return "[" + ", ".join(f"{f}, lower({f})" for f in forms) + "]"


@query("f05_decode_variants", f"""SELECT doc_id, len(list_distinct(vs)) AS n_variants, md5(array_to_string(list_sort(list_distinct(list_transform(vs, lambda x: md5(x)))), ',')) AS digest
FROM (SELECT doc_id, {sql_variants('body')} AS vs FROM request_rows)""")
def _(spark, d):
    b = F.col("body")
    df = A.requests(spark, d).select("doc_id", "body", DC.html_unescape(b).alias("u"), DC.html_unescape(DC.percent_decode(b)).alias("ud"))
    v = DC.decode_variants(b, F.col("u"), F.col("ud"))
    return df.select("doc_id", F.size(v).cast("bigint").alias("n_variants"), F.md5(F.array_join(F.array_sort(F.transform(v, F.md5)), ",")).alias("digest"))


# -- lexical features ----------------------------------------------------------------------------------

def lexical_sql(key: str = "payload_id", texts: str = "(SELECT payload_id, payload AS p, lower(payload) AS l FROM payloads)") -> str:
    p, low = "p", "l"
    quote = contains_any(p, ["'", '"'])
    sqlk, cmdk = present(low, LX.SQL_WORDS), present(low, LX.COMMAND_WORDS)
    dots = count_of(p, "..")
    slashes = f"({count_of(p, '/')} + {count_of(p, chr(92))})"
    etc, win = contains_any(low, ["/etc/passwd", "/etc/shadow"]), contains_any(low, ["c:\\", "windows\\"])
    special = f"(CAST(length(p) AS INTEGER) - {class_count(p, TX.ALNUM + TX.BLANK)})"
    tags = f"CAST(len(regexp_extract_all(p, {lit(LX.TAG)})) AS INTEGER)"
    ratio = lambda e: f"round(CASE WHEN length(p) > 0 THEN {e} / length(p) ELSE 0 END, 6)"
    f = {
        "length": "CAST(length(p) AS INTEGER)", "decoded_length": "CAST(length(url_decode(p)) AS INTEGER)", "num_special_chars": special,
        "num_digits": class_count(p, TX.DIGITS), "num_uppercase": class_count(p, TX.UPPER), "num_lowercase": class_count(p, TX.LOWER),
        "num_spaces": count_of(p, " "), "special_char_ratio": ratio(special), "digit_ratio": ratio(class_count(p, TX.DIGITS)),
        "upper_ratio": ratio(class_count(p, TX.UPPER)), "lower_ratio": ratio(class_count(p, TX.LOWER)),
        "entropy": "round(coalesce(list_entropy(string_split(p, '')), 0), 6)", "sql_keyword_count": sqlk,
        "has_sql_comment": flag(contains_any(p, ["--", "/*", "#"])), "has_union": flag(contains_any(low, ["union"])),
        "has_select": flag(contains_any(low, ["select"])), "has_insert": flag(contains_any(low, ["insert"])),
        "has_delete": flag(contains_any(low, ["delete"])), "has_drop": flag(contains_any(low, ["drop"])),
        "is_union_injection": flag(f"contains(l, 'union') AND contains(l, 'select') AND {contains_any(p, [chr(39), chr(34), '--'])}"),
        "has_quote_and_sql": flag(f"{quote} AND {sqlk} >= 1"), "has_quote_comment": flag(contains_any(p, LX.QUOTED_COMMENTS)),
        "has_select_null": flag("contains(l, 'select') AND contains(l, 'null')"), "has_multiple_sql_keywords": flag(f"{sqlk} >= 3"),
        "has_always_true": flag(contains_any(low, LX.TAUTOLOGIES) + " OR contains(p, '''=''''')"),
        "has_or_with_quote": flag(contains_any(low, [" or ", "' or '", '" or "']) + f" AND {quote}"),
        "has_and_with_quote": flag(contains_any(low, [" and ", "' and '", '" and "']) + f" AND {quote}"),
        "has_sleep": flag(contains_any(low, LX.SLEEP_CALLS)), "sql_function_count": present(low, LX.SQL_FUNCTIONS),
        "has_stacked_query": flag("contains(p, ';') AND " + contains_any(low, ["select", "insert", "update", "delete", "drop"])),
        "is_normal_sql": flag(f"regexp_matches(p, {lit(LX.NORMAL_SQL)}) AND NOT {contains_any(p, ['--', '/*'])} AND {count_of(p, chr(39))} <= 2 AND NOT regexp_matches(l, {lit(LX.QUOTE_THEN_LOGIC)})"),
        "xss_pattern_count": present(low, LX.XSS_MARKS), "has_html_tags": flag(f"{tags} > 0"), "has_javascript": flag("contains(l, 'javascript:')"),
        "has_event_handler": flag(f"regexp_matches(l, {lit(LX.EVENT_HANDLER)})"), "has_script_tag": flag("contains(l, '<script')"), "html_tag_count": tags,
        "cmd_char_count": "CAST(" + " + ".join(count_of(p, t) for t in LX.COMMAND_TOKENS) + " AS INTEGER)",
        "has_pipe": flag("contains(p, '|')"), "has_semicolon": flag("contains(p, ';')"), "has_backtick": flag("contains(p, '`')"),
        "has_dollar": flag(contains_any(p, ["$(", "${"])), "cmd_keyword_count": cmdk,
        "is_cmd_injection": flag(contains_any(p, ["|", ";", "`"]) + f" AND {cmdk} > 0"), "has_dotdot": flag("contains(p, '..')"), "dotdot_count": dots,
        "has_etc_passwd": flag(etc), "has_windows_path": flag(win), "slash_count": slashes,
        "is_rest_api_path": flag(f"regexp_matches(p, {lit(LX.REST_PATH)}) AND {dots} = 0 AND NOT {etc} AND NOT {contains_any(p, ['<', chr(39)])} AND {sqlk} = 0"),
        "is_path_traversal_attack": flag(f"{dots} >= 2 OR {etc} OR {win} OR ({dots} >= 1 AND {slashes} >= 3)"),
        "has_url_encoding": flag("contains(p, '%')"), "has_html_encoding": flag("contains(p, '&') AND contains(p, ';')"), "encoding_count": count_of(p, "%"),
        "hex_encoding_count": f"CAST(len(regexp_extract_all(p, {lit(LX.HEX_ESCAPE)})) AS INTEGER)", "unicode_encoding": flag("contains(p, '\\u')"),
        "has_quotes": flag(quote), "quote_count": f"({count_of(p, chr(39))} + {count_of(p, chr(34))})", "has_parentheses": flag("contains(p, '(') AND contains(p, ')')"),
        "parentheses_count": f"({count_of(p, '(')} + {count_of(p, ')')})", "has_brackets": flag(contains_any(p, ["[", "{"])),
        "has_equals": flag("contains(p, '=')"), "equals_count": count_of(p, "="), "has_null_byte": flag(contains_any(p, ["%00", "\\x00"])),
    }
    cols = ", ".join(f'{f[n]} AS "{n}"' for n in LX.LEXICAL_FEATURES)
    return f"SELECT {key}, {cols} FROM {texts}"


RATIOS = ["special_char_ratio", "digit_ratio", "upper_ratio", "lower_ratio", "entropy"]


@query("f06_lexical_features", lexical_sql())
def _(spark, d):
    df = LX.lexical_features(A.payloads(spark, d).select("payload_id", "payload"), "payload")
    return df.select("payload_id", *[F.round(c, 6).alias(c) if c in RATIOS else F.col(c) for c in LX.LEXICAL_FEATURES])


@query("f07_entropy", """SELECT payload_id, round(list_entropy(string_split(payload, '')), 6) AS bits, round(list_entropy(string_split(payload, '')) * ln(2), 6) AS nats FROM payloads""")
def _(spark, d):
    p = F.col("payload")
    return A.payloads(spark, d).select("payload_id", F.round(TX.entropy(p), 6).alias("bits"), F.round(TX.entropy(p, 2.718281828459045), 6).alias("nats"))


def compact_sql(key: str = "payload_id", texts: str = "(SELECT payload_id, payload AS p FROM payloads)", entropy: str = "list_entropy(string_split(p, '')) * ln(2)") -> str:
    return f"""SELECT {key}, CAST(length(p) AS INTEGER) AS payload_len, {class_count('p', TX.DIGITS)} AS digit_count, {class_count('p', r'\p{L}')} AS alpha_count,
CAST(length(p) AS INTEGER) - {class_count('p', TX.ALNUM)} AS special_char_count, {count_of('p', '/')} AS slash_count, {count_of('p', '.')} AS dot_count, {count_of('p', '%')} AS percent_count,
{count_of('p', '=')} AS equals_count, {count_of('p', '?')} AS question_count, {count_of('p', '&')} AS amp_count, {flag(rx('p', P.COMPACT_SQL))} AS has_sql_kw, {flag(rx('p', P.COMPACT_XSS))} AS has_xss_kw,
{flag(rx('p', P.COMPACT_PATH))} AS has_path_kw, {flag(rx('p', P.COMPACT_CMD))} AS has_cmd_kw, {entropy} AS entropy FROM {texts}"""


@query("f08_payload_features", compact_sql(entropy="round(list_entropy(string_split(p, '')) * ln(2), 6)"))
def _(spark, d):
    df = LX.payload_features(A.payloads(spark, d).select("payload_id", "payload"), "payload").drop("payload")
    return df.withColumn("entropy", F.round("entropy", 6))


@query("f09_special_ratio", f"SELECT payload_id, round((length(payload) - {class_count('payload', TX.ALNUM)}) / length(payload), 6) AS ratio FROM payloads")
def _(spark, d):
    return A.payloads(spark, d).select("payload_id", F.round(TX.special_ratio(F.col("payload")), 6).alias("ratio"))


# -- labels ----------------------------------------------------------------------------------------

_STD = """CASE WHEN t IS NULL THEN 'norm' WHEN contains(lower(trim(t)), 'sql') THEN 'sqli' WHEN contains(lower(trim(t)), 'xss') THEN 'xss' WHEN contains(lower(trim(t)), 'cmd') THEN 'cmdi'
WHEN contains(lower(trim(t)), 'path') OR contains(lower(trim(t)), 'traversal') THEN 'path-traversal' WHEN contains(lower(trim(t)), 'auth') OR contains(lower(trim(t)), 'bruteforce') THEN NULL ELSE 'norm' END"""


@query("f10_standardize_attack", f"""SELECT t AS raw_label, {_STD} AS label, count(*) AS n FROM (SELECT "Label" AS t FROM raw_flows UNION ALL SELECT attack_type FROM payloads) GROUP BY 1, 2""")
def _(spark, d):
    t = A.raw_flows(spark, d).select(F.col("Label").alias("raw_label")).unionByName(A.payloads(spark, d).select(F.col("attack_type").alias("raw_label")))
    return t.groupBy("raw_label").agg(F.count(F.lit(1)).alias("n")).withColumn("label", L.standardize_attack(F.col("raw_label")))


@query("f11_simplify_label", """SELECT "Label" AS raw_label, CASE WHEN s = 'benign' THEN 'benign' WHEN contains(s, 'dos') THEN 'ddos' WHEN contains(s, 'portscan') THEN 'portscan' END AS flows,
CASE WHEN s = 'benign' THEN 'benign' WHEN contains(s, 'dos') THEN 'ddos' WHEN contains(s, 'portscan') THEN 'portscan' WHEN s = 'bot' THEN 'bot' END AS ensemble, count(*) AS n
FROM (SELECT "Label", lower(trim("Label")) AS s FROM raw_flows) GROUP BY 1, 2, 3""")
def _(spark, d):
    t = A.raw_flows(spark, d).groupBy(F.col("Label").alias("raw_label")).agg(F.count(F.lit(1)).alias("n"))
    return t.select("raw_label", L.simplify_label(F.col("raw_label")).alias("flows"), L.simplify_label(F.col("raw_label"), "ensemble").alias("ensemble"), "n")


@query("f12_binary_label", f"""SELECT "Label" AS raw_label, CASE WHEN lower(trim("Label")) IN {sql_in(K.BENIGN_TOKENS)} THEN 0 WHEN lower(trim("Label")) IN {sql_in(K.BLANK_TOKENS)} THEN -1 ELSE 1 END AS y, count(*) AS n
FROM raw_flows GROUP BY 1, 2""")
def _(spark, d):
    t = A.raw_flows(spark, d).groupBy(F.col("Label").alias("raw_label")).agg(F.count(F.lit(1)).alias("n"))
    return t.select("raw_label", L.binary_label(F.col("raw_label")).alias("y"), "n")


@query("f13_map_multiclass", f"""SELECT trim("Label") AS raw_label, coalesce({sql_case('trim("Label")', K.SECOND_CORPUS_LABELS)}, 'other') AS label, count(*) AS n FROM raw_flows GROUP BY 1, 2""")
def _(spark, d):
    t = A.raw_flows(spark, d).groupBy(F.trim("Label").alias("raw_label")).agg(F.count(F.lit(1)).alias("n"))
    return t.select("raw_label", L.map_multiclass(F.col("raw_label")).alias("label"), "n")


@query("f14_tag_family", "SELECT split_part(best_label || ':' || final_score, ':', 1) AS family, count(*) AS n FROM attack_events GROUP BY 1")
def _(spark, d):
    tag = F.concat("best_label", F.lit(":"), F.col("final_score").cast("string"))
    return A.attack_events(spark, d).groupBy(L.tag_family(tag).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query("f15_repair_label", """SELECT lower(replace(trim(replace("Label", '–', chr(65533))), chr(65533), '-')) AS label, count(*) AS n FROM raw_flows GROUP BY 1""")
def _(spark, d):
    broken = F.replace("Label", F.lit("–"), F.lit("\ufffd"))
    return A.raw_flows(spark, d).groupBy(L.repair_label(broken).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("f16_json_field", "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, CAST(NULL AS BOOLEAN) AS missing FROM events")
def _(spark, d):
    return A.table(spark, d, "events").select("event_id", TX.json_field(F.col("props"), "$.k", "int").alias("k"), TX.json_field(F.col("props"), "$.x", "boolean").alias("missing"))


@query("f17_salvage_json", """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE k END AS k, CASE WHEN event_id % 4 = 3 THEN 'parse_error' ELSE 'ok' END AS status FROM base_events""")
def _(spark, d):
    e, p = A.table(spark, d, "events"), F.col("props")
    fence = F.concat(F.lit("```json\n"), p, F.lit("\n```"))
    prose = F.concat(F.lit("Here you go: "), p, F.lit(" - done"))
    raw = F.when(F.col("event_id") % 4 == 0, p).when(F.col("event_id") % 4 == 1, fence).when(F.col("event_id") % 4 == 2, prose).otherwise("{ broken")
    s = TX.salvage_json(F.col("raw"), "k int")
    return e.select("event_id", raw.alias("raw")).withColumn("s", s).select(
        "event_id", F.col("s.k").alias("k"), F.when(F.col("s").isNull(), "parse_error").otherwise("ok").alias("status"))


@query("f18_epoch_iso", """SELECT event_id, make_timestamp(ts_us) AS event_time, strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S') || CASE WHEN ts_us % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(ts_us % 1000000 AS VARCHAR), 6, '0') END || '+00:00' AS iso FROM attack_events""")
def _(spark, d):
    return A.attack_events(spark, d).select("event_id", TX.epoch_to_ts(F.col("timestamp")).cast("timestamp_ntz").alias("event_time"), TX.iso_utc(F.col("ts_us")).alias("iso"))


@query("f20_ordinal_encode", """SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority, dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS o_orderstatus FROM orders""")
def _(spark, d):
    return PR.ordinal_encode(A.table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), ["o_orderpriority", "o_orderstatus"])


@query("f21_clamp_round", """SELECT event_id, round(greatest(0.0, least(1.0, value / 100.0::DOUBLE)), 4) AS score FROM events""")
def _(spark, d):
    return A.table(spark, d, "events").select("event_id", S.round4(S.clamp(F.col("value") / 100.0)).alias("score"))


@query("f22_owner_tags", f"""SELECT ip, array_to_string(list_filter([CASE WHEN contains(o, 'tor') OR contains(i, 'tor') THEN 'Tor Exit Node' END, CASE WHEN {contains_any('o', K.VPN_WORDS)} OR {contains_any('i', K.VPN_WORDS)} THEN 'VPN Provider' END,
CASE WHEN contains(o, 'proxy') OR contains(i, 'proxy') THEN 'Proxy Service' END, CASE WHEN {contains_any('o', K.HOSTING_WORDS)} THEN 'Hosting / Cloud' END], lambda x: x IS NOT NULL), ',') AS tags
FROM (SELECT ip, lower(org) AS o, lower(isp) AS i FROM intel_geo)""")
def _(spark, d):
    return A.intel_geo(spark, d).select("ip", F.array_join(L.owner_tags(F.col("org"), F.col("isp")), ",").alias("tags"))


# -- request shaping ---------------------------------------------------------------------------------

@query("p12_build_payload", """SELECT doc_id, md5(concat_ws(' ', CASE WHEN body <> '' THEN body END, CASE WHEN path NOT IN ('', '/') THEN path END, 'page=' || q_page || ' q=' || q_q)) AS classifier,
md5(CASE WHEN body <> '' THEN body ELSE path || '?page=' || q_page || '&q=' || q_q END) AS anomaly FROM request_rows""")
def _(spark, d):
    return A.requests(spark, d).select("doc_id", F.md5(PR.build_payload()).alias("classifier"), F.md5(PR.build_payload("anomaly")).alias("anomaly"))


@query("p13_resolve_ip", "SELECT doc_id, CASE WHEN peer_ip = '10.9.9.9' THEN coalesce(nullif(trim(split_part(forwarded, ',', 1)), ''), peer_ip) ELSE peer_ip END AS client_ip FROM request_rows")
def _(spark, d):
    return A.requests(spark, d).select("doc_id", PR.resolve_ip(["10.9.9.9"]).alias("client_ip"))


@query("p14_skip_paths", "SELECT doc_id, path FROM request_rows WHERE NOT (" + " OR ".join(f"starts_with(path, '{p}')" for p in K.SKIP_PREFIXES) + ")")
def _(spark, d):
    return PR.skip_paths(A.requests(spark, d)).select("doc_id", "path")


_BENIGN = sql_in(K.BENIGN_EVENT_LABELS)


@query("p15_best_label", f"""SELECT e.event_id, coalesce(l.label, nullif(e.block_reason, ''), CASE WHEN e.action = 'ALLOW' THEN 'clean' ELSE 'unknown' END) AS label
FROM attack_events e LEFT JOIN (SELECT event_id, arg_min(label, pos) AS label FROM event_layers WHERE label NOT IN {_BENIGN} GROUP BY 1) l ON l.event_id = e.event_id""")
def _(spark, d):
    return A.attack_events(spark, d).select("event_id", PR.best_label().alias("label"))


@query("p16_last_label", f"""SELECT e.event_id, coalesce(l.label, 'unknown') AS label FROM attack_events e
LEFT JOIN (SELECT event_id, arg_max(label, pos) AS label FROM event_layers WHERE label NOT IN {sql_in([*K.NORMAL_LABELS, 'suspicious', ''])} GROUP BY 1) l ON l.event_id = e.event_id""")
def _(spark, d):
    return A.attack_events(spark, d).select("event_id", PR.last_label().alias("label"))


@query("p17_normalize_request", "SELECT doc_id, ip, method, path, 0 AS n_scores, md5(body) AS body FROM (SELECT *, 0 FROM request_rows)")
def _(spark, d):
    raw = A.requests(spark, d).select("doc_id", "ip", "method", "path", F.nullif("body", F.lit("")).alias("body"))
    out = PR.normalize_request(raw)
    return out.select("doc_id", "ip", "method", "path", (F.size("scores") + F.size("headers")).alias("n_scores"), F.md5("body").alias("body"))


_STATIC_SQL = f"""SELECT doc_id, user_agent, method, path, body, CASE WHEN {rx_any('lower(body)', P.STATIC_SQLI)} THEN 'SQL Injection' WHEN {rx_any('lower(body)', P.STATIC_XSS)} THEN 'XSS'
WHEN {rx_any('lower(path)', P.STATIC_PATH)} THEN 'Path Traversal' WHEN {contains_any('lower(user_agent)', P.STATIC_AGENTS)} THEN 'Malicious User-Agent' END AS static_rule FROM request_rows"""
_SUSPICION_SQL = f"""SELECT *, {flag("contains(body, '%')")} + {flag(f"length(body) > 0 AND (length(body) - {class_count('body', TX.ALNUM)}) / length(body) > 0.30")} + {flag(contains_any('lower(user_agent)', P.TOOL_AGENTS))}
+ {flag('length(body) > 200 OR length(path) > 150')} + {flag("contains(lower(body), '%2e%2e') OR contains(lower(body), '%2f')")} AS suspicion_score FROM ({_STATIC_SQL})"""


@query("p18_tag_mitigation", f"""SELECT doc_id, true AS mitigation_applied, CASE WHEN t = 'SQL Injection' THEN md5('[SANITIZED]') ELSE md5(body) END AS body, CASE WHEN t = 'SQL Injection' THEN 'HIGH' END AS log_level,
t = 'XSS' AS sanitize_output, false AS throttle, t NOT IN ('SQL Injection', 'XSS', 'Rate Limit Exceeded') AS monitor_only FROM (SELECT *, coalesce(static_rule, '') AS t FROM ({_STATIC_SQL}))""")
def _(spark, d):
    out = PR.tag_mitigation(R.static_rules(A.requests(spark, d)), "static_rule")
    return out.select("doc_id", "mitigation_applied", F.md5("body").alias("body"), "log_level", "sanitize_output", "throttle", "monitor_only")


@query("p19_display_label", "SELECT best_label, CASE WHEN best_label = 'clean' THEN 'zero-day' ELSE best_label END AS shown, count(*) AS n FROM attack_events GROUP BY 1, 2")
def _(spark, d):
    t = A.attack_events(spark, d).groupBy("best_label").agg(F.count(F.lit(1)).alias("n"))
    seen = F.when(F.col("best_label") == "clean", "unknown").otherwise(F.col("best_label"))
    return t.select("best_label", L.display_label(seen).alias("shown"), "n")


@query("p20_shape_event", """SELECT request_id, ip, "timestamp", latency_ms, regex_conf, app_lgbm_score, net_lgbm_score, deep_anomaly, final_score AS final_risk FROM attack_events""")
def _(spark, d):
    return PR.shape_event(A.attack_events(spark, d)).select("request_id", "ip", "timestamp", "latency_ms", "scores.*")


# -- rules -------------------------------------------------------------------------------------------

@query("d01_static_rules", f"SELECT doc_id, static_rule FROM ({_STATIC_SQL})")
def _(spark, d):
    return R.static_rules(A.requests(spark, d)).select("doc_id", "static_rule")


@query("d02_suspicion", f"""SELECT doc_id, suspicion_score, suspicion_score >= 2 AS forward_to_models, CASE WHEN suspicion_score >= 2 THEN round(least(0.4, suspicion_score * 0.1), 6) ELSE 0.0 END::DOUBLE AS suspicion_contribution FROM ({_SUSPICION_SQL})""")
def _(spark, d):
    return R.suspicion(A.requests(spark, d)).select("doc_id", "suspicion_score", "forward_to_models", F.round("suspicion_contribution", 6).alias("suspicion_contribution"))


@query("d03_method_gate", f"""SELECT doc_id, CASE WHEN static_rule IS NOT NULL THEN 'MITIGATE' WHEN suspicion_score >= 2 OR method NOT IN ('GET', 'POST') THEN 'FORWARD_TO_ML' ELSE 'ALLOW' END AS static_decision,
coalesce(static_rule, CASE WHEN suspicion_score >= 2 THEN 'Suspicious but unclear' WHEN method NOT IN ('GET', 'POST') THEN 'Uncommon HTTP Method' ELSE 'Normal Traffic' END) AS static_reason FROM ({_SUSPICION_SQL})""")
def _(spark, d):
    return R.static_decision(A.requests(spark, d)).select("doc_id", "static_decision", "static_reason")


def signature_sql(book: R.RuleBook) -> str:
    code = "CASE " + " ".join(f"WHEN regexp_matches(v, {lit(r[2])}) THEN {i}" for i, r in enumerate(book.rules)) + " END"
    of = lambda j: "CASE code " + " ".join(f"WHEN {i} THEN {r[j] if j == 1 else lit(r[j]) if r[j] is not None else 'NULL'}" for i, r in enumerate(book.rules)) + " END"
    match = "CASE code " + " ".join(f"WHEN {i} THEN regexp_extract(v, {lit(r[2])}, 0)" for i, r in enumerate(book.rules)) + " END"
    return f"""WITH targets AS (
  SELECT doc_id, 0 AS t, 'body' AS f, body AS val FROM request_rows UNION ALL SELECT doc_id, 1, 'path', path FROM request_rows
  UNION ALL SELECT doc_id, 2, 'query:page', q_page FROM request_rows UNION ALL SELECT doc_id, 3, 'query:q', q_q FROM request_rows
  UNION ALL SELECT doc_id, 4, 'header:user-agent', user_agent FROM request_rows UNION ALL SELECT doc_id, 5, 'header:x-forwarded-for', forwarded FROM request_rows),
variants AS (SELECT doc_id, t, f, min(i) AS i, v FROM (SELECT doc_id, t, f, unnest({sql_variants('val')}) AS v, generate_subscripts({sql_variants('val')}, 1) AS i FROM targets WHERE val <> '') GROUP BY doc_id, t, f, v),
judged AS (SELECT * FROM (SELECT *, {code} AS code FROM variants) WHERE code IS NOT NULL),
best AS (SELECT * FROM (SELECT *, {of(1)}::DOUBLE AS confidence, row_number() OVER (PARTITION BY doc_id ORDER BY {of(1)} DESC, t, i) AS r FROM judged) WHERE r = 1)
SELECT q.doc_id, {of(0)} AS pattern_group, {of(3)} AS pattern, confidence, {of(4)} AS rule_id, b.f AS matched_in, {match} AS matched_text, v AS decoded_input,
  CASE WHEN confidence >= 1 THEN 'MITIGATE' WHEN confidence IS NOT NULL THEN 'FORWARD_TO_ML' ELSE 'ALLOW' END AS decision,
  round(CASE WHEN confidence IS NULL THEN 0.0 WHEN confidence >= 1 THEN 1.0 WHEN confidence <= 0.6 THEN 0.2 ELSE 0.2 + (confidence - 0.6) * 2.0 END::DOUBLE, 3) AS score
FROM request_rows q LEFT JOIN best b ON b.doc_id = q.doc_id"""


_DETAIL = ["pattern_group", "pattern", "confidence", "rule_id", "matched_in", "matched_text", "decoded_input", "decision", "score"]


@query("d04_signature_filter", f"SELECT doc_id, pattern_group, confidence, decision, score FROM ({signature_sql(R.RuleBook())})")
def _(spark, d):
    return R.signature_filter(A.requests(spark, d)).select("doc_id", "pattern_group", "confidence", "decision", "score")


@query("d05_match_detail", f"SELECT doc_id, pattern, matched_in, matched_text, decoded_input FROM ({signature_sql(R.RuleBook())})")
def _(spark, d):
    return R.signature_filter(A.requests(spark, d)).select("doc_id", "pattern", "matched_in", "matched_text", "decoded_input")


USER_RULES = [("r1", r"products\s+where", "sqli"), ("r2", r"onen.hah", "anomaly"), ("r3", r"^src1\b", "odd")]


@query("d06_adaptive_rules", f"SELECT doc_id, {', '.join(_DETAIL)} FROM ({signature_sql(R.RuleBook(USER_RULES))}) WHERE rule_id IS NOT NULL")
def _(spark, d):
    return R.signature_filter(A.requests(spark, d), R.RuleBook(USER_RULES)).where(F.col("rule_id").isNotNull()).select("doc_id", *_DETAIL)


@query("a17_rule_counters", f"""SELECT s.rule_id, count(*) AS match_count, max(r.t_us) AS last_matched_us FROM ({signature_sql(R.RuleBook(USER_RULES))}) s JOIN request_rows r ON r.doc_id = s.doc_id
WHERE s.rule_id IS NOT NULL GROUP BY 1""")
def _(spark, d):
    hits = R.signature_filter(A.requests(spark, d), R.RuleBook(USER_RULES)).where(F.col("rule_id").isNotNull())
    return D.rule_counters(hits.withColumn("ts_us", F.col("t_us")))


@query("a18_rule_census", "SELECT count(*) AS total, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'rejected') AS rejected, max(created_us) AS newest_us FROM rule_store")
def _(spark, d):
    return D.rule_census(A.rule_store(spark, d))


@query("a18_rules_newest_first", "SELECT rule_id, pattern, status, created_us FROM rule_store WHERE status = 'active' ORDER BY created_us DESC, rule_id")
def _(spark, d):
    return D.rules_newest_first(A.rule_store(spark, d), "active").select("rule_id", "pattern", "status", "created_us")


_J03 = [(f"s{i}", p) for i, p in enumerate(P.STATIC_SQLI + P.STATIC_XSS + P.STATIC_PATH)]


@query("j03_match_rules", f"""SELECT payload_id, rule_id FROM payloads, (VALUES {', '.join(f"({lit(i)}, {lit(P.portable(p))})" for i, p in _J03)}) r(rule_id, pattern) WHERE regexp_matches(payload, pattern)""")
def _(spark, d):
    return R.match_rules(A.payloads(spark, d), "payload_id", "payload", _J03)


# TRY turns a pattern that does not compile into NULL.
_HIT = lambda text: f"TRY(regexp_matches({lit(text)}, '(?is)' || trim(pattern)))"
_SAFE = f"""(length(trim(pattern)) BETWEEN 5 AND 500 AND trim(pattern) NOT IN {sql_in(P.WILDCARDS)} AND coalesce(NOT {_HIT('')}, false)
AND {' + '.join(f"coalesce(CAST({_HIT(t)} AS INTEGER), 0)" for t in P.BENIGN_SAMPLES)} < 3)"""


@query("d07_validate_patterns", f"SELECT pattern, event_id, {_SAFE} AS is_safe FROM proposals")
def _(spark, d):
    return R.validate_patterns(A.proposals(spark, d)).select("pattern", "event_id", "is_safe")


@query("d08_admit_rules", f"""SELECT md5(pattern) AS rule_id, pattern, attack_type, event_id AS source_event_id, severity, round(confidence, 4) AS confidence, 'active' AS status, 0::BIGINT AS match_count,
proposed_us AS created_us, CAST(NULL AS BIGINT) AS last_matched_us FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY proposed_us, event_id) AS r FROM proposals WHERE severity IN ('CRITICAL', 'HIGH')) WHERE r = 1
AND pattern NOT IN (SELECT pattern FROM rule_store) AND {_SAFE} ORDER BY proposed_us, event_id, pattern LIMIT (SELECT greatest(0, 500 - count(*)) FROM rule_store)""")
def _(spark, d):
    return R.admit_rules(A.proposals(spark, d), A.rule_store(spark, d), K.MAX_ADAPTIVE_RULES)


@query("j09_anti_existing", "SELECT rule_id, pattern FROM rule_store WHERE pattern NOT IN (SELECT pattern FROM rule_store WHERE status = 'rejected')")
def _(spark, d):
    rules = A.rule_store(spark, d)
    return R.anti_existing(rules.select("rule_id", "pattern"), rules.where("status = 'rejected'"), "pattern")


@query("d09_conf_to_score", """SELECT event_id, round(CASE WHEN regex_conf >= 1 THEN 1.0 WHEN regex_conf <= 0.6 THEN 0.2 ELSE 0.2 + (CAST(floor(regex_conf * 1000) AS BIGINT) / 1000.0::DOUBLE - 0.6) * 2.0 END::DOUBLE, 3) AS score FROM attack_events""")
def _(spark, d):
    conf = F.floor(F.col("regex_conf") * 1000) / 1000.0
    return A.attack_events(spark, d).select("event_id", S.confidence_to_score(F.when(F.col("regex_conf") >= 1, 1.0).otherwise(conf)).alias("score"))


def family_sql() -> str:
    parts = []
    for i, (name, pats) in enumerate(P.HONEYPOT_FAMILIES.items()):
        hits = " + ".join(flag(rx("txt", p)) for p in pats)
        parts.append(f"SELECT doc_id, {i} AS ord, '{name}' AS fam, ({hits}) / {len(pats)}::DOUBLE AS s FROM hit_text")
    return f"SELECT doc_id, list(fam || ':' || CAST(round(s, 2) AS VARCHAR) ORDER BY round(s, 2) DESC, ord) AS tags FROM ({' UNION ALL '.join(parts)}) WHERE s >= 0.25 GROUP BY doc_id"


@query("d10_honeypot_tags", f"SELECT h.doc_id, array_to_string(coalesce(t.tags, []), '|') AS tags FROM hit_text h LEFT JOIN ({family_sql()}) t ON t.doc_id = h.doc_id")
def _(spark, d):
    return R.tag_requests(A.honeypot(spark, d)).select("doc_id", F.array_join("tags", "|").alias("tags"))


@query("a10_honeypot_metrics", f"""SELECT 'total_requests' AS metric, '' AS "key", count(*) AS value FROM hit_text UNION ALL SELECT 'unique_ips', '', count(DISTINCT ip) FROM hit_text
UNION ALL SELECT 'ti_hits', '', count(*) FILTER (WHERE doc_id % 3 = 0) FROM hit_text UNION ALL SELECT 'by_method', method, count(*) FROM hit_text GROUP BY method
UNION ALL SELECT 'tag_counts', split_part(tag, ':', 1), count(*) FROM (SELECT unnest(tags) AS tag FROM ({family_sql()})) GROUP BY 2""")
def _(spark, d):
    h = R.tag_requests(A.honeypot(spark, d)).select("ip", "method", "tags", F.coalesce("threat_intel.ti_found", F.lit(False)).alias("ti_found"))
    return D.honeypot_metrics(h)


# -- fusion ------------------------------------------------------------------------------------------

_W = {"regex_conf": K.WEIGHT_REGEX, "app_lgbm_score": K.WEIGHT_CLASSIFIER, "deep_anomaly": K.WEIGHT_ANOMALY, "net_lgbm_score": K.WEIGHT_NETWORK}
_FUSED = "round(greatest(0.0, least(1.0, 0.20 * regex_conf + 0.35 * app_lgbm_score + 0.25 * deep_anomaly + 0.20 * net_lgbm_score)), 4)"
# Inputs cut to two decimals keep the four-decimal result free of ties.
_TWO = "(SELECT * REPLACE (floor(regex_conf * 100) / 100 AS regex_conf, floor(app_lgbm_score * 100) / 100 AS app_lgbm_score) FROM attack_events)"


def two_digits(spark, d):
    e = A.attack_events(spark, d)
    return e.withColumn("regex_conf", F.floor(F.col("regex_conf") * 100) / 100.0).withColumn("app_lgbm_score", F.floor(F.col("app_lgbm_score") * 100) / 100.0)


@query("d11_fuse", f"SELECT event_id, {_FUSED} AS fused FROM {_TWO}")
def _(spark, d):
    return FU.fuse(two_digits(spark, d)).select("event_id", "fused")


@query("d12_action", f"SELECT fused_action, count(*) AS n FROM (SELECT {sql_action('fused')} AS fused_action FROM (SELECT {_FUSED} AS fused FROM {_TWO})) GROUP BY 1")
def _(spark, d):
    return FU.fuse(two_digits(spark, d)).groupBy("fused_action").agg(F.count(F.lit(1)).alias("n"))


@query("d13_hard_block", f"""SELECT e.event_id, hb AS hard_blocked, CASE WHEN hb THEN 1.0 ELSE fused END AS decided_score, CASE WHEN hb THEN 'BLOCK' ELSE {sql_action('fused')} END AS decided_action, CASE WHEN hb THEN coalesce(layer, 'Layer0') END AS decided_layer
FROM (SELECT e.event_id, {_FUSED} AS fused, (l.layer IS NOT NULL OR e.short_circuited) AS hb, l.layer FROM {_TWO} e LEFT JOIN (SELECT event_id, arg_min(layer, pos) AS layer FROM event_layers WHERE triggered GROUP BY 1) l ON l.event_id = e.event_id) e""")
def _(spark, d):
    return FU.hard_block(FU.fuse(two_digits(spark, d))).select("event_id", "hard_blocked", "decided_score", "decided_action", "decided_layer")


@query("d14_reason", """SELECT e.event_id, CASE WHEN l.event_id IS NULL THEN 'Clean traffic' ELSE 'Detected ' || l.label || ' (layer=' || l.layer || ', score=' || printf('%.2f', l.score) || ')' END AS reason FROM attack_events e
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, pos) AS r FROM (SELECT * REPLACE (floor(score * 100) / 100 AS score) FROM event_layers) WHERE score > 0.5) l ON l.event_id = e.event_id AND l.r = 1""")
def _(spark, d):
    cut = F.transform("layer_scores", lambda s: s.withField("score", F.floor(s["score"] * 100) / 100.0))
    return A.attack_events(spark, d).withColumn("layer_scores", cut).select("event_id", FU.reason().alias("reason"))


@query("d15_fuse_enabled", f"SELECT event_id, fused, {sql_action('fused')} AS fused_action FROM (SELECT event_id, round((0.20 * regex_conf + 0.35 * app_lgbm_score + 0.20 * net_lgbm_score) / 0.75, 3) AS fused FROM {_TWO})")
def _(spark, d):
    out = FU.fuse_enabled(two_digits(spark, d), {"deep_anomaly": False})
    return out.withColumn("fused", F.round("fused", 3)).select("event_id", "fused", S.action(F.col("fused")).alias("fused_action"))


_NET = """SELECT event_id, k, CASE WHEN k % 5 <> 0 THEN k / 100.0::DOUBLE END AS lgbm_score, CASE WHEN k % 7 <> 0 THEN (100 - k) / 100.0::DOUBLE END AS ensemble_score, CASE WHEN k % 3 = 0 THEN 'benign' ELSE best_label END AS lgbm_label FROM attack_events"""


def network_rows(spark, d):
    k = F.col("k")
    return A.attack_events(spark, d).select("event_id", F.when(k % 5 != 0, k / 100.0).alias("lgbm_score"), F.when(k % 7 != 0, (100 - k) / 100.0).alias("ensemble_score"),
                                            F.when(k % 3 == 0, "benign").otherwise(F.col("best_label")).alias("lgbm_label"))


@query("d16_fuse_network", f"""SELECT event_id, round(f, 6) AS network_fused, round(f, 6) >= 0.35 AS is_threat, greatest(coalesce(lgbm_score, 0), coalesce(ensemble_score, 0)) AS network_confidence
FROM (SELECT *, greatest(0.0, least(1.0, CASE WHEN lgbm_score IS NOT NULL AND ensemble_score IS NOT NULL THEN 0.55 * lgbm_score + 0.45 * ensemble_score ELSE coalesce(lgbm_score, ensemble_score, 0) END)) AS f FROM ({_NET}))""")
def _(spark, d):
    out = FU.fuse_network(network_rows(spark, d))
    return out.select("event_id", F.round("network_fused", 6).alias("network_fused"), (F.round("network_fused", 6) >= 0.35).alias("is_threat"), "network_confidence")


@query("d17_attack_type", f"""SELECT event_id, CASE WHEN lower(lgbm_label) NOT IN ('benign', 'normal', 'clean', 'norm') THEN lgbm_label WHEN coalesce(ensemble_score, 0) >= 0.5 THEN 'ZeroDay' ELSE 'clean' END AS attack_type FROM ({_NET})""")
def _(spark, d):
    return network_rows(spark, d).select("event_id", FU.attack_type(F.col("lgbm_label"), F.col("ensemble_score")).alias("attack_type"))


@query("d18_gated_score", """SELECT event_id, CASE WHEN k > 50 THEN 'scored' ELSE 'gate_clean' END AS gate, CASE WHEN k > 50 THEN final_score ELSE 0.0 END AS app_score, CASE WHEN k > 50 THEN best_label ELSE 'clean' END AS app_label FROM attack_events""")
def _(spark, d):
    e = A.attack_events(spark, d).select("event_id", "k", "final_score", "best_label", F.when(F.col("k") > 50, "anomaly").otherwise("clean").alias("anomaly_label"), (F.col("k") / 100.0).alias("anomaly_score"))
    scorer = lambda x: x.withColumn("app_score", F.col("final_score")).withColumn("app_label", F.col("best_label"))
    return FU.gated_score(e, scorer).select("event_id", "gate", "app_score", "app_label")


_MODELS = {"ae": (0.0, 0.95), "vae": (0.05, 0.9), "occ": (0.0, 0.9), "iso": (0.1, 0.95)}
_WEIGHTS = {"ae": 0.4, "vae": 0.2, "occ": 0.3, "iso": 0.1}
_N = {m: f"greatest(0.0, least(1.0, ({m} - {lo}) / {hi - lo + 1e-9!r}))" for m, (lo, hi) in _MODELS.items()}
_RAW = " + ".join(f"CASE WHEN {m} IS NULL THEN 0 ELSE {w} * {_N[m]} END" for m, w in _WEIGHTS.items())
_PRESENT = " + ".join(f"CASE WHEN {m} IS NULL THEN 0 ELSE {w} END" for m, w in _WEIGHTS.items())


@query("d19_ensemble", f"""SELECT row_id, round(({_RAW}) / ({_PRESENT}), 6) AS fused_raw, round(least(1.0, ({_RAW}) / ({_PRESENT}) / (2 * 0.42)), 6) AS ensemble_score,
round(ae, 6) AS ae_raw, round({_N['ae']}, 4) AS ae_norm, round(0.4 / ({_PRESENT}), 4) AS ae_weight, {_N['ae']} >= 0.5 AS ae_anomaly FROM (SELECT * REPLACE (CASE WHEN row_id % 9 <> 4 THEN vae END AS vae) FROM scored)""")
def _(spark, d):
    df = A.scored(spark, d).withColumn("vae", F.when(F.col("row_id") % 9 != 4, F.col("vae")))
    out = FU.ensemble(df, _MODELS, _WEIGHTS, 0.42)
    m = F.col("models")["ae"]
    return out.select("row_id", F.round("fused_raw", 6).alias("fused_raw"), F.round("ensemble_score", 6).alias("ensemble_score"), m["raw"].alias("ae_raw"), m["norm"].alias("ae_norm"),
                      m["weight"].alias("ae_weight"), m["anomaly"].alias("ae_anomaly"))


@query("d20_thr_score", "SELECT row_id, round(greatest(0.0, least(1.0, score / (2.0 * 0.3))), 6) AS thr_score FROM scored")
def _(spark, d):
    return A.scored(spark, d).select("row_id", F.round(S.threshold_score(F.col("score"), 0.3), 6).alias("thr_score"))


@query("t06_top_probs", """SELECT row_id, max(label) FILTER (WHERE r = 1) AS first_label, max(prob) FILTER (WHERE r = 1) AS first_prob, max(label) FILTER (WHERE r = 4) AS last_label, max(prob) FILTER (WHERE r = 4) AS last_prob FROM (
SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY prob DESC, label) AS r FROM (SELECT row_id, 'ae' AS label, ae AS prob FROM scored UNION ALL SELECT row_id, 'vae', vae FROM scored
UNION ALL SELECT row_id, 'occ', occ FROM scored UNION ALL SELECT row_id, 'iso', iso FROM scored)) GROUP BY row_id""")
def _(spark, d):
    m = F.create_map(*[x for c in ("ae", "vae", "occ", "iso") for x in (F.lit(c), F.col(c))])
    top = FU.top_probs(m, 4)
    return A.scored(spark, d).select("row_id", top[0]["label"].alias("first_label"), top[0]["prob"].alias("first_prob"), top[3]["label"].alias("last_label"), top[3]["prob"].alias("last_prob"))


_TEC = {k: v for k, v in K.TECHNIQUES.items()}
_LAB = "CASE WHEN event_id % 5 = 0 THEN 'Path-Traversal' WHEN event_id % 5 = 1 THEN 'Zero-Day' WHEN event_id % 5 = 2 THEN 'nothing known' ELSE best_label END"


def _tech(i: int) -> str:
    table = {k: v[i] for k, v in _TEC.items()}
    return f"coalesce({sql_case('replace(replace(lower(lab), chr(45), chr(95)), chr(32), chr(95))', table)}, {sql_case('lower(lab)', table)})"


@query("j04_map_attack", f"""SELECT event_id, technique_id, technique_name, tactic, CASE WHEN tactic IS NOT NULL THEN coalesce({sql_case('tactic', K.KILL_CHAIN)}, 'Unknown') END AS kill_chain_phase
FROM (SELECT event_id, {_tech(0)} AS technique_id, {_tech(1)} AS technique_name, {_tech(2)} AS tactic FROM (SELECT event_id, {_LAB} AS lab FROM attack_events))""")
def _(spark, d):
    i = F.col("event_id") % 5
    lab = F.when(i == 0, "Path-Traversal").when(i == 1, "Zero-Day").when(i == 2, "nothing known").otherwise(F.col("best_label"))
    out = EN.map_attack(A.attack_events(spark, d).select("event_id", lab.alias("lab")), "lab")
    return out.select("event_id", "technique_id", "technique_name", "tactic", "kill_chain_phase")


_INTEL = """SELECT e.event_id, r."count" AS honeypot_count, a.abuse_confidence_score, a.country_code, g.org, CASE WHEN r."count" > 10 THEN 'high' WHEN r."count" > 2 THEN 'medium' WHEN r."count" IS NOT NULL THEN 'low' END AS threat_level
FROM attack_events e LEFT JOIN intel_reports r ON r.ip = e.ip LEFT JOIN intel_abuse a ON a.ip = e.ip LEFT JOIN intel_geo g ON g.ip = e.ip"""


def with_intel(spark, d):
    return EN.enrich_intel(A.attack_events(spark, d).select("event_id", "ip"), A.intel_reports(spark, d), A.intel_abuse(spark, d), A.intel_geo(spark, d))


@query("j05_enrich_intel", _INTEL)
def _(spark, d):
    return with_intel(spark, d).select("event_id", "honeypot_count", "abuse_confidence_score", "country_code", "org", "threat_level")


@query("j06_prevalence", f"""SELECT event_id, CASE WHEN c > 20 OR a > 80 THEN 'widespread' WHEN c > 5 OR a > 40 THEN 'emerging' ELSE 'isolated' END AS prevalence
FROM (SELECT event_id, coalesce(honeypot_count, 0) AS c, coalesce(abuse_confidence_score, 0) AS a FROM ({_INTEL}))""")
def _(spark, d):
    return with_intel(spark, d).select("event_id", EN.prevalence(F.col("honeypot_count"), F.col("abuse_confidence_score")).alias("prevalence"))


@query("j07_join_analysis", "SELECT e.request_id, coalesce(a.status, 'not_found') AS analysis_status, a.severity FROM attack_events e LEFT JOIN analyses a ON a.event_id = e.request_id")
def _(spark, d):
    return EN.join_analysis(A.attack_events(spark, d).select("request_id"), A.analyses(spark, d))


_DEC = f"""SELECT event_id, final_score, action, best_label, ts_us, ip, block_reason, k, (k % 2 = 0) AS correlated, CASE k % 3 WHEN 0 THEN 1.3 WHEN 1 THEN 1.5 ELSE 1.7 END::DOUBLE AS multiplier, CAST(k % 3 + 2 AS INTEGER) AS distinct_types FROM attack_events"""


def correlated_rows(spark, d):
    k = F.col("k")
    e = A.attack_events(spark, d).select("event_id", F.round("final_score", 2).alias("final_score"), "ip", "ts_us", "k", "block_reason")
    e = e.withColumn("action", S.action(F.col("final_score"))).withColumn("correlated", k % 2 == 0)
    e = e.withColumn("multiplier", F.when(k % 3 == 0, 1.3).when(k % 3 == 1, 1.5).otherwise(1.7)).withColumn("distinct_types", (k % 3 + 2).cast("int"))
    return e.withColumn("amplified_score", S.round4(F.least(F.lit(1.0), F.col("final_score") * F.col("multiplier"))))


_CORR_SQL = f"""SELECT event_id, ip, ts_us, block_reason, score0, act0, multiplier, distinct_types, CASE WHEN up THEN amp ELSE score0 END AS new_score, CASE WHEN up THEN {sql_action('amp')} ELSE act0 END AS new_action, up FROM (
SELECT *, {sql_action('score0')} AS act0, round(least(1.0, score0 * multiplier), 4) AS amp, (correlated AND score0 > 0.05 AND round(least(1.0, score0 * multiplier), 4) > score0) AS up FROM (
SELECT *, least(10000, cents2 // 2 // 100 * 100) / 10000.0::DOUBLE AS score0 FROM (SELECT d.*, b.cents AS cents2 FROM ({_DEC}) d JOIN base_events b ON b.event_id = d.event_id)))"""


def floor_two(spark, d):
    e = correlated_rows(spark, d)
    base = A.base_events(spark, d).select("event_id", (F.least(F.lit(10000), F.floor(F.floor(F.col("cents") / 2) / 100) * 100) / 10000.0).alias("s"))
    e = e.drop("final_score", "action", "amplified_score").join(base, "event_id").withColumnRenamed("s", "final_score")
    return e.withColumn("action", S.action(F.col("final_score"))).withColumn("amplified_score", S.round4(F.least(F.lit(1.0), F.col("final_score") * F.col("multiplier"))))


@query("d23_apply_correlation", f"""SELECT event_id, new_score, new_action, CASE WHEN up AND new_action <> act0 AND new_action = 'BLOCK' THEN 'cross-pipeline correlation (multiplier=' || printf('%.1f', multiplier) || 'x, types=' || distinct_types || ')' ELSE block_reason END AS new_reason FROM ({_CORR_SQL})""")
def _(spark, d):
    return FU.apply_correlation(floor_two(spark, d)).select("event_id", "new_score", "new_action", "new_reason")


@query("d24_select_threats", f"""SELECT e.request_id AS event_id, e.ip AS ip_address, e.path AS url, coalesce(l.label, 'unknown') AS attack_type, e.action AS action_taken, e.path || ' ' || e.block_reason AS payload, e.final_score AS fusion_score, s.n AS n_contributions
FROM attack_events e LEFT JOIN (SELECT event_id, arg_min(label, pos) AS label FROM event_layers WHERE label NOT IN {_BENIGN} GROUP BY 1) l ON l.event_id = e.event_id
LEFT JOIN (SELECT event_id, count(*) AS n FROM event_layers WHERE score > 0 GROUP BY 1) s ON s.event_id = e.event_id WHERE e.final_score >= 0.65 AND NOT e.short_circuited""")
def _(spark, d):
    e = A.attack_events(spark, d).withColumn("body", F.concat("path", F.lit(" "), "block_reason"))
    return FU.select_threats(e).select("event_id", "ip_address", "url", "attack_type", "action_taken", "payload", F.col("detection_scores.fusion_score").alias("fusion_score"),
                                       F.size("layer_contributions").cast("bigint").alias("n_contributions"))


@query("d25_derive_blacklist", """SELECT ip, block_reason AS reason, false AS permanent, 'auto' AS source, ts_us AS blocked_us, ts_us + 3600000000 AS expires_us, CAST(NULL AS BIGINT) AS unblocked_us FROM attack_events WHERE action = 'BLOCK'""")
def _(spark, d):
    return FU.derive_blacklist(A.attack_events(spark, d))
