"""The adapters of ``palisade.sources.adapters`` written as SQL, for the side-by-side check."""

from __future__ import annotations

from palisade import constants as K
from palisade.sources import adapters as A


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_pick(values: list[str], index: str) -> str:
    return f"list_extract([{', '.join(lit(v) for v in values)}], CAST(({index}) % {len(values)} AS BIGINT) + 1)"


def sql_action(score: str) -> str:
    whens = " ".join(f"WHEN {score} >= {floor} THEN '{name}'" for name, floor in K.ACTION_FLOORS)
    return f"CASE {whens} ELSE '{K.ACTION_DEFAULT}' END"


def sql_case(col: str, mapping: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"CASE {col} {whens} ELSE {default} END"


def sql_hash(*cols: str, seed: int = 42) -> str:
    text = "concat_ws('|', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + f", '{seed}')"
    return f"CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT)"


def sql_in(values: list[str]) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def sql_ip(user: str) -> str:
    return f"'10.0.' || ({user} // 256) || '.' || ({user} % 256)"


CTES: dict[str, str] = {}

CTES["base_events"] = f"""
SELECT event_id, user_id, event_type, value, ts, epoch_us(ts) AS ts_us,
       (epoch_us(ts) - {A.EPOCH_2024_US}) // {A.TIME_SQUEEZE} AS t_us,
       CAST(round(value * 100) AS BIGINT) AS cents,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
       {sql_ip('user_id')} AS ip
FROM events"""

CTES["attack_events"] = f"""
SELECT md5(CAST(event_id AS VARCHAR)) AS request_id, event_id, ip, {sql_pick(A.METHODS, 'event_id')} AS method,
       '/' || event_type || '/' || user_id AS path, ts_us / 1e6 AS "timestamp", ts AS event_time, ts_us, t_us,
       final_score, action, CASE WHEN action = 'BLOCK' THEN 'Detected ' || best_label ELSE '' END AS block_reason,
       k >= 90 AS short_circuited, k / 100.0::DOUBLE AS network_score,
       CASE WHEN event_id % 97 <> 0 THEN value END AS latency_ms, best_label,
       (cents % 10000) / 10000.0::DOUBLE AS regex_conf, final_score AS app_lgbm_score,
       k / 100.0::DOUBLE AS net_lgbm_score, k / 100.0::DOUBLE AS deep_anomaly, k, cents
FROM (SELECT *, {sql_action('final_score')} AS action
      FROM (SELECT *, least(10000, cents // 2) / 10000.0::DOUBLE AS final_score,
                   {sql_case('event_type', A.EVENT_LABELS, "'unknown'")} AS best_label FROM base_events))"""

CTES["event_layers"] = f"""
SELECT event_id, request_id, 0 AS pos, '{K.LAYER_STATIC}' AS layer, CASE WHEN k >= 90 THEN 1.0 ELSE 0.0 END::DOUBLE AS score,
       CASE WHEN k >= 90 THEN 'pattern_match' WHEN k < 20 THEN 'suspicious' ELSE 'clean' END AS label,
       1.0::DOUBLE AS confidence, k >= 90 AS triggered FROM attack_events
UNION ALL
SELECT event_id, request_id, 1, '{K.LAYER_REGEX}', regex_conf, CASE WHEN k % 2 = 0 THEN best_label ELSE 'clean' END,
       regex_conf, k % 10 = 3 FROM attack_events
UNION ALL
SELECT event_id, request_id, 2, '{K.LAYER_ANOMALY}', k / 100.0::DOUBLE, CASE WHEN k > 50 THEN 'anomaly' ELSE 'clean' END,
       0.5, false FROM attack_events
UNION ALL
SELECT event_id, request_id, 3, '{K.LAYER_CLASSIFIER}', final_score, best_label, final_score, false FROM attack_events"""

CTES["packets"] = """
SELECT event_id AS packet_id, ip AS remote_ip, t_us, cents // 10 AS length,
       CASE WHEN k < 3 THEN 17 WHEN k < 10 THEN 2 WHEN k < 40 THEN 24 ELSE 16 END AS flags,
       CASE WHEN event_id % 3 = 0 THEN 'bwd' ELSE 'fwd' END AS direction
FROM base_events"""

CTES["raw_packets"] = """
SELECT packet_id, t_us, length, flags,
       CASE WHEN packet_id % 50 <> 7 THEN CASE WHEN direction = 'bwd' THEN '192.168.0.10' ELSE remote_ip END END AS src_ip,
       CASE WHEN packet_id % 50 <> 7 THEN CASE WHEN direction = 'bwd' THEN remote_ip ELSE '192.168.0.10' END END AS dst_ip
FROM packets"""

CTES["correlation_events"] = """
SELECT event_id, ip, t_us, CASE WHEN best_label = 'portscan' THEN 'network' ELSE 'application' END AS layer,
       best_label AS "type", least(1000, cents // 20) / 1000.0::DOUBLE AS score FROM attack_events"""

CTES["network_threats"] = """
SELECT event_id AS threat_id, ip, t_us, network_score AS score, best_label AS attack_type
FROM attack_events WHERE best_label = 'portscan'"""

CTES["blacklist"] = """
SELECT event_id AS block_id, ip, t_us AS blocked_us,
       CASE WHEN event_id % 50 <> 0 THEN t_us + 20000000 END AS expires_us,
       CASE WHEN event_id % 7 = 0 THEN t_us + 10000000 END AS unblocked_us
FROM attack_events WHERE action = 'BLOCK'"""

_TEXTS = [t for _, t in A.SNIPPETS]
CTES["payloads"] = f"""
SELECT payload_id, source, text || ' ' || {sql_pick(_TEXTS, 'n')} AS payload,
       {sql_pick([c for c, _ in A.SNIPPETS], 'n')} AS attack_type
FROM (SELECT 'doc-' || doc_id AS payload_id, 'documents' AS source, text, doc_id AS n FROM documents
      UNION ALL SELECT 'conv-' || conv_id || '-' || turn, 'conversations', text, conv_id * 7 + turn FROM conversations
      UNION ALL SELECT 'page-' || page_id, 'pages', html, page_id FROM pages)"""

CTES["request_rows"] = f"""
SELECT md5('r' || doc_id) AS request_id, doc_id, {sql_ip('(doc_id % 150)')} AS ip,
       (doc_id * 700001) % 720000000 AS t_us, {sql_pick(["GET", "POST", "PUT", "GET", "POST"], 'doc_id')} AS method,
       CASE WHEN doc_id % 29 = 5 THEN '/files/../../etc/hosts' WHEN doc_id % 31 = 6 THEN '/health'
            ELSE '/' || source || '/' || lang END AS path,
       {sql_pick(A.AGENTS, 'doc_id // 3')} AS user_agent,
       ' 172.16.0.' || (doc_id % 200) || ', 10.9.9.9' AS forwarded,
       CAST(doc_id % 10 AS VARCHAR) AS q_page, {sql_pick(_TEXTS, 'doc_id // 18')} AS q_q,
       text || ' ' || {sql_pick(_TEXTS, 'doc_id')} AS body,
       CASE WHEN doc_id % 2 = 0 THEN '10.9.9.9' ELSE '203.0.113.7' END AS peer_ip
FROM documents"""

CTES["flow_table"] = """
SELECT o_orderkey AS flow_id, o_custkey AS src_id, o_orderdate AS "day",
       CASE WHEN o_orderpriority = '1-URGENT' AND pkts >= 4 THEN 'ddos' WHEN o_orderpriority = '2-HIGH' AND pkts <= 2 THEN 'portscan'
            WHEN o_orderpriority = '3-MEDIUM' AND nbytes >= 120 THEN 'botnet' ELSE 'benign' END AS label,
       secs * 1000000.0::DOUBLE AS "flow duration", nf::DOUBLE AS "total fwd packets", nb::DOUBLE AS "total backward packets",
       coalesce(lf, 0.0) AS "total length of fwd packets", coalesce(lb, 0.0) AS "total length of bwd packets",
       coalesce(af, 0.0) AS "fwd packet length mean", coalesce(ab, 0.0) AS "bwd packet length mean",
       nbytes / secs AS "flow bytes/s", pkts / secs AS "flow packets/s",
       syn::DOUBLE AS "syn flag count", ack::DOUBLE AS "ack flag count", psh::DOUBLE AS "psh flag count",
       am AS "packet length mean", sd AS "packet length std", im AS "idle mean", isd AS "idle std"
FROM orders JOIN (
  SELECT l_orderkey, greatest((epoch_us(max(l_shipdate::TIMESTAMP)) - epoch_us(min(l_shipdate::TIMESTAMP))) / 86400000000.0::DOUBLE, 1.0::DOUBLE) AS secs,
         count(*) FILTER (WHERE l_linenumber % 2 = 1) AS nf, count(*) FILTER (WHERE l_linenumber % 2 <> 1) AS nb,
         sum(l_quantity) FILTER (WHERE l_linenumber % 2 = 1) AS lf, sum(l_quantity) FILTER (WHERE l_linenumber % 2 <> 1) AS lb,
         avg(l_quantity) FILTER (WHERE l_linenumber % 2 = 1) AS af, avg(l_quantity) FILTER (WHERE l_linenumber % 2 <> 1) AS ab,
         sum(l_quantity) AS nbytes, count(*) AS pkts,
         count(*) FILTER (WHERE l_returnflag = 'A') AS syn, count(*) FILTER (WHERE l_returnflag = 'N') AS ack,
         count(*) FILTER (WHERE l_returnflag = 'R') AS psh, avg(l_quantity) AS am, stddev_pop(l_quantity) AS sd,
         avg(l_discount * 1000000) AS im, stddev_pop(l_discount * 1000000) AS isd
  FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey"""


def _model(gain: int, mod: int) -> str:
    return f"(y_true * {gain} + (row_id * 7919 + cents * 31) % {mod}) / 10000.0::DOUBLE"


CTES["scored"] = f"""
SELECT row_id, y_true, true_label, CASE WHEN k < 80 THEN true_label ELSE {sql_pick(A.CLASS_NAMES, 'row_id')} END AS pred_label,
       (y_true * 3000 + k * 50 + cents % 2000) / 10000.0::DOUBLE AS score,
       {_model(2500, 7001)} AS ae, {_model(1500, 8009)} AS vae, {_model(3500, 6007)} AS occ, {_model(1000, 9001)} AS iso
FROM (SELECT event_id AS row_id, k, cents, CASE WHEN event_type IN ('error', 'purchase') THEN 1 ELSE 0 END AS y_true,
             CASE event_type WHEN 'error' THEN 'ddos' WHEN 'purchase' THEN 'portscan' WHEN 'signup' THEN 'botnet' ELSE 'benign' END AS true_label
      FROM base_events)"""


def _captured() -> str:
    cols = []
    for i, name in enumerate(A.captured_columns()):
        v = f"((cents // {i + 1} + o_custkey * {i + 3}) % {1000 + 37 * i}) / 10.0::DOUBLE"
        if name == "Flow Bytes/s":
            v = f"CASE WHEN o_orderkey % 11 = 0 THEN 'Infinity'::DOUBLE WHEN o_orderkey % 13 = 1 THEN 'NaN'::DOUBLE ELSE {v} END"
        if name == "Init_Win_bytes_forward":
            v = f"CASE WHEN o_orderkey % 5 = 0 THEN -1.0 ELSE {v} END"
        cols.append(f'{v} AS "{name}"')
    return ", ".join(cols)


CTES["raw_flows"] = f"""SELECT o_orderkey AS row_id, {_captured()}, ' ' || {sql_pick(A.RAW_LABELS, 'o_orderkey')} AS "Label"
FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)"""

CTES["intel_reports"] = f"""SELECT {sql_ip('s_suppkey')} AS ip, s_suppkey * 7 % 30 AS "count", '2024-01-01' AS first_seen, '2024-01-30' AS last_seen FROM supplier"""
CTES["intel_abuse"] = f"""SELECT {sql_ip('c_custkey')} AS ip, c_custkey * 13 % 101 AS abuse_confidence_score, c_custkey % 17 AS total_reports, 'N' || c_nationkey AS country_code
FROM customer WHERE c_custkey % 3 <> 0"""
CTES["intel_geo"] = f"""SELECT {sql_ip('c_custkey')} AS ip, {sql_pick(A.OWNERS, 'c_custkey')} AS org, {sql_pick(["Net One", "proxy net", "Mullvad"], 'c_custkey')} AS isp FROM customer"""
CTES["analyses"] = f"""SELECT request_id AS event_id, CASE WHEN k % 3 = 0 THEN 'pending' ELSE 'complete' END AS status,
{sql_pick(["CRITICAL", "HIGH", "MEDIUM"], 'event_id')} AS severity, ts_us, best_label, final_score FROM attack_events WHERE final_score >= 0.65 AND NOT short_circuited"""
CTES["rule_store"] = f"""SELECT substr(md5(p_brand), 1, 8) AS rule_id, '<svg/onloadx' || (n % 40) AS pattern, 'xss' AS attack_type,
CASE WHEN n % 4 = 0 THEN 'rejected' ELSE 'active' END AS status, {A.EPOCH_2024_US} + n AS created_us FROM (SELECT p_brand, min(p_partkey) AS n FROM part GROUP BY 1)"""
CTES["hit_text"] = """SELECT doc_id, ip, method, path, path || chr(10) || 'page=' || q_page || '&q=' || q_q || chr(10) || chr(10) || 'user-agent:' || user_agent || ' x-forwarded-for:' || forwarded || ' accept:*/*' || chr(10) || body AS txt FROM request_rows"""

_N = "((ts_us // 1000) % 1000)"
CTES["proposals"] = f"""SELECT {sql_pick(A.PROPOSALS, _N)} || CASE WHEN {_N} % 3 = 0 THEN '' ELSE 'x' || ({_N} % 40) END AS pattern, best_label AS attack_type, event_id, severity,
final_score AS confidence, ts_us AS proposed_us FROM analyses"""
