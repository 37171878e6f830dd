"""Multi-operator jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade import constants as K
from palisade.catalog.datasets import FINITE_SQL
from palisade.catalog.detection import _SUSPICION_SQL, compact_sql, lexical_sql, signature_sql
from palisade.catalog.registry import query
from palisade.catalog.twins import sql_action, sql_case, sql_hash, sql_in
from palisade.functions import lexical as LX
from palisade.operators import request_models as RM
from palisade.operators import rules as R
from palisade.operators import temporal as W
from palisade.plans import corpus, scoring
from palisade.session import fresh_dir
from palisade.sources import adapters as A

LIMIT = 6


BENIGN, SHARE = "norm", 0.9


def fitted_models(spark, d, kind, **kw):
    """Gate and classifier fitted on the labelled payloads, stored, and read back as a job would."""
    models = RM.fit_request_models(A.payloads(spark, d), "payload", "attack_type", BENIGN, kind, share=SHARE, **kw)
    path = fresh_dir(spark, "request-models")
    models.save(path)
    return RM.RequestModels.load(spark, path)


# Gate and naive Bayes from their definitions: means, deviations and shares of the labelled payloads.
_EVIDENCE = "[" + ", ".join(f'(CASE WHEN "{c}" > 0 THEN 1 ELSE 0 END)::DOUBLE' for c in RM.EVIDENCE) + "]"
_SHARES = "[" + ", ".join(f"(ln(sum(b[{i}]) + 1) - ln(count(*) + 2))" for i in range(1, len(RM.EVIDENCE) + 1)) + "]"
_LACKS = "[" + ", ".join(f"ln(1 - (sum(b[{i}]) + 1) / (count(*) + 2))" for i in range(1, len(RM.EVIDENCE) + 1)) + "]"
_PARTS = " + ".join(f"CASE WHEN m.s_{c} > 0 THEN ((g.{c} - m.m_{c}) / m.s_{c}) ** 2 ELSE 0 END" for c in LX.COMPACT_FEATURES)


def models_sql(gate: str, text: str) -> str:
    """CTEs ``an`` (gate score) and ``app`` (threat and class) of the rows of ``live``, for the two texts of a row."""
    return f"""gate_texts AS (SELECT 't' || payload_id AS id, attack_type AS cls, payload AS p FROM payloads UNION ALL SELECT 'r' || doc_id, NULL, {gate} FROM live),
class_texts AS (SELECT 't' || payload_id AS id, attack_type AS cls, payload AS p, lower(payload) AS l FROM payloads UNION ALL SELECT 'r' || doc_id, NULL, {text}, lower({text}) FROM live),
gc AS ({compact_sql('id, cls', 'gate_texts')}),
gm AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}' for c in LX.COMPACT_FEATURES)} FROM gc WHERE cls = '{BENIGN}'),
ge AS (SELECT id, cls, ({_PARTS}) / {len(LX.COMPACT_FEATURES)} AS err FROM gc g, gm m),
an AS (SELECT id, greatest(0.0, least(1.0, err / (2 * (SELECT quantile_cont(err, {SHARE}) FROM ge WHERE cls = '{BENIGN}')))) AS an FROM ge WHERE cls IS NULL),
bx AS (SELECT id, cls, {_EVIDENCE} AS b FROM ({lexical_sql('id, cls', 'class_texts')})),
bw AS (SELECT cls, ln(count(*) + 1) - ln((SELECT count(*) FROM bx WHERE cls IS NOT NULL) + (SELECT count(DISTINCT cls) FROM bx)) AS pi, {_SHARES} AS t, {_LACKS} AS u FROM bx WHERE cls IS NOT NULL GROUP BY cls),
bl AS (SELECT x.id, w.cls, pi + list_dot_product(b, t) + list_sum(u) - list_dot_product(b, u) AS s FROM bx x, bw w WHERE x.cls IS NULL),
bp AS (SELECT id, cls, s, exp(s - max(s) OVER (PARTITION BY id)) AS z FROM bl),
app AS (SELECT id, 1 - sum(z) FILTER (WHERE cls = '{BENIGN}') / sum(z) AS threat, arg_min(cls, (-s, cls)) AS cls FROM bp GROUP BY id)"""


_LIVE = "(SELECT * FROM request_rows WHERE NOT (" + " OR ".join(f"starts_with(path, '{p}')" for p in K.SKIP_PREFIXES) + "))"
_PAYLOAD = "concat_ws(' ', CASE WHEN body <> '' THEN body END, CASE WHEN path NOT IN ('', '/') THEN path END, 'page=' || q_page || ' q=' || q_q)"
_GATE_TEXT = "CASE WHEN body <> '' THEN body ELSE path || '?page=' || q_page || '&q=' || q_q END"
_SCORE_SQL = f"""WITH live AS (SELECT * FROM {_LIVE}),
{models_sql(_GATE_TEXT, _PAYLOAD)},
texts AS (SELECT live.*, an.an, CASE WHEN an.an > 0.5 THEN greatest(0.0, least(1.0, app.threat)) ELSE 0.0 END AS app, CASE WHEN an.an > 0.5 THEN app.cls ELSE 'clean' END AS app_label
  FROM live JOIN an ON an.id = 'r' || live.doc_id JOIN app ON app.id = 'r' || live.doc_id),
sess AS (SELECT doc_id, row_number() OVER (PARTITION BY ip, g ORDER BY t_us, doc_id) AS session_requests FROM (SELECT *, sum(CASE WHEN p IS NULL OR t_us - p >= 60000000 THEN 1 ELSE 0 END) OVER (PARTITION BY ip ORDER BY t_us, doc_id ROWS UNBOUNDED PRECEDING) AS g
  FROM (SELECT doc_id, ip, t_us, lag(t_us) OVER (PARTITION BY ip ORDER BY t_us, doc_id) AS p FROM live))),
thr AS (SELECT e.doc_id, CASE WHEN e.t_us - t.t_us < 60000000 THEN t.score ELSE 0.0 END AS net FROM live e ASOF LEFT JOIN network_threats t ON e.ip = t.ip AND e.t_us >= t.t_us),
sig AS ({signature_sql(R.RuleBook())}),
sus AS ({_SUSPICION_SQL}),
j AS (SELECT x.*, s.session_requests, thr.net, u.static_rule, u.suspicion_score, u.method, g.decision AS sd, g.score AS ss, g.pattern_group,
  EXISTS (SELECT 1 FROM blacklist b WHERE b.ip = x.ip AND b.blocked_us <= x.t_us AND coalesce(b.expires_us, {W.FOREVER_US}) > x.t_us AND coalesce(b.unblocked_us, {W.FOREVER_US}) > x.t_us) AS bl
  FROM texts x JOIN sess s ON s.doc_id = x.doc_id JOIN thr ON thr.doc_id = x.doc_id JOIN sus u ON u.doc_id = x.doc_id JOIN sig g ON g.doc_id = x.doc_id),
k AS (SELECT *, CASE WHEN bl THEN 'IP blacklisted' WHEN session_requests > {LIMIT} THEN 'Rate limit exceeded' WHEN static_rule IS NOT NULL THEN static_rule WHEN sd = 'MITIGATE' THEN pattern_group END AS stop FROM j),
f AS (SELECT *, stop IS NOT NULL AS short, CASE WHEN stop IS NOT NULL THEN 1.0 ELSE round(0.20 * ss + 0.35 * app + 0.25 * an + 0.20 * net, 4) END AS fs FROM k),
h AS (SELECT *, {sql_action('fs')} AS act, CASE WHEN short OR fs <= 0.05 THEN NULL WHEN app_label NOT IN {sql_in(K.NORMAL_LABELS)} THEN app_label WHEN an > 0.5 THEN 'anomaly' WHEN sd = 'FORWARD_TO_ML' THEN pattern_group ELSE 'unknown' END AS typ FROM f),
ev AS (SELECT ip, t_us, 'application' AS layer, typ FROM h WHERE typ IS NOT NULL UNION ALL SELECT ip, t_us, 'network', attack_type FROM network_threats WHERE score >= 0.35),
c AS (SELECT h.doc_id, count(*) FILTER (WHERE ev.layer = 'network') > 0 AND count(*) FILTER (WHERE ev.layer = 'application') > 0 AS corr,
  greatest(1, count(DISTINCT ev.typ) FILTER (WHERE ev.typ NOT IN {sql_in(K.BENIGN_CORRELATION_TYPES)})) AS n FROM h LEFT JOIN ev ON ev.ip = h.ip AND ev.t_us BETWEEN h.t_us - 10000000 AND h.t_us GROUP BY 1),
m AS (SELECT h.*, corr, n, CASE WHEN corr THEN CASE WHEN n >= 4 THEN 1.7 WHEN n = 3 THEN 1.5 WHEN n = 2 THEN 1.3 ELSE 1.0 END ELSE 1.0 END::DOUBLE AS mult FROM h JOIN c ON c.doc_id = h.doc_id),
a AS (SELECT *, corr AND NOT short AND fs > 0.05 AND round(least(1.0, fs * mult), 3) > round(fs, 3) AS up FROM m)
SELECT doc_id, short AS short_circuited, CAST(floor(round(CASE WHEN up THEN least(1.0, fs * mult) ELSE fs END, 4) * 1000 + 1e-6) AS BIGINT) AS final_permille, coalesce(corr, false) AS correlated, session_requests, stop FROM a"""


def scored_requests(spark, d, models):
    return scoring.score_requests(A.requests(spark, d), A.blacklist(spark, d), A.network_threats(spark, d), models, key="doc_id", limit=LIMIT)


@query("d26_score_requests", _SCORE_SQL)
def _(spark, d):
    out = scored_requests(spark, d, fitted_models(spark, d, "bayes"))
    return out.select("doc_id", "short_circuited", F.floor(F.col("final_score") * 1000 + 1e-6).cast("bigint").alias("final_permille"), "correlated", "session_requests", F.when(F.col("short_circuited"), F.col("block_reason")).alias("stop"))


@query("d26_score_requests_forest")
def _(spark, d):
    """The same job with principal axes behind the gate and the forest as classifier."""
    out = scored_requests(spark, d, fitted_models(spark, d, "forest", axes=8))
    return out.select("doc_id", "final_score", "action", "short_circuited", "deep_anomaly", "app_lgbm_score", "best_label")


_CLEAN = f"WITH f AS ({FINITE_SQL}), cap AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.999) AS {c}" for c in K.RATE_FEATURES) + f""" FROM f),
r AS (SELECT row_id, coalesce({sql_case('raw_label', K.KNOWN_LABELS)}, CASE WHEN raw_label IN {sql_in(K.NOVEL_LABELS)} THEN 'novel' END) AS label,
round(least(f.flow_pkts_per_sec, cap.flow_pkts_per_sec)::FLOAT::DOUBLE, 3) AS flow_pkts_per_sec, greatest(init_win_fwd, 0)::FLOAT::DOUBLE AS init_win_fwd FROM f, cap)"""


@query("b02_corpus_known", _CLEAN + f""" SELECT row_id, label AS unified_label, flow_pkts_per_sec, round(init_win_fwd, 3) AS init_win_fwd FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {sql_hash('row_id')}, row_id) AS rk FROM r)
WHERE label <> 'novel' AND (label <> 'benign' OR rk <= (SELECT 3 * count(*) FROM r WHERE label NOT IN ('novel', 'benign')))""")
def _(spark, d):
    known = corpus.build_corpus(A.raw_flows(spark, d))["known"]
    return known.select("row_id", "unified_label", F.round(F.col("flow_pkts_per_sec").cast("double"), 3).alias("flow_pkts_per_sec"), F.round(F.col("init_win_fwd").cast("double"), 3).alias("init_win_fwd"))
