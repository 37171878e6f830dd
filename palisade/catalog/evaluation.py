"""Evaluation reports over scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.catalog.registry import query
from palisade.operators import evaluate as E
from palisade.sources import adapters as A

_MET = "round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1"
_RATES = "round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, " + _MET + ", round(fp / (fp + tn), 6) AS fpr, round(fn / (fn + tp), 6) AS fnr, round(tp / (tp + fn), 6) AS detection_rate"


def counts_sql(test: str, truth: str = "y_true = 1", extra: str = "", src: str = "scored") -> str:
    return f"""SELECT {extra} count(*) FILTER (WHERE {truth} AND {test}) AS tp, count(*) FILTER (WHERE NOT ({truth}) AND {test}) AS fp, count(*) FILTER (WHERE {truth} AND NOT ({test})) AS fn,
count(*) FILTER (WHERE NOT ({truth}) AND NOT ({test})) AS tn FROM {src}"""


def auc_sql(col: str, src: str = "scored", truth: str = "y_true") -> str:
    """Rank-sum with average ranks: independent of the running-sum route taken in Spark."""
    return f"""(SELECT (sum(r) FILTER (WHERE {truth} = 1) - p * (p + 1) / 2) / (p * (c - p)) FROM (SELECT {truth}, rank() OVER (ORDER BY {col}) + (count(*) OVER (PARTITION BY {col}) - 1) / 2 AS r,
sum({truth}) OVER () AS p, count(*) OVER () AS c FROM {src}) GROUP BY p, c)"""


def scored(spark, d):
    return A.scored(spark, d)


@query("e01_confusion", """WITH c AS (SELECT DISTINCT true_label AS l FROM scored UNION SELECT DISTINCT pred_label FROM scored)
SELECT a.l AS true_label, b.l AS pred_label, count(s.row_id) AS n, round(count(s.row_id) / sum(count(s.row_id)) OVER (PARTITION BY a.l), 6) AS share FROM c a CROSS JOIN c b LEFT JOIN scored s ON s.true_label = a.l AND s.pred_label = b.l GROUP BY 1, 2""")
def _(spark, d):
    return E.confusion(scored(spark, d), "true_label", "pred_label")


_PER = """SELECT l AS label, count(*) FILTER (WHERE true_label = l AND pred_label = l) AS tp, count(*) FILTER (WHERE true_label <> l AND pred_label = l) AS fp, count(*) FILTER (WHERE true_label = l AND pred_label <> l) AS fn,
count(*) FILTER (WHERE true_label = l) AS support FROM scored, (SELECT DISTINCT true_label AS l FROM scored UNION SELECT DISTINCT pred_label FROM scored) GROUP BY l"""
_PERM = f"SELECT label, tp, support, tp / (tp + fp) AS p, tp / (tp + fn) AS r, 2.0 * tp / (2 * tp + fp + fn) AS f FROM ({_PER})"


@query("e02_class_report", f"""WITH m AS ({_PERM}) SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM m
UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m""")
def _(spark, d):
    return E.class_report(scored(spark, d), "true_label", "pred_label")


@query("e03_binary_report", f"SELECT tp, fp, fn, tn, {_RATES} FROM ({counts_sql('score > 0.45')})")
def _(spark, d):
    return E.binary_report(scored(spark, d), "y_true", F.col("score") > 0.45)


@query("e04_roc_auc", f"SELECT round({auc_sql('score')}, 6) AS auc")
def _(spark, d):
    return E.roc_auc(scored(spark, d), "y_true", "score").select(F.round("auc", 6).alias("auc"))


_OVR = {"ddos": "ae", "portscan": "occ", "botnet": "iso"}
_OVR_ROWS = " UNION ALL ".join(f"SELECT '{c}' AS label, {auc_sql(s, f'''(SELECT {s}, CAST(true_label = '{c}' AS INTEGER) AS y FROM scored)''', 'y')} AS a" for c, s in _OVR.items())


@query("e04_roc_auc_ovr", f"WITH a AS ({_OVR_ROWS}) SELECT label, round(a, 6) AS auc FROM a UNION ALL SELECT 'macro', round(avg(a), 6) FROM a")
def _(spark, d):
    return E.roc_auc_ovr(scored(spark, d), "true_label", _OVR)


_CURVE = """SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n
FROM (SELECT score, count(*) FILTER (WHERE y_true = 1) AS pos, count(*) FILTER (WHERE y_true <> 1) AS neg FROM scored GROUP BY score)"""


@query("w08_roc_curve", f"SELECT score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tp / p, 6) AS tpr, round(fp / n, 6) AS fpr FROM ({_CURVE})")
def _(spark, d):
    return E.roc_curve(scored(spark, d), "y_true", "score").select("score", "tp", "fp", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@query("e05_threshold_at_fpr", f"""SELECT score AS threshold, round(tp / p, 6) AS tpr, round(fp / n, 6) AS fpr, round(tp / (tp + fp), 6) AS precision, round(2.0 * tp / (tp + fp + p), 6) AS f1 FROM ({_CURVE}) WHERE fp / n >= 0.05 ORDER BY score DESC LIMIT 1""")
def _(spark, d):
    return E.threshold_at_fpr(scored(spark, d), "y_true", "score")


def grid_sql(grid: list[float], op: str, truth: str = "y_true = 1", score: str = "score") -> str:
    pts = ", ".join(f"({g!r}::DOUBLE)" for g in grid)
    return f"""SELECT t AS threshold, count(*) FILTER (WHERE {truth} AND {score} {op} t) AS tp, count(*) FILTER (WHERE NOT ({truth}) AND {score} {op} t) AS fp, count(*) FILTER (WHERE {truth} AND NOT ({score} {op} t)) AS fn,
count(*) FILTER (WHERE NOT ({truth}) AND NOT ({score} {op} t)) AS tn FROM scored, (VALUES {pts}) g(t) GROUP BY t"""


_G10 = [round(0.05 * i, 2) for i in range(1, 11)]


@query("e08_threshold_table", f"""SELECT threshold, tp, fp, fn, tn, precision, recall, f1, fpr, threshold = first_value(threshold) OVER (ORDER BY fx DESC, threshold) AS is_best
FROM (SELECT *, {_MET}, round(fp / (fp + tn), 6) AS fpr, 2.0 * tp / (2 * tp + fp + fn) AS fx FROM ({grid_sql(_G10, '>')}))""")
def _(spark, d):
    return E.threshold_table(scored(spark, d), "y_true", "score")


_G80 = [round(0.10 + 0.01 * i, 2) for i in range(80)]
_E6 = " UNION ALL ".join(f"""SELECT '{c}' AS label, coalesce((SELECT threshold FROM (SELECT *, tp / (tp + fn) AS r, 2.0 * tp / (2 * tp + fp + fn) AS f FROM ({grid_sql(_G80, '>=', f"true_label = '{c}'", s)})) WHERE r >= 0.95 AND f > 0 ORDER BY f DESC, threshold LIMIT 1), 0.5) AS threshold""" for c, s in _OVR.items())


@query("e06_thresholds_at_recall", _E6 + " UNION ALL SELECT 'benign', 0.5::DOUBLE")
def _(spark, d):
    return E.thresholds_at_recall(scored(spark, d), "true_label", {**_OVR, "benign": "vae"})


@query("e07_best_f1_threshold", """WITH b AS (SELECT quantile_cont(score, 0.05) AS a, quantile_cont(score, 0.99) AS z FROM scored), g AS (SELECT a + (z - a) * i / 199 AS t FROM b, (SELECT unnest(generate_series(0, 199)) AS i)),
m AS (SELECT t, count(*) FILTER (WHERE y_true = 1 AND score >= t) AS tp, count(*) FILTER (WHERE y_true <> 1 AND score >= t) AS fp, count(*) FILTER (WHERE y_true = 1 AND score < t) AS fn FROM scored, g GROUP BY t)
SELECT round(t, 9) AS threshold, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, 'optimal_f1' AS method FROM m ORDER BY 2.0 * tp / (2 * tp + fp + fn) DESC, t LIMIT 1""")
def _(spark, d):
    return E.best_f1_threshold(scored(spark, d), "y_true", "score").withColumn("threshold", F.round("threshold", 9))


@query("e09_percentile_threshold", """SELECT quantile_cont(score, 0.95) AS threshold, 0.95::DOUBLE AS percentile, round(avg(score), 6) AS benign_mean, round(stddev_pop(score), 6) AS benign_std, quantile_cont(score, 0.5) AS benign_p50,
quantile_cont(score, 0.95) AS benign_p95, quantile_cont(score, 0.99) AS benign_p99 FROM scored WHERE y_true = 0""")
def _(spark, d):
    return E.percentile_threshold(scored(spark, d), "y_true", "score")


@query("e10_detection_by_type", "SELECT true_label, count(*) AS total, count(*) FILTER (WHERE score > 0.5) AS detected, round(count(*) FILTER (WHERE score > 0.5) / count(*), 6) AS rate FROM scored GROUP BY 1")
def _(spark, d):
    return E.detection_by_type(scored(spark, d), "true_label", "score", 0.5)


@query("e11_error_pairs", "SELECT true_label, pred_label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM scored WHERE true_label <> pred_label GROUP BY 1, 2")
def _(spark, d):
    return E.error_pairs(scored(spark, d), "true_label", "pred_label")


@query("e12_class_accuracy", f"""SELECT label, support, round(support / sum(support) OVER (), 6) AS share, round(r, 6) AS accuracy, round(f, 6) AS f1, CASE WHEN f >= 0.85 THEN 'good' WHEN f >= 0.7 THEN 'fair' ELSE 'poor' END AS status FROM ({_PERM})""")
def _(spark, d):
    return E.class_accuracy(scored(spark, d), "true_label", "pred_label")


@query("e13_score_stats", "SELECT true_label, count(score) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, min(score) AS \"min\", max(score) AS \"max\" FROM scored GROUP BY 1")
def _(spark, d):
    return E.score_stats(scored(spark, d), "true_label", "score")


@query("e14_audit_slices", """SELECT slice, attack_type, count(*) AS n FROM (SELECT attack_type, unnest(list_filter([CASE WHEN payload ILIKE '%union%' AND payload ILIKE '%select%' THEN 'union_select' END, CASE WHEN payload ILIKE '%/api/%' THEN 'api_path' END,
CASE WHEN attack_type = 'norm' AND contains(payload, '''') AND regexp_matches(payload, '(?i)SELECT|UNION|INSERT') THEN 'norm_with_quote_and_sql' END, CASE WHEN attack_type = 'sqli' AND payload ILIKE '%union%' THEN 'sqli_union' END], lambda x: x IS NOT NULL)) AS slice FROM payloads) GROUP BY 1, 2""")
def _(spark, d):
    return E.audit_slices(A.payloads(spark, d))


@query("e15_compare", " UNION ALL ".join(f"SELECT '{n}' AS name, round({auc_sql(c, EQ)}, 6) AS auc, round({auc_sql(c, EQ)} - {auc_sql('eq', EQ)}, 6) AS gain" for EQ in
       ["(SELECT y_true, (ae * 25 + vae * 25 + occ * 25 + iso * 25) / 100 AS eq, (ae * 25 + vae * 15 + occ * 40 + iso * 20) / 100 AS learned FROM scored)"] for n, c in (("equal", "eq"), ("learned", "learned"))))
def _(spark, d):
    mix = lambda a, v, o, i: (F.col("ae") * a + F.col("vae") * v + F.col("occ") * o + F.col("iso") * i) / 100
    df = scored(spark, d).select("y_true", mix(25, 25, 25, 25).alias("equal"), mix(25, 15, 40, 20).alias("learned"))
    return E.compare(df, "y_true", {"equal": "equal", "learned": "learned"})


@query("e15_compare_cuts", """WITH b AS (SELECT quantile_cont(score, 0.05) AS a, quantile_cont(score, 0.99) AS z FROM scored), g AS (SELECT a + (z - a) * i / 199 AS t FROM b, (SELECT unnest(generate_series(0, 199)) AS i)),
m AS (SELECT t, count(*) FILTER (WHERE y_true = 1) AS tp, count(*) FILTER (WHERE y_true = 0) AS fp FROM scored JOIN g ON score >= t GROUP BY t), n AS (SELECT count(*) AS p FROM scored WHERE y_true = 1),
c AS (SELECT 'best_f1' AS name, t FROM (SELECT t FROM m, n ORDER BY 2.0 * tp / (tp + fp + p) DESC, t LIMIT 1) UNION ALL SELECT 'p95', quantile_cont(score, 0.95) FROM scored WHERE y_true = 0),
r AS (SELECT name, t, p, count(*) FILTER (WHERE y_true = 1) AS tp, count(*) FILTER (WHERE y_true = 0) AS fp FROM c JOIN scored ON score >= t, n GROUP BY ALL)
SELECT name, round(t, 9) AS threshold, round(tp / (tp + fp), 6) AS "precision", round(tp / p, 6) AS recall, round(2.0 * tp / (tp + fp + p), 6) AS f1,
round(2.0 * tp / (tp + fp + p) - (SELECT 2.0 * tp / (tp + fp + p) FROM r WHERE name = 'p95'), 6) AS gain FROM r""")
def _(spark, d):
    return E.compare_cuts(scored(spark, d), "y_true", "score").withColumn("threshold", F.round("threshold", 9))


@query("e16_score_histogram", """SELECT true_label, CAST(least(99, floor(score / 0.01)) AS INTEGER) AS bin, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY true_label) * 0.01), 6) AS density FROM scored GROUP BY 1, 2""")
def _(spark, d):
    return E.score_histogram(scored(spark, d), "true_label", "score")


_MODELS = ["ae", "vae", "occ", "iso"]


@query("e17_leaderboard", " UNION ALL ".join(f"""SELECT '{m}' AS model, cut AS threshold, tp, fp, fn, tn, {_RATES}, round({auc_sql(m)}, 6) AS auc FROM (SELECT q AS cut, tp, fp, fn, tn FROM ({counts_sql(f'{m} > q', src=f"scored, (SELECT quantile_cont({m}, 0.95) AS q FROM scored WHERE y_true = 0) GROUP BY q", extra='q,')}))""" for m in _MODELS))
def _(spark, d):
    return E.leaderboard(scored(spark, d), "y_true", _MODELS)


@query("e18_score_summary", """SELECT count(*) AS n_rows, count(*) FILTER (WHERE score > 0.5) AS anomalies, round(count(*) FILTER (WHERE score > 0.5) / count(*), 6) AS share, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std,
min(score) AS "min", max(score) AS "max", round(count(*) FILTER (WHERE (score > 0.5) = (y_true = 1)) / count(*), 6) AS accuracy FROM scored""")
def _(spark, d):
    return E.score_summary(scored(spark, d).withColumn("is_anomaly", F.col("score") > 0.5), "score", "is_anomaly", "y_true")
