"""Anomaly statistics, models and synthetic rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade import constants as K
from palisade.catalog.registry import query
from palisade.operators import anomaly as AN
from palisade.operators import evaluate as E
from palisade.operators import models as MD
from palisade.operators import smote as SM
from palisade.operators.sampling import stratified_split
from palisade.operators.scale import percentile_values
from palisade.session import materialize
from palisade.sources import adapters as A

FEATS = K.FLOW_FEATURES
FOUR = ["ae", "vae", "occ", "iso"]


def flow_vectors(spark, d, feats=None):
    df = A.flow_table(spark, d)
    return df.select("flow_id", "label", F.when(F.col("label") == "benign", 0).otherwise(1).alias("y"), AN.vector(feats or FEATS).alias("v"))


def embeddings(spark, d):
    e = A.table(spark, d, "embeddings")
    return e.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


_TWO = ["packet length mean", "flow packets/s"]
_D2 = """WITH b AS (SELECT avg("packet length mean") AS mx, avg("flow packets/s") AS my, var_samp("packet length mean") + 1e-6 AS sxx, var_samp("flow packets/s") + 1e-6 AS syy,
covar_samp("packet length mean", "flow packets/s") AS sxy FROM flow_table WHERE label = 'benign'),
d AS (SELECT flow_id, label, (syy * dx * dx - 2 * sxy * dx * dy + sxx * dy * dy) / (sxx * syy - sxy * sxy) AS d2 FROM (SELECT flow_id, label, "packet length mean" - mx AS dx, "flow packets/s" - my AS dy, sxx, syy, sxy FROM flow_table, b))"""


@query("m07_mahalanobis", _D2 + """ SELECT flow_id, round(sqrt(d2), 5) AS root, round(d2, 5) AS squared, round(1 - exp(-sqrt(d2) / 10), 6) AS expo, round(d2 / (d2 + 1e-6), 6) AS saturated,
round(least(1.0, sqrt(d2) / (SELECT quantile_cont(sqrt(d2), 0.99) FROM d WHERE label = 'benign')), 6) AS ceiling FROM d""")
def _(spark, d):
    df = flow_vectors(spark, d, _TWO)
    benign = df.where("y = 0")
    g = AN.calibrate(benign, AN.fit_gaussian(benign, "v"), "v")
    out = AN.mahalanobis(df, g, "v", "squared", "squared")
    root = F.sqrt(F.greatest(F.col("squared"), F.lit(0.0)))
    return out.select("flow_id", F.round(root, 5).alias("root"), F.round("squared", 5).alias("squared"), F.round(1 - F.exp(-root / 10), 6).alias("expo"),
                      F.round(F.col("squared") / (F.col("squared") + 1e-6), 6).alias("saturated"), F.round(F.least(F.lit(1.0), root / F.lit(g.ceiling)), 6).alias("ceiling"))


@query("m07_mahalanobis_embeddings")
def _(spark, d):
    df = embeddings(spark, d)
    g = AN.calibrate(df, AN.fit_gaussian(df, "v"), "v")
    return AN.mahalanobis(df, g, "v", "ceiling").select("vec_id", "label", F.round("mahalanobis", 4).alias("mahalanobis"))


@query("m06_pca")
def _(spark, d):
    df = embeddings(spark, d)
    p = AN.fit_pca(df, "v", 16)
    return AN.project(df, p, "v").select("vec_id", F.transform("pca", lambda x: F.round(F.abs(x), 4)).alias("pca"))


@query("m08_recon_error")
def _(spark, d):
    df = embeddings(spark, d)
    p = AN.fit_pca(df.where("label < 8"), "v", variance=0.95)
    return AN.recon_error(df, p, "v").select("vec_id", "label", F.round("recon_error", 6).alias("recon_error"))


@query("m09_isolation_forest")
def _(spark, d):
    df = embeddings(spark, d)
    forest = AN.fit_iforest(df, "v", ["vec_id"])
    return AN.iforest_score(df, forest, "v").select("vec_id", "label", F.round("isolation", 4).alias("isolation"))


@query("m10_normality")
def _(spark, d):
    df = A.flow_table(spark, d).withColumn("y", F.when(F.col("label") == "benign", 0.0).otherwise(1.0))
    out = MD.normality_score(df, MD.fit_normality(df, FEATS), ["flow_id", "y"])
    return E.roc_auc(out, "y", "abnormality").select(F.round("auc", 4).alias("auc"))


_SPAN = "(SELECT min(dist) AS lo, max(dist) AS hi FROM r)"
_ROWS = "WITH r AS (SELECT row_id, y_true, ae AS err, floor(occ * 1000) / 100 AS dist FROM scored)"


@query("m14_fuse_anomaly", _ROWS + f""", q AS (SELECT quantile_cont(err, 0.99) AS p99 FROM r WHERE y_true = 0)
SELECT row_id, round(least(2.0, 0.6 * least(2.0, err / (p99 + 1e-8)) + 0.4 * least(1.0, dist / 10)), 6) AS gated, round(least(1.0, 0.7 * least(1.0, err / (p99 + 1e-12)) + 0.3 * (dist - lo) / (hi - lo + 1e-12)), 6) AS minmax FROM r, q, {_SPAN}""")
def _(spark, d):
    r = A.scored(spark, d).select("row_id", "y_true", F.col("ae").alias("err"), (F.floor(F.col("occ") * 1000) / 100).alias("dist"))
    p99 = percentile_values(r.where("y_true = 0"), ["err"], [0.99])["err"][0]
    one = AN.fuse_anomaly(r.withColumn("unit", F.least(F.lit(1.0), F.col("dist") / 10)), "err", "unit", p99, out="gated")
    two = AN.fuse_anomaly_minmax(one, "err", "dist", p99, out="minmax")
    return two.select("row_id", F.round("gated", 6).alias("gated"), F.round("minmax", 6).alias("minmax"))


_GRID = AN.weight_grid(4)
_CAND = ", ".join(f"({i}, {g[0]!r}::DOUBLE, {g[1]!r}::DOUBLE, {g[2]!r}::DOUBLE, {g[3]!r}::DOUBLE)" for i, g in enumerate(_GRID))


@query("m15_learn_weights", f"""WITH g(cand, a, b, c, e) AS (VALUES {_CAND}), s AS (SELECT cand, y_true, least(999, floor((ae * a + vae * b + occ * c + iso * e) * 1000 + 1e-9)) AS s FROM scored, g),
h AS (SELECT cand, s, count(*) FILTER (WHERE y_true = 1) AS pos, count(*) FILTER (WHERE y_true = 0) AS neg FROM s GROUP BY 1, 2),
k AS (SELECT cand, pos, neg, sum(neg) OVER (PARTITION BY cand ORDER BY s) - neg AS below FROM h), u AS (SELECT cand, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auc FROM k GROUP BY 1)
SELECT round(a, 4) AS w_ae, round(b, 4) AS w_vae, round(c, 4) AS w_occ, round(e, 4) AS w_iso, round(auc, 6) AS auc, (SELECT round(auc, 6) FROM u WHERE cand = 0) AS equal_auc FROM u JOIN g ON g.cand = u.cand ORDER BY u.auc DESC, u.cand LIMIT 1""")
def _(spark, d):
    w = AN.learn_weights(A.scored(spark, d), "y_true", FOUR)
    return w.select(*[F.round(F.col("weights")[i], 4).alias(f"w_{m}") for i, m in enumerate(FOUR)], F.round("auc", 6).alias("auc"), F.round("equal_auc", 6).alias("equal_auc"))


_HALF = "(SELECT min(ae) AS lo, max(ae) AS hi FROM scored WHERE y_true = 0)"


@query("d19_normalise_scores", f"SELECT row_id, round(greatest(0.0, least(1.0, (ae - lo) / (hi - lo + 1e-9))), 6) AS ae FROM scored, {_HALF}")
def _(spark, d):
    df = A.scored(spark, d).select("row_id", "y_true", "ae")
    out = AN.normalise_scores(df, AN.fit_score_scalers(df.where("y_true = 0"), ["ae"]))
    return out.select("row_id", F.round("ae", 6).alias("ae"))


def trained(spark, d):
    """A forest of the training flows, and all flows with their split: both are stored, as split, fit and what follows read them again and again."""
    flows = materialize(A.flow_table(spark, d).select("flow_id", "label", *[F.col(f"`{f}`") for f in FEATS]), "flows")
    split = materialize(stratified_split(flows, "label", ["flow_id"]), "split")
    return MD.fit_classifier(split.where("split = 'train'"), FEATS, "label"), split


@query("m11_classifier_report")
def _(spark, d):
    model, split = trained(spark, d)
    out = MD.predict(split.where("split = 'test'"), model, ["flow_id", "label"])
    return E.class_report(out, "label", "pred_label")


@query("d21_classify")
def _(spark, d):
    model, split = trained(spark, d)
    return MD.predict(split, model, ["flow_id"]).select("flow_id", "pred_label", F.round("confidence", 4).alias("confidence"), F.round("threat", 4).alias("threat"))


@query("m12_grid_search")
def _(spark, d):
    return MD.grid_search(A.flow_table(spark, d), FEATS, "label")


@query("m13_importances")
def _(spark, d):
    return MD.importances(trained(spark, d)[0], FEATS)


@query("t02_top_features")
def _(spark, d):
    return MD.top_features(trained(spark, d)[0], FEATS)


@query("m16_boundary_sweep")
def _(spark, d):
    model, split = trained(spark, d)
    base = split.where("label = 'benign'").agg(*[F.avg(f"`{f}`").alias(f) for f in FEATS])
    grid = {"flow packets/s": [1, 5, 50, 500], "total fwd packets": [1, 4, 8, 100], "syn flag count": [0, 1, 10, 100]}
    out = MD.boundary_sweep(model, base, FEATS, grid)
    return out.select("swept", "value", "pred_label", F.round("threat", 4).alias("threat"))


@query("m17_cross_evaluate")
def _(spark, d):
    from palisade.functions.labels import map_labels
    model, _split = trained(spark, d)
    raw = A.raw_flows(spark, d)
    truth = map_labels(F.trim("Label"), {**K.KNOWN_LABELS, "DoS Hulk": "ddos", "DoS slowloris": "ddos"}, "benign")
    out = MD.cross_evaluate(model, raw, FEATS, truth, ["row_id"])
    return E.class_report(out, "true_label", "pred_label")


@query("b04_smote")
def _(spark, d):
    out = SM.smote(A.flow_table(spark, d), "label", FEATS, "flow_id")
    return out.groupBy("label", "synthetic").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(f"`{f}`"), 2).alias(f) for f in FEATS])


_GAP = " + ".join(f'(a."{f}" - b."{f}") * (a."{f}" - b."{f}")' for f in FEATS)
_FINITE = " AND ".join(f'isfinite("{f}")' for f in FEATS)


@query("b04_neighbours", f"""WITH n AS (SELECT label, count(*) AS n FROM flow_table GROUP BY 1),
s AS (SELECT * FROM flow_table WHERE label IN (SELECT label FROM n WHERE n < (SELECT max(n) FROM n)) AND {_FINITE}),
p AS (SELECT a.label, a.flow_id, b.flow_id AS neighbour, sqrt({_GAP}) AS d FROM s a JOIN s b ON a.label = b.label AND a.flow_id <> b.flow_id),
r AS (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY d, neighbour) AS pos FROM p)
SELECT label, flow_id, CAST(pos AS INT) AS pos, neighbour, round(d, 3) AS distance FROM r WHERE pos <= 5""")
def _(spark, d):
    flows = A.flow_table(spark, d)
    sizes = flows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    small = sizes.crossJoin(F.broadcast(sizes.agg(F.max("n").alias("top")))).where(F.col("n") < F.col("top"))
    near = SM.k_nearest(flows.join(small.select("label"), "label", "left_semi"), "label", FEATS, "flow_id")
    out = near.select("label", F.col("id").alias("flow_id"), F.posexplode("near").alias("pos", "n"))
    return out.select("label", "flow_id", (F.col("pos") + 1).alias("pos"), F.col("n.id").alias("neighbour"), F.round("n.d", 3).alias("distance"))
