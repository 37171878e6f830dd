"""Gate and classifier of the request path against numpy, stored and read back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.functions.lexical import COMPACT_FEATURES
from palisade.operators import request_models as RM
from palisade.session import fresh_dir

ATTACKS = ["' UNION SELECT NULL, password FROM users--", "1; DROP TABLE users", "id=1' or '1'='1"]
SCRIPTS = ["<script>alert('x')</script>", "<img src=x onerror=alert(1)>", "javascript:alert(2)"]


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(f"q={i} plain words {'a' * (i % 7)} {i * i}", "norm") for i in range(60)]
    rows += [(f"{ATTACKS[i % 3]} {i}", "sqli") for i in range(15)] + [(f"{SCRIPTS[i % 3]} {i}", "xss") for i in range(15)]
    rows += [(None, "norm"), ("", "norm"), ("no label", None)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, text string, kind string").repartition(4)


def compact_matrix(labelled, where):
    rows = RM.compact(labelled.where(where), "text").orderBy("id").collect()
    return [r["id"] for r in rows], np.array([[r[f"c_{c}"] for c in COMPACT_FEATURES] for r in rows])


@pytest.mark.parametrize("axes", [None, 4])
def test_gate_error(labelled, axes):
    _, x = compact_matrix(labelled, "kind = 'norm'")
    sd = x.std(0, ddof=1)
    scale = np.where(sd > 0, 1 / np.where(sd > 0, sd, 1), 0)
    z = (x - x.mean(0)) * scale
    gate = RM.fit_gate(RM.compact(labelled.where("kind = 'norm'"), "text"), axes)
    ids, every = compact_matrix(labelled, "true")
    want = (every - x.mean(0)) * scale
    if axes:
        v = np.linalg.svd(z, full_matrices=False)[2][:axes].T
        want = want - (want @ v) @ v.T
    got = {r["id"]: r["gate_error"] for r in RM.gate_error(RM.compact(labelled, "text"), gate).collect()}
    assert np.allclose([got[i] for i in ids], (want ** 2).mean(1))


# Naive Bayes takes the five bare "javascript:" texts for normal ones; the forest does not.
@pytest.mark.parametrize("kind,right", [("bayes", 25), ("forest", 30)])
def test_stored_models_score_alike(spark, labelled, kind, right):
    models = RM.fit_request_models(labelled, "text", "kind", kind=kind, share=0.9)
    path = fresh_dir(spark, "models")
    models.save(path)
    cols = ["id", "anomaly_score", "app_score", "app_label"]
    read = lambda m: {r["id"]: r for r in m.score(labelled, F.col("text"), F.col("text")).select(*cols).collect()}
    a, b = read(models), read(RM.RequestModels.load(spark, path))
    assert a == b and len(a) == labelled.count()
    for r in a.values():
        assert 0 <= r["anomaly_score"] <= 1 and 0 <= r["app_score"] <= 1
        if r["anomaly_score"] <= 0.5:
            assert (r["app_score"], r["app_label"]) == (0.0, "clean")
    truth = {r["id"]: r["kind"] for r in labelled.collect()}
    flagged = [r for r in a.values() if r["anomaly_score"] > 0.5 and truth[r["id"]] in ("sqli", "xss")]
    assert len(flagged) == 30 and sum(r["app_label"] == truth[r["id"]] for r in flagged) >= right


def test_bayes_is_its_definition(labelled):
    rows = RM.lexical(labelled.where("kind is not null"), "text")
    model = RM.fit_bayes(rows, "kind")
    got = {r["id"]: r["probs"] for r in RM.predict(rows, model, ["id"]).select("id", F.map_values("class_probs").alias("probs")).collect()}
    data = rows.orderBy("id").collect()
    x = np.array([[r[f"x_{c}"] > 0 for c in RM.EVIDENCE] for r in data], dtype=float)
    y = np.array([r["kind"] for r in data])
    logs = []
    for c in ("norm", "sqli", "xss"):
        n = (y == c).sum()
        t = (x[y == c].sum(0) + 1) / (n + 2)
        logs.append(np.log(n + 1) - np.log(len(y) + 3) + x @ np.log(t) + (1 - x) @ np.log(1 - t))
    p = np.exp(np.array(logs) - np.max(logs, axis=0))
    assert np.allclose([got[r["id"]] for r in data], (p / p.sum(0)).T)


def test_columns_with_clashing_names_stay(labelled):
    models = RM.fit_request_models(labelled, "text", "kind", kind="bayes")
    names = ["length", "entropy", "features", "probability", "prediction", "label_index", "threat", "x_length", "c_entropy", "__text"]
    odd = labelled.select("*", *[F.lit(7).alias(c) for c in names])
    out = models.score(odd, F.col("text"), F.col("text"))
    assert out.columns == [*odd.columns, "anomaly_score", "app_score", "app_label"]
    assert out.where(" AND ".join(f"`{c}` = 7" for c in names)).count() == labelled.count()


def test_edges(spark, labelled):
    models = RM.fit_request_models(labelled, "text", "kind", kind="bayes")
    assert models.score(labelled.limit(0), F.col("text"), F.col("text")).count() == 0
    long = spark.createDataFrame([(1, "<script>" * 50_000), (2, "<script>" * 50_000)], "id long, text string")
    got = models.score(long, F.col("text"), F.col("text")).collect()
    assert got[0]["anomaly_score"] == got[1]["anomaly_score"] == 1.0 and got[0]["app_label"] == "xss"
    with pytest.raises(ValueError):
        RM.fit_request_models(labelled.where("kind = 'sqli'"), "text", "kind", kind="bayes")
    with pytest.raises(ValueError):
        RM.fit_request_models(labelled, "text", "kind", kind="net")
