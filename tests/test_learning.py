"""Statistics and synthetic rows against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.operators import anomaly as AN
from palisade.operators import smote as SM


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4)) @ np.array([[2, 0, 0, 0], [1, 1, 0, 0], [0, 0, .5, 0], [0, 0, .2, .1]])
    x[-6:] += 12
    df = spark.createDataFrame([(i, "a" if i % 3 else "b", v.tolist()) for i, v in enumerate(x)], "id long, label string, v array<double>").repartition(5)
    return x, df


def test_gaussian(points):
    x, df = points
    n, mean, cov = AN.moments(df, "v")
    assert n == len(x) and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x, rowvar=False))
    g = AN.fit_gaussian(df, "v")
    got = {r["id"]: r["m"] for r in AN.mahalanobis(df, g, "v", "squared", "m").collect()}
    want = np.einsum("ij,jk,ik->i", x - mean, g.inv, x - mean)
    assert np.allclose([got[i] for i in range(len(x))], want)


def test_pca_reconstruction(points):
    x, df = points
    full = AN.fit_pca(df, "v", 4)
    assert max(r["recon_error"] for r in AN.recon_error(df, full, "v").collect()) < 1e-12
    part = AN.fit_pca(df, "v", variance=0.95)
    s = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    assert part.components.shape[1] == int(np.searchsorted(np.cumsum(s) / s.sum(), 0.95) + 1)
    total = sum(r["recon_error"] for r in AN.recon_error(df, part, "v").collect()) * 4
    assert np.isclose(total, s[part.components.shape[1]:].sum())


def test_isolation_forest_finds_outliers(points):
    x, df = points
    forest = AN.fit_iforest(df, "v", ["id"], trees=60, psi=128)
    got = {r["id"]: r["isolation"] for r in AN.iforest_score(df, forest, "v", 128).collect()}
    assert len(forest) == 60 and all(0 < s < 1 for s in got.values())
    assert min(got[i] for i in range(594, 600)) > np.mean([got[i] for i in range(594)])


def test_neighbours_are_exact(points):
    x, df = points
    cols = [f"f{i}" for i in range(4)]
    wide = df.select("id", "label", *[F.col("v")[i].alias(c) for i, c in enumerate(cols)])
    got = {r["id"]: [n["id"] for n in r["near"]] for r in SM.k_nearest(wide, "label", cols, "id", 5, cell_rows=32).collect()}
    for i in range(len(x)):
        same = [j for j in range(len(x)) if j != i and (j % 3 > 0) == (i % 3 > 0)]
        want = sorted(same, key=lambda j: (np.sqrt(((x[i] - x[j]) ** 2).sum()), j))[:5]
        assert np.allclose([((x[i] - x[j]) ** 2).sum() for j in got[i]], [((x[i] - x[j]) ** 2).sum() for j in want])


def nearest_by_brute(rows, k):
    """id -> [(distance, id)] over rows (id, label, vector) with finite vectors."""
    good = [(i, c, np.array(v)) for i, c, v in rows if c is not None and all(x is not None and np.isfinite(x) for x in v)]
    return {i: sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, o, w in good if o == c and j != i)[:k] for i, c, v in good}


def as_table(spark, rows, dims):
    return spark.createDataFrame([(i, c, *[None if x is None else float(x) for x in v]) for i, c, v in rows], "id long, label string, " + ", ".join(f"f{d} double" for d in range(dims))).repartition(5)


def test_neighbours_of_copies_ties_and_gaps(spark):
    rng = np.random.default_rng(7)
    rows = [(i, "hot", (1.0, 2.0, 3.0)) for i in range(300)]  # one vector, many times the size of a cell
    rows += [(1000 + i, "hot", tuple(rng.integers(0, 4, 3).astype(float))) for i in range(200)]  # ties
    rows += [(2000 + i, "zero", (0.0 if i else -0.0, float(rng.random() < .05), 0.0)) for i in range(60)]
    rows += [(3000, "lone", (1.0, 1.0, 1.0)), (3001, "pair", (0.0, 0.0, 0.0)), (3002, "pair", (1e6, 0.0, 0.0))]
    rows += [(4000, "hot", (None, 1.0, 1.0)), (4001, "hot", (float("nan"), 1.0, 1.0)), (4002, "hot", (float("inf"), 1.0, 1.0)), (4003, None, (1.0, 1.0, 1.0))]
    rows += [(5000 + i, "tail", (10.0 ** (i % 12), float(i), -float(i))) for i in range(120)]
    want = nearest_by_brute(rows, 5)
    got = {r["id"]: [(n["d"], n["id"]) for n in r["near"]] for r in SM.k_nearest(as_table(spark, rows, 3), "label", ["f0", "f1", "f2"], "id", 5, cell_rows=16).collect()}
    assert set(got) == set(want)
    for i in want:
        assert [j for _, j in got[i]] == [j for _, j in want[i]] and np.allclose([d for d, _ in got[i]], [d for d, _ in want[i]]), i
    assert SM.k_nearest(as_table(spark, rows, 3).limit(0), "label", ["f0", "f1"], "id").count() == 0


def test_an_outlier_widens_only_its_own_search(spark):
    rng = np.random.default_rng(9)

    def met(n):
        rows = [(i, "c", tuple(rng.random(2))) for i in range(n)] + [(n, "c", (1e9, 1e9))]
        cells = SM.cut_cells(SM.entries(SM.vectors(as_table(spark, rows, 2), "label", ["f0", "f1"], "id"), 5), 2, 64)
        reach = SM._reach(cells, 5).cache()
        assert cells.groupBy("cell").count().agg(F.max("count")).first()[0] <= 64
        return SM.visits(cells, reach, 2).count()

    a, b = met(2000), met(4000)
    assert b < 3 * a and b < 4000 * 4


def test_smote_keeps_rows_without_neighbours(spark):
    rows = [(i, "a", (float(i), 1.0)) for i in range(30)] + [(100 + i, "b", (float(i), 2.0)) for i in range(4)]
    rows += [(200, "b", (None, 2.0)), (201, "lone", (5.0, 5.0)), (202, None, (1.0, 1.0))]
    out = SM.smote(as_table(spark, rows, 2), "label", ["f0", "f1"], "id").cache()
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == {"a": 30, "b": 30, "lone": 1, None: 1}
    assert out.where("not synthetic").count() == len(rows) and all(r["f1"] == 2.0 for r in out.where("synthetic").collect())


def test_smote_balances(points):
    x, df = points
    cols = [f"f{i}" for i in range(4)]
    wide = df.select("id", "label", *[F.col("v")[i].alias(c) for i, c in enumerate(cols)])
    out = SM.smote(wide, "label", cols, "id").cache()
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == {"a": 400, "b": 400}
    lo, hi = x[::3].min(0), x[::3].max(0)
    for r in out.where("synthetic").collect():
        assert all(lo[i] - 1e-9 <= r[c] <= hi[i] + 1e-9 for i, c in enumerate(cols))


def test_weights(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 500)
    rows = [(int(t), float(np.clip(.5 * t + .5 * rng.random(), 0, 1)), float(rng.random()), float(rng.random()), float(rng.random())) for t in y]
    df = spark.createDataFrame(rows, "y int, a double, b double, c double, d double")
    r = AN.learn_weights(df, "y", ["a", "b", "c", "d"]).first()
    assert abs(sum(r["weights"]) - 1) < 1e-9 and all(.05 - 1e-9 <= w <= .40 + 1e-9 for w in r["weights"])
    assert r["weights"][0] == 0.4 and r["auc"] >= r["equal_auc"]


def test_weights_are_counted_inside_the_tasks(spark, monkeypatch):
    """Histograms equal brute force for odd scores, and rows are not multiplied by candidates."""
    seen = {}
    monkeypatch.setattr(AN, "auc_of_counts", lambda counts, by, known=AN.auc_of_counts: known(seen.setdefault("counts", counts), by))
    x = [(1, .9, .1, .2, .3), (0, .2, .9, .1, .1), (1, -3.0, .1, .1, .1), (0, float("inf"), .1, .1, .1), (1, float("nan"), .1, .1, .1), (None, .5, .5, .5, .5), (1, None, .5, .5, .5)]
    df = spark.createDataFrame(x, "y int, a double, b double, c double, d double")
    AN.learn_weights(df, "y", ["a", "b", "c", "d"]).collect()
    want = {}
    for c, w in enumerate(AN.weight_grid(4)):
        for y, *v in x:
            if y is None or None in v:
                continue
            f = 0.0
            for s, g in zip(v, w):
                f += s * g
            cell = 0 if f != f else 999 if f == float("inf") else min(999, int(np.floor(f * 1000 + 1e-9)))
            n = want.setdefault((c, cell / 1000.0), [0, 0])
            n[y] += 1
    assert {(r["cand"], r["score"]): [r["neg"], r["pos"]] for r in seen["counts"].collect()} == want
    assert "Generate" not in seen["counts"]._jdf.queryExecution().toString()


def test_few_pairs_are_measured_exactly(spark):
    """Nearest ids equal brute force over all pairs, ties and copies included, and few pairs are left to measure."""
    rng = np.random.default_rng(8)
    for y in (rng.random((300, 6)) * 10.0 ** rng.integers(-3, 8, 6) + 1e8, np.unique(rng.integers(0, 4, (300, 6)).astype(float), axis=0), np.zeros((1, 6))):
        ids = [sorted(rng.choice(10_000, 3).tolist()) for _ in y]
        x = np.vstack([y[:40], y[:5] + 0.5])
        for row, found in zip(x, SM._nearest(x, y, ids, 5)):
            d = ((row[None, :] - y) ** 2).sum(axis=1) ** 0.5
            assert [(n["d"], n["id"]) for n in found] == sorted((float(d[j]), i) for j in range(len(y)) for i in ids[j])[:6]
    y = rng.random((400, 6))
    assert sum(len(rows) for rows, _ in SM._candidates(y, y, 5)) < 400 * 12


def test_compare_cuts(spark):
    from palisade.operators.evaluate import compare_cuts

    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 400)
    x = np.round(0.4 * y + 0.6 * rng.random(400), 3)
    rows = [(int(t), float(s)) for t, s in zip(y, x)] + [(None, 0.9), (1, None)]
    df = spark.createDataFrame(rows, "y int, s double")
    got = {r["name"]: r for r in compare_cuts(df, "y", "s").collect()}

    def f1(t):
        tp, fp = ((x >= t) & (y == 1)).sum(), ((x >= t) & (y == 0)).sum()
        return 2 * tp / (tp + fp + (y == 1).sum())

    a, b = np.percentile(x, [5, 99])
    best = max(f1(t) for t in np.linspace(a, b, 200))
    p95 = np.percentile(x[y == 0], 95)
    assert np.isclose(got["p95"]["threshold"], p95) and np.isclose(got["p95"]["f1"], f1(p95), atol=1e-6) and got["p95"]["gain"] == 0
    assert np.isclose(got["best_f1"]["f1"], best, atol=1e-6) and np.isclose(got["best_f1"]["gain"], best - f1(p95), atol=2e-6)
    calm = compare_cuts(df.where("y = 0"), "y", "s").collect()
    assert len({r["threshold"] for r in calm}) == 1 and all(r["f1"] == 0 for r in calm)
    assert [(r["threshold"], r["f1"]) for r in compare_cuts(df.limit(0), "y", "s").collect()] == [(None, 0.0)] * 2


def test_training_rows_are_dealt_however_few_classes(spark):
    from palisade.operators import models as MD
    from palisade.operators.sampling import with_weights

    rows = spark.range(4000).selectExpr("if(id % 50 = 0, 'b', 'a') AS label", "CAST(id % 7 AS DOUBLE) AS x").coalesce(1)
    seen = []
    keep, MD.RandomForestClassifier.fit = MD.RandomForestClassifier.fit, lambda self, df, *a: (seen.append(df), keep(self, df, *a))[1]
    try:
        MD.fit_classifier(rows, ["x"], "label", trees=1, depth=1)
    finally:
        MD.RandomForestClassifier.fit = keep
    sizes = [n for n in seen[0].rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect() if n]
    assert len(sizes) >= 8 and sum(sizes) == 4000 and max(sizes) <= 2 * 4000 / len(sizes)
    assert sorted(MD.training_rows(with_weights(rows, "label"), ["label", "x"]).groupBy("label").count().collect()) == [("a", 3920), ("b", 80)]


def test_rows_of_a_forest_lie_beside_alike_ones_and_are_dealt_once(spark):
    from palisade.operators import models as MD

    rows = spark.range(6000).selectExpr("if(id % 50 = 0, 'b', 'a') AS label", "CAST(xxhash64(id) % 3 AS DOUBLE) AS few", "CAST(xxhash64(id, 1) % 900 AS DOUBLE) AS many")
    stored = lambda: set(spark.sparkContext._jsc.getPersistentRDDs())
    seen, kept, before = [], [], stored()
    fit, MD.RandomForestClassifier.fit = MD.RandomForestClassifier.fit, lambda self, df, *a: (
        seen.extend(df.rdd.mapPartitions(lambda p: [[(r["label"], r["few"], r["many"]) for r in p]]).collect()), kept.append(df._jdf.queryExecution().withCachedData().toString()), fit(self, df, *a))[2]
    try:
        model = MD.fit_classifier(rows, ["many", "few"], "label", trees=1, depth=1)
    finally:
        MD.RandomForestClassifier.fit = fit
    assert MD.classes_of(model) == ["a", "b"] and all(part == sorted(part) for part in seen)
    assert sorted(r for part in seen for r in part) == sorted(map(tuple, rows.collect()))
    assert "InMemoryRelation" in kept[0] and stored() == before


def test_trained_reads_the_given_tables_once(spark, small):
    from palisade.catalog.learning import FEATS, trained
    from palisade.operators.sampling import stratified_split
    from palisade.sources import adapters as A

    model, split = trained(spark, small)
    assert split.inputFiles() and not [f for f in split.inputFiles() if "/split-" not in f]
    want = stratified_split(A.flow_table(spark, small), "label", ["flow_id"]).select("flow_id", "label", *[F.col(f"`{f}`") for f in FEATS], "split")
    assert split.columns == want.columns and split.exceptAll(want).isEmpty() and want.exceptAll(split).isEmpty()
