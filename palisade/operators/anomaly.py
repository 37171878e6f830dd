"""Anomaly statistics: covariance, Mahalanobis distance, PCA reconstruction, isolation forest, score fusion.

Only d x d matrices and trees of bounded size reach the driver. Rows are scored in Arrow batches with
numpy; feature vectors are plain ``array<double>`` columns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.functions.scores import clamp
from palisade.operators.evaluate import auc_of_counts
from palisade.operators.scale import percentile_values

DOUBLES = T.ArrayType(T.DoubleType())


def vector(feats: list[str]) -> Column:
    return F.array(*[F.col(f"`{f}`").cast("double") for f in feats])


# -- covariance and Mahalanobis ------------------------------------------------------------------------

@dataclass
class Gaussian:
    mean: np.ndarray
    cov: np.ndarray
    inv: np.ndarray
    ceiling: float | None = None


def moments(df: DataFrame, vec: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, mean and sample covariance of an array column.

    Means come from one aggregate. Centred products are summed inside each task and leave it as one
    array, so d*d numbers per task are shuffled.
    """
    size = df.select(F.size(vec).alias("d")).first()["d"]
    m = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(vec)[i]).alias(f"m{i}") for i in range(size)]).first()
    mean = np.array([m[f"m{i}"] for i in range(size)], dtype=float)

    def products(batches):
        total = np.zeros((size, size))
        for pdf in batches:
            if len(pdf):
                x = np.vstack(pdf[vec].to_numpy()) - mean
                total += x.T @ x
        yield pd.DataFrame({"s": [total.ravel().tolist()]})

    parts = df.select(vec).mapInPandas(products, "s array<double>")
    cells = parts.select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    cov = np.zeros(size * size)
    for r in cells:
        cov[r["i"]] = r["v"]
    return m["n"], mean, cov.reshape(size, size) / max(1, m["n"] - 1)


def fit_gaussian(benign: DataFrame, vec: str, ridge: float = 1e-6) -> Gaussian:
    _, mean, cov = moments(benign, vec)
    cov = cov + np.eye(len(mean)) * ridge
    return Gaussian(mean, cov, np.linalg.inv(cov))


def squared_distance(g: Gaussian, vec: str) -> Column:
    mean, inv = g.mean, g.inv

    @F.pandas_udf(T.DoubleType())
    def dist(v: pd.Series) -> pd.Series:
        x = np.vstack(v.to_numpy()) - mean
        return pd.Series(np.einsum("ij,jk,ik->i", x, inv, x))

    return dist(F.col(vec))


def mahalanobis(df: DataFrame, g: Gaussian, vec: str, form: str = "ceiling", out: str = "mahalanobis") -> DataFrame:
    """Distance under one of four scalings: ``ceiling`` (root over its p99, at most 1), ``squared``,
    ``exp`` (1 - exp(-root/10)) and ``saturated`` (d2 / (d2 + 1e-6))."""
    d2 = df.withColumn("__d2", squared_distance(g, vec))
    root = F.sqrt(F.greatest(F.col("__d2"), F.lit(0.0)))
    forms = {
        "sqrt": root, "squared": F.col("__d2"), "exp": clamp(1.0 - F.exp(-root / 10.0)),
        "saturated": F.col("__d2") / (F.col("__d2") + 1e-6),
        "ceiling": clamp(root / F.lit(g.ceiling or 1.0)),
    }
    return d2.withColumn(out, forms[form]).drop("__d2")


def calibrate(benign: DataFrame, g: Gaussian, vec: str, share: float = 0.99, **kw) -> Gaussian:
    """Set the ceiling to a percentile of benign distances."""
    d = mahalanobis(benign, g, vec, "sqrt", "__m").select("__m")
    return Gaussian(g.mean, g.cov, g.inv, percentile_values(d, ["__m"], [share], **kw)["__m"][0])


# -- PCA and reconstruction ----------------------------------------------------------------------------

@dataclass
class Projection:
    mean: np.ndarray
    components: np.ndarray  # d x k
    explained: np.ndarray


def fit_pca(df: DataFrame, vec: str, k: int = 16, variance: float | None = None) -> Projection:
    """Principal axes of the centred data; ``variance`` picks the smallest k that explains that share."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    size = df.select(F.size(vec).alias("d")).first()["d"]
    m = df.agg(*[F.avg(F.col(vec)[i]).alias(f"m{i}") for i in range(size)]).first()
    mean = np.array([m[f"m{i}"] for i in range(size)], dtype=float)
    centred = F.zip_with(F.col(vec), F.array(*[F.lit(float(x)) for x in mean]), lambda a, b: a - b)
    model = PCA(k=size if variance else min(k, size), inputCol="__v", outputCol="__p").fit(df.select(array_to_vector(centred).alias("__v")))
    explained, pc = np.array(model.explainedVariance.toArray()), model.pc.toArray()
    if variance:
        keep = int(np.searchsorted(np.cumsum(explained), variance) + 1)
        explained, pc = explained[:keep], pc[:, :keep]
    return Projection(mean, pc, explained)


def project(df: DataFrame, p: Projection, vec: str, out: str = "pca") -> DataFrame:
    mean, pc = p.mean, p.components

    @F.pandas_udf(DOUBLES)
    def go(v: pd.Series) -> pd.Series:
        return pd.Series(list((np.vstack(v.to_numpy()) - mean) @ pc))

    return df.withColumn(out, go(F.col(vec)))


def recon_error(df: DataFrame, p: Projection, vec: str, out: str = "recon_error") -> DataFrame:
    """Mean squared error after projecting to the principal axes and back."""
    mean, pc = p.mean, p.components

    @F.pandas_udf(T.DoubleType())
    def mse(v: pd.Series) -> pd.Series:
        x = np.vstack(v.to_numpy()) - mean
        return pd.Series(((x - (x @ pc) @ pc.T) ** 2).mean(axis=1))

    return df.withColumn(out, mse(F.col(vec)))


# -- score fusion ----------------------------------------------------------------------------------------

def fuse_anomaly(df: DataFrame, error: str, distance: str, p99: float, w: float = 0.6, out: str = "anomaly_score") -> DataFrame:
    """Error over its benign p99 (up to 2) and distance, weighted; the result may reach 2."""
    e = clamp(F.col(error) / F.lit(p99 + 1e-8), 0.0, 2.0)
    return df.withColumn(out, clamp(F.lit(w) * e + F.lit(1.0 - w) * F.col(distance), 0.0, 2.0))


def fuse_anomaly_minmax(df: DataFrame, error: str, distance: str, threshold: float, w: float = 0.7, out: str = "anomaly_score") -> DataFrame:
    """Error over its threshold (up to 1) and min-max scaled distance."""
    span = df.agg(F.min(distance).alias("__lo"), F.max(distance).alias("__hi"))
    e = clamp(F.col(error) / F.lit(threshold + 1e-12))
    d = clamp((F.col(distance) - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + 1e-12))
    return df.crossJoin(F.broadcast(span)).withColumn(out, clamp(F.lit(w) * e + F.lit(1.0 - w) * d)).drop("__lo", "__hi")


def fit_score_scalers(benign: DataFrame, models: list[str]) -> dict[str, tuple[float, float]]:
    """Minimum and maximum of each model's score on benign rows."""
    r = benign.agg(*[e for m in models for e in (F.min(m).alias(f"{m}|lo"), F.max(m).alias(f"{m}|hi"))]).first()
    return {m: (r[f"{m}|lo"], r[f"{m}|hi"]) for m in models}


def normalise_scores(df: DataFrame, scalers: dict[str, tuple[float, float]]) -> DataFrame:
    swap = {m: clamp((F.col(m) - F.lit(lo)) / F.lit(hi - lo + 1e-9)).alias(m) for m, (lo, hi) in scalers.items()}
    return df.select(*[swap.get(c, F.col(c)) for c in df.columns])


def weight_grid(n: int, low: float = 0.05, high: float = 0.40, step: float = 0.05) -> list[tuple[float, ...]]:
    """All weight vectors on the grid within bounds that sum to one; equal weights come first."""
    a, b, total = round(low / step), round(high / step), round(1 / step)
    grid = [tuple(round(x * step, 10) for x in c) for c in product(range(a, b + 1), repeat=n) if sum(c) == total]
    return [tuple([1.0 / n] * n), *[g for g in grid if g != tuple([1.0 / n] * n)]]


def learn_weights(df: DataFrame, truth: str, models: list[str], low: float = 0.05, high: float = 0.40, step: float = 0.05, bins: int = 1000) -> DataFrame:
    """Weights of best area under the curve over a grid: one row with the weights and both areas.

    Each task counts its rows in one histogram per candidate, in Arrow batches, and hands on the cells that are not
    empty; so candidates x bins cells a task are shuffled, not candidates x rows. Rows with a null take no part.
    """
    grid = weight_grid(len(models), low, high, step)

    def cells(batches):
        hist = np.zeros((len(grid), 2 * bins), dtype=np.int64)  # even: negatives of a bin, odd: positives
        under: dict[tuple[int, int], int] = {}  # negative scores have no bin of their own
        for pdf in batches:
            y, x = pdf["y"].to_numpy().astype(np.int64), [pdf[f"m{i}"].to_numpy() for i in range(len(models))]
            for c, w in enumerate(grid):
                fused = sum((s * g for s, g in zip(x, w)), np.zeros(len(y)))
                at = np.nan_to_num(np.minimum(np.floor(fused * bins + 1e-9), bins - 1), nan=0.0, neginf=-2.0 ** 63).astype(np.int64)
                if len(at) and at.min() < 0:
                    for cell, kind in zip(at[at < 0].tolist(), y[at < 0].tolist()):
                        under[c, 2 * cell + kind] = under.get((c, 2 * cell + kind), 0) + 1
                hist[c] += np.bincount((2 * at + y)[at >= 0], minlength=2 * bins)
        cand, slot = np.nonzero(hist)
        keys = [*zip(cand.tolist(), slot.tolist()), *under]
        counts = [*hist[cand, slot].tolist(), *under.values()]
        yield pd.DataFrame({"cand": [k[0] for k in keys], "cell": [k[1] // 2 for k in keys], "kind": [k[1] % 2 for k in keys], "n": counts})

    rows = df.select(F.col(truth).alias("y"), *[F.col(m).cast("double").alias(f"m{i}") for i, m in enumerate(models)])
    whole = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in rows.columns)).withColumn("y", (F.col("y") == 1).cast("int"))
    told = whole.mapInPandas(cells, "cand int, cell long, kind int, n long")
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0)).cast("bigint")
    counts = told.groupBy("cand", (F.col("cell") / F.lit(float(bins))).alias("score")).agg(of(1).alias("pos"), of(0).alias("neg"))
    auc = auc_of_counts(counts, ["cand"])
    best = auc.agg(F.max_by(F.struct("cand", "auc"), F.struct("auc", (-F.col("cand")).alias("o"))).alias("b"), F.max(F.when(F.col("cand") == 0, F.col("auc"))).alias("equal_auc"))
    table = F.array(*[F.array(*[F.lit(w) for w in g]) for g in grid])
    return best.select(F.get(table, F.col("b.cand")).alias("weights"), F.col("b.auc").alias("auc"), "equal_auc")


# -- isolation forest --------------------------------------------------------------------------------------

def average_path(n: float) -> float:
    """Average depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


TREE_SCHEMA = "tree int, feature array<int>, cut array<double>, left array<int>, right array<int>, path array<double>"


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> tuple[list, list, list, list, list]:
    feature, cut, left, right, path = [], [], [], [], []

    def node(rows: np.ndarray, depth: int) -> int:
        at = len(feature)
        for store, blank in ((feature, -1), (cut, 0.0), (left, -1), (right, -1), (path, 0.0)):
            store.append(blank)
        sub = x[rows]
        span = sub.max(axis=0) - sub.min(axis=0)
        live = np.flatnonzero(span > 0)
        if depth >= limit or len(rows) <= 1 or len(live) == 0:
            path[at] = depth + average_path(len(rows))
            return at
        f = int(rng.choice(live))
        c = float(sub[:, f].min() + rng.random() * span[f])
        mask = sub[:, f] < c
        if not mask.any() or mask.all():
            path[at] = depth + average_path(len(rows))
            return at
        feature[at], cut[at] = f, c
        left[at] = node(rows[mask], depth + 1)
        right[at] = node(rows[~mask], depth + 1)
        return at

    node(np.arange(len(x)), 0)
    return feature, cut, left, right, path


def fit_iforest(df: DataFrame, vec: str, key: list[str], trees: int = 300, psi: int = 256, seed: int = 42) -> list:
    """Random isolation trees, each grown in its own task on a hash sample of ``psi`` rows.

    A pool of at most about 2 x trees x psi rows is drawn first, so the number of rows offered to the
    trees does not grow with the table; sampling is what the method prescribes.
    """
    n = df.count()
    share = min(1.0, 2.0 * trees * psi / max(1, n))
    part = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << 30)) / F.lit(float(1 << 30))
    pool = df.where(part(*key, F.lit(seed)) < F.lit(share)).select(*key, vec)
    offer = min(1.0, 1.5 * psi / max(1.0, n * share))
    picked = pool.select("*", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).withColumn("__u", part(*key, "tree"))
    picked = picked.where(F.col("__u") < F.lit(offer)).select("tree", "__u", vec)
    limit = math.ceil(math.log2(max(2, psi)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        chosen = pdf.nsmallest(psi, "__u")
        t = int(chosen["tree"].iloc[0])
        out = _grow(np.vstack(chosen[vec].to_numpy()), np.random.default_rng(seed + t), limit)
        return pd.DataFrame({"tree": [t], **{c: [v] for c, v in zip(("feature", "cut", "left", "right", "path"), out)}})

    grown = picked.groupBy("tree").applyInPandas(grow, TREE_SCHEMA).orderBy("tree").collect()
    return [tuple(np.array(r[c]) for c in ("feature", "cut", "left", "right", "path")) for r in grown]


def iforest_score(df: DataFrame, forest: list, vec: str, psi: int = 256, out: str = "isolation") -> DataFrame:
    """2 ** (-mean path / c(psi)): near 1 for rows that are isolated quickly."""
    norm = average_path(psi)

    @F.pandas_udf(T.DoubleType())
    def score(v: pd.Series) -> pd.Series:
        x = np.vstack(v.to_numpy())
        rows = np.arange(len(x))
        total = np.zeros(len(x))
        for feature, cut, left, right, path in forest:
            at = np.zeros(len(x), dtype=int)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go_left = x[rows, np.maximum(f, 0)] < cut[at]
                at = np.where(inner, np.where(go_left, left[at], right[at]), at)
            total += path[at]
        return pd.Series(2.0 ** (-(total / len(forest)) / norm))

    return df.withColumn(out, score(F.col(vec)))
