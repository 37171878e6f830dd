"""Imputation, clipping and scaling. Parameters are one row of numbers, learned by one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.operators.scale import percentile_values


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def replace_cols(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else q(c) for c in df.columns])


def fit_impute(train: DataFrame, numeric: list[str], text: list[str] | None = None, **kw) -> dict:
    """Median per numeric column and most frequent value per text column (ties: smallest value)."""
    out: dict = {c: v[0] if v[0] is not None else 0.0 for c, v in percentile_values(train, numeric, [0.5], **kw).items()} if numeric else {}
    for c in text or []:
        top = train.where(q(c).isNotNull()).groupBy(q(c).alias("v")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "v").limit(1).collect()
        out[c] = top[0]["v"] if top else "-1"
    return out


def impute(df: DataFrame, params: dict) -> DataFrame:
    return replace_cols(df, {c: F.coalesce(q(c), F.lit(v)) for c, v in params.items()})


def cap_upper(df: DataFrame, cols: list[str], share: float = 0.999, **kw) -> DataFrame:
    """Cap columns whose maximum is positive at their upper percentile."""
    tops = df.agg(*[F.max(q(c)).alias(c) for c in cols]).first()
    cols = [c for c in cols if tops[c] is not None and tops[c] > 0]
    caps = percentile_values(df, cols, [share], **kw) if cols else {}
    return replace_cols(df, {c: F.when(q(c).isNotNull(), F.least(q(c), F.lit(caps[c][0]))) for c in cols})


def fit_bounds(fit_on: DataFrame, cols: list[str], low: float = 0.01, high: float = 0.99, **kw) -> dict[str, tuple[float, float]]:
    return {c: (v[0], v[1]) for c, v in percentile_values(fit_on, cols, [low, high], **kw).items()}


def winsorize(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Clip every column to bounds learned on benign rows."""
    return replace_cols(df, {c: F.when(q(c).isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), q(c)))) for c, (lo, hi) in bounds.items()})


def fit_standard(fit_on: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation (1 where a column is constant)."""
    r = fit_on.agg(*[e for i, c in enumerate(cols) for e in (F.avg(q(c)).alias(f"m{i}"), F.stddev_pop(q(c)).alias(f"s{i}"))]).first()
    return {c: (r[f"m{i}"], r[f"s{i}"] or 1.0) for i, c in enumerate(cols)}


def standard_scale(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return replace_cols(df, {c: (q(c) - F.lit(m)) / F.lit(s) for c, (m, s) in params.items()})


def fit_minmax(fit_on: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    r = fit_on.agg(*[e for i, c in enumerate(cols) for e in (F.min(q(c)).alias(f"a{i}"), F.max(q(c)).alias(f"b{i}"))]).first()
    return {c: (r[f"a{i}"], r[f"b{i}"]) for i, c in enumerate(cols)}


def minmax_scale(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return replace_cols(df, {c: (q(c) - F.lit(a)) / F.lit((b - a) or 1.0) for c, (a, b) in params.items()})
