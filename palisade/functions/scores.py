"""Score arithmetic shared by batch and streaming jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade import constants as K


def clamp(col: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Into [low, high]; NULL stays NULL (``greatest`` alone would skip it)."""
    return F.when(col.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), col)))


def round4(col: Column) -> Column:
    return F.round(col, 4)


def action(score: Column) -> Column:
    """Graduated response of a fused score."""
    out = None
    for name, floor in K.ACTION_FLOORS:
        out = F.when(score >= floor, name) if out is None else out.when(score >= floor, name)
    return out.otherwise(K.ACTION_DEFAULT)


def fuse(regex: Column, classifier: Column, anomaly: Column, network: Column) -> Column:
    """Weighted sum of the four layers; a missing layer scores zero."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    total = (K.WEIGHT_REGEX * z(regex) + K.WEIGHT_CLASSIFIER * z(classifier)
             + K.WEIGHT_ANOMALY * z(anomaly) + K.WEIGHT_NETWORK * z(network))
    return round4(clamp(total))


def confidence_to_score(conf: Column) -> Column:
    return (F.when(conf >= 1.0, F.lit(1.0)).when(conf <= 0.6, F.lit(0.2))
             .otherwise(F.round(F.lit(0.2) + (conf - 0.6) * 2.0, 3)))


def threshold_score(error: Column, threshold: Column | float) -> Column:
    """0.5 exactly at the threshold, 1 from twice the threshold on."""
    return clamp(error / (F.lit(2.0) * threshold))


def multiplier(distinct_types: Column) -> Column:
    out = F.when(distinct_types >= 4, F.lit(K.CORRELATION_MULTIPLIER_MAX))
    for n, m in K.CORRELATION_MULTIPLIERS.items():
        out = out.when(distinct_types == n, F.lit(m))
    return out.otherwise(F.lit(1.0))
