"""Flow corpus build: capture files to cleaned, routed, balanced data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade import constants as K
from palisade.operators import enrich as EN
from palisade.operators import projections as PR
from palisade.operators import sampling as B
from palisade.operators import scaling as M
from palisade.session import materialize


def clean_flows(raw: DataFrame, label: str = "Label", key: str = "row_id") -> DataFrame:
    """Unified names, finite values only, rates capped at p99.9, nothing negative, single precision."""
    feats = list(K.UNIFIED_FEATURES)
    named = PR.map_columns(raw.withColumn("raw_label", F.trim(label)).drop(label), {u: [s] for u, s in K.UNIFIED_FEATURES.items() if s})
    named = PR.coerce_numeric(PR.ensure_features(named), feats)
    finite = PR.drop_nonfinite(named, feats).select(key, "raw_label", *feats)
    capped = PR.clip(M.cap_upper(finite, K.RATE_FEATURES), feats, low=0.0)
    return capped.select(key, "raw_label", *[F.col(f).cast("float").alias(f) for f in feats])


def build_corpus(raw: DataFrame, key: str = "row_id", ratio: int = 3, novel_cap: int | None = None) -> dict[str, DataFrame]:
    """``known`` (majority reduced), ``benign`` and ``novel`` (at most ``novel_cap`` rows, if given) from one cleaned, stored table."""
    routed = materialize(EN.route(clean_flows(raw, key=key)), "routed")
    known = routed.where(F.col("route").isin("benign", "known"))
    novel = routed.where(F.col("route") == "novel")
    return {
        "known": B.undersample(known, "unified_label", "benign", [key], ratio),
        "benign": routed.where(F.col("route") == "benign"),
        "novel": novel if novel_cap is None else B.cap_rows(novel, [key], novel_cap),
    }
