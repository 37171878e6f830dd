"""Score fusion, gating and response decisions. All projections; nothing here moves rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import constants as K
from palisade.functions import scores as S


def z(col: Column) -> Column:
    return F.coalesce(col, F.lit(0.0))


def fuse(df: DataFrame) -> DataFrame:
    """Append ``fused`` and ``fused_action`` from the four flat layer scores."""
    score = S.fuse(F.col("regex_conf"), F.col("app_lgbm_score"), F.col("deep_anomaly"), F.col("net_lgbm_score"))
    return df.withColumn("fused", score).withColumn("fused_action", S.action(F.col("fused")))


def hard_block(df: DataFrame) -> DataFrame:
    """A triggered layer (or an earlier short circuit) overrides fusion: score 1, BLOCK, its reason."""
    first = F.get(F.filter("layer_scores", lambda s: s["triggered"]), F.lit(0))
    blocked = F.exists("layer_scores", lambda s: s["triggered"]) | F.coalesce(F.col("short_circuited"), F.lit(False))
    return (df.withColumn("hard_blocked", blocked)
              .withColumn("decided_score", F.when(F.col("hard_blocked"), 1.0).otherwise(F.col("fused")))
              .withColumn("decided_action", F.when(F.col("hard_blocked"), "BLOCK").otherwise(F.col("fused_action")))
              .withColumn("decided_layer", F.when(F.col("hard_blocked"), F.coalesce(first["layer"], F.lit("Layer0")))))


def reason(layers: Column | str = "layer_scores") -> Column:
    """Text naming the strongest layer above one half (the first of equals)."""
    col = F.col(layers) if isinstance(layers, str) else layers
    strong = F.filter(col, lambda s: s["score"] > 0.5)
    top = F.aggregate(strong, F.get(strong, F.lit(0)), lambda acc, s: F.when(s["score"] > acc["score"], s).otherwise(acc))
    return F.when(F.size(strong) > 0, F.format_string("Detected %s (layer=%s, score=%.2f)", top["label"], top["layer"], top["score"])).otherwise("Clean traffic")


def fuse_enabled(df: DataFrame, enabled: dict[str, bool]) -> DataFrame:
    """Fusion over the enabled layers only, weights scaled back to one."""
    weights = {"regex_conf": K.WEIGHT_REGEX, "app_lgbm_score": K.WEIGHT_CLASSIFIER,
               "deep_anomaly": K.WEIGHT_ANOMALY, "net_lgbm_score": K.WEIGHT_NETWORK}
    on = {c: w for c, w in weights.items() if enabled.get(c, True)}
    total = sum(on.values())
    score = F.lit(0.0)
    for c, w in on.items():
        score = score + F.lit(w / total) * z(F.col(c))
    return df.withColumn("fused", S.round4(S.clamp(score))).withColumn("fused_action", S.action(F.col("fused")))


def fuse_network(df: DataFrame, classifier: str = "lgbm_score", ensemble: str = "ensemble_score") -> DataFrame:
    """Flow verdict from classifier and anomaly ensemble; a missing model leaves the other alone."""
    a, b = F.col(classifier), F.col(ensemble)
    fused = (F.when(a.isNotNull() & b.isNotNull(), K.WEIGHT_NETWORK_CLASSIFIER * a + K.WEIGHT_NETWORK_ANOMALY * b)
              .otherwise(F.coalesce(a, b, F.lit(0.0))))
    return (df.withColumn("network_fused", S.clamp(fused))
              .withColumn("is_threat", F.col("network_fused") >= K.NETWORK_THREAT_FLOOR)
              .withColumn("network_confidence", F.greatest(z(a), z(b))))


def attack_type(label: Column, ensemble: Column) -> Column:
    benign = F.lower(F.coalesce(label, F.lit("benign"))).isin("benign", "normal", "clean", "norm")
    return F.when(~benign, label).when(z(ensemble) >= 0.5, "ZeroDay").otherwise("clean")


def gated_score(df: DataFrame, scorer, label: str = "anomaly_label", score: str = "anomaly_score") -> DataFrame:
    """Run ``scorer`` (DataFrame to DataFrame adding ``app_score``, ``app_label``) on anomalous rows only.

    A filter and a union, because Python branches inside CASE would be computed for every row.
    """
    gate = F.coalesce(F.col(label).isin("anomaly", "zeroday") | (F.col(score) > 0.5), F.lit(False))
    yes = scorer(df.where(gate)).withColumn("gate", F.lit("scored"))
    no = (df.where(~gate).withColumn("app_score", F.lit(0.0)).withColumn("app_label", F.lit("clean")).withColumn("gate", F.lit("gate_clean")))
    return yes.unionByName(no)


def ensemble(df: DataFrame, scalers: dict[str, tuple[float, float]], weights: dict[str, float], threshold: float | None) -> DataFrame:
    """Min-max normalised models, weights scaled to those present per row, mapped so 0.5 is the threshold.

    Appends ``ensemble_score``, ``is_anomaly``, ``fused_raw`` and a ``models`` map with the breakdown.
    """
    norm = {m: S.clamp((F.col(m) - lo) / F.lit(hi - lo + 1e-9)) for m, (lo, hi) in scalers.items()}
    present = sum((F.when(F.col(m).isNotNull(), F.lit(weights[m])).otherwise(0.0) for m in scalers), F.lit(0.0))
    total = sum((F.when(F.col(m).isNotNull(), F.lit(weights[m]) * norm[m]).otherwise(0.0) for m in scalers), F.lit(0.0))
    raw = F.when(present > 0, total / present).otherwise(0.0)
    out = df.withColumn("fused_raw", raw)
    mapped = S.threshold_score(F.col("fused_raw"), threshold) if threshold else S.clamp(F.col("fused_raw"))
    parts = []
    for m in scalers:
        parts += [F.lit(m), F.struct(F.round(m, 6).alias("raw"), F.round(norm[m], 4).alias("norm"),
                                     F.round(F.lit(weights[m]) / present, 4).alias("weight"), (norm[m] >= 0.5).alias("anomaly"))]
    models = F.map_filter(F.create_map(*parts), lambda _, v: v["raw"].isNotNull())
    return (out.withColumn("ensemble_score", mapped).withColumn("is_anomaly", F.col("ensemble_score") >= 0.5).withColumn("models", models))


def classify(df: DataFrame, probs: str, classes: list[str], benign: list[str] | None = None) -> DataFrame:
    """Class, confidence, class-probability map and threat score (1 - P(benign)) from a probability array."""
    p = F.col(probs)
    names = F.array(*[F.lit(c) for c in classes])
    best = F.array_max(p)
    label = F.element_at(names, F.array_position(p, best).cast("int"))
    normal = next((i for i, c in enumerate(classes) if c in (benign or ["norm", "normal", "benign"])), None)
    threat = S.clamp(1.0 - p[normal]) if normal is not None else F.when(label.isin(K.NORMAL_LABELS), 0.0).otherwise(best)
    return (df.withColumn("pred_label", label).withColumn("confidence", best)
              .withColumn("class_probs", F.map_from_arrays(names, p)).withColumn("threat", threat))


def top_probs(col: Column, k: int = 4) -> Column:
    """The k largest class probabilities, largest first, names breaking ties."""
    pairs = F.transform(F.map_entries(col), lambda e: F.struct((-e["value"]).alias("neg"), e["key"].alias("label"), e["value"].alias("prob")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda s: F.struct(s["label"].alias("label"), s["prob"].alias("prob")))


def apply_correlation(df: DataFrame, score: str = "final_score", act: str = "action", short: str | None = None) -> DataFrame:
    """Decide again after amplification: only live scores, only upward, reason rewritten on a new block."""
    live = F.col("correlated") & (F.col(score) > 0.05) & (F.col("amplified_score") > F.col(score))
    if short:
        live = live & ~F.col(short)
    out = df.withColumn("__up", F.coalesce(live, F.lit(False)))
    out = out.withColumn("new_score", F.when(F.col("__up"), F.col("amplified_score")).otherwise(F.col(score)))
    out = out.withColumn("new_action", F.when(F.col("__up"), S.action(F.col("new_score"))).otherwise(F.col(act)))
    text = F.format_string("cross-pipeline correlation (multiplier=%.1fx, types=%d)", F.col("multiplier"), F.col("distinct_types"))
    return out.withColumn("new_reason", F.when(F.col("__up") & (F.col("new_action") != F.col(act)) & (F.col("new_action") == "BLOCK"), text)
                          .otherwise(F.col("block_reason"))).drop("__up")


def select_threats(df: DataFrame, floor: float = K.ANALYSIS_FLOOR) -> DataFrame:
    """Events worth a deep analysis: high fused score that no early layer already explained."""
    first = F.filter("layer_scores", lambda s: ~F.coalesce(s["label"], F.lit("")).isin(K.BENIGN_EVENT_LABELS))
    shap = F.map_from_entries(F.transform(F.filter("layer_scores", lambda s: s["score"] > 0),
                                          lambda s: F.struct(s["layer"].alias("k"), F.round(s["score"], 4).alias("v"))))
    return df.where((F.col("final_score") >= floor) & ~F.col("short_circuited")).select(
        F.col("request_id").alias("event_id"), "timestamp", F.col("ip").alias("ip_address"), F.col("path").alias("url"), "method",
        F.coalesce("body", F.lit("")).alias("payload"),
        F.coalesce(F.get(first, F.lit(0))["label"], F.lit("unknown")).alias("attack_type"), F.col("action").alias("action_taken"),
        F.struct(F.col("app_lgbm_score").alias("classifier_score"), F.col("deep_anomaly").alias("anomaly_score"),
                 F.col("final_score").alias("fusion_score"), F.lit(1.0).alias("correlation_amplification"), F.col("final_score")).alias("detection_scores"),
        shap.alias("layer_contributions"), F.struct("network_score").alias("correlation_context"))


def derive_blacklist(df: DataFrame, ttl: int = K.TTL_BLACKLIST) -> DataFrame:
    """One temporary block per blocked event; ``upsert_latest`` keeps the last per address."""
    return df.where((F.col("action") == "BLOCK") & (F.coalesce("ip", F.lit("")) != "")).select(
        "ip", F.coalesce(F.nullif("block_reason", F.lit("")), F.lit("blocked")).alias("reason"), F.lit(False).alias("permanent"),
        F.when(F.col("block_reason").contains("correlation"), "correlation").otherwise("auto").alias("source"),
        F.col("ts_us").alias("blocked_us"), (F.col("ts_us") + ttl * 1_000_000).alias("expires_us"), F.lit(None).cast("bigint").alias("unblocked_us"))
