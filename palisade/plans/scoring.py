"""The whole request path as one job: lookups, static rules, signatures, models, fusion, correlation.

Texts are judged where they are read, in one projection, and dropped; only verdicts, scores and labels
take part in the per-address steps and in the one join by request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import constants as K
from palisade.functions import scores as S
from palisade.operators import fusion as FU
from palisade.operators import projections as PR
from palisade.operators import rules as R
from palisade.operators import temporal as W
from palisade.operators.request_models import RequestModels
from palisade.session import materialize


def judge_texts(requests: DataFrame, models: RequestModels, key: str, book: R.RuleBook | None = None) -> DataFrame:
    """Everything that depends on the request's own text, one row per request and no shuffle.

    The fitted gate scores every request; the classifier counts only for those it flags.
    """
    static = R.static_decision(requests)
    signed = R.signature_filter(static, book, only=F.col("static_rule").isNull())
    scored = models.score(signed, PR.build_payload("anomaly"), PR.build_payload())
    return scored.select(key, "ip", "t_us", "method", "path", "static_rule", "static_reason", "static_decision", "suspicion_contribution", F.col("decision").alias("signature_decision"),
                         F.col("score").alias("signature_score"), F.col("confidence").alias("signature_confidence"), "pattern_group", "pattern", "anomaly_score", "app_score", "app_label")


def layer(name: str, score: Column, label: Column, conf: Column, triggered: Column) -> Column:
    return F.struct(F.lit(name).alias("layer"), F.round(S.clamp(score), 4).alias("score"), label.alias("label"), F.round(S.clamp(conf), 4).alias("confidence"), triggered.alias("triggered"))


def decide(judged: DataFrame) -> DataFrame:
    """Layer list, short circuit, fused score, action and reason from verdicts and lookups."""
    one, zero, no, yes = F.lit(1.0), F.lit(0.0), F.lit(False), F.lit(True)
    stop0 = F.when(F.col("is_blacklisted"), "blacklisted").when(F.col("rate_limited"), "rate_limited").otherwise(F.col("static_rule"))
    why0 = F.when(F.col("is_blacklisted"), "IP blacklisted").when(F.col("rate_limited"), "Rate limit exceeded").otherwise(F.col("static_rule"))
    j = judged.withColumn("stop0", stop0).withColumn("why0", why0)
    j = j.withColumn("stop1", F.col("stop0").isNull() & (F.col("signature_decision") == "MITIGATE"))
    forward = F.col("static_decision") == "FORWARD_TO_ML"
    l0 = (F.when(F.col("stop0").isNotNull(), layer(K.LAYER_STATIC, one, F.col("stop0"), one, yes))
           .when(forward, layer(K.LAYER_STATIC, F.col("suspicion_contribution"), F.lit("suspicious"), F.lit(0.5), no))
           .otherwise(layer(K.LAYER_STATIC, zero, F.lit("clean"), one, no)))
    l1 = (F.when(F.col("stop1"), layer(K.LAYER_REGEX, one, F.col("pattern_group"), one, yes))
           .when(F.col("signature_decision") == "FORWARD_TO_ML", layer(K.LAYER_REGEX, F.col("signature_score"), F.col("pattern_group"), F.col("signature_confidence"), no))
           .otherwise(layer(K.LAYER_REGEX, zero, F.lit("clean"), one, no)))
    l2 = layer(K.LAYER_ANOMALY, F.col("anomaly_score"), F.when(F.col("anomaly_score") > 0.5, "anomaly").otherwise("clean"), F.col("anomaly_score"), no)
    l3 = layer(K.LAYER_CLASSIFIER, F.col("app_score"), F.col("app_label"), F.col("app_score"), no)
    stopped = F.col("stop0").isNotNull() | F.col("stop1")
    layers = F.when(F.col("stop0").isNotNull(), F.array(l0)).when(F.col("stop1"), F.array(l0, l1)).otherwise(F.array(l0, l1, l2, l3))
    j = j.withColumn("layer_scores", layers).withColumn("short_circuited", stopped)
    live = lambda c: F.when(F.col("short_circuited"), 0.0).otherwise(F.col(c))
    j = (j.withColumn("regex_conf", F.when(F.col("stop1"), 1.0).otherwise(live("signature_score"))).withColumn("network_score", live("threat_score"))
          .withColumn("deep_anomaly", live("anomaly_score")).withColumn("app_lgbm_score", live("app_score")).withColumn("net_lgbm_score", F.col("network_score")))
    j = FU.fuse(j)
    j = j.withColumn("final_score", F.when(F.col("short_circuited"), 1.0).otherwise(F.col("fused")))
    j = j.withColumn("action", S.action(F.col("final_score")))
    reason = F.coalesce(F.col("why0"), F.when(F.col("stop1"), F.col("pattern_group")), F.when(F.col("action") == "BLOCK", FU.reason()), F.lit(""))
    return j.withColumn("block_reason", reason).drop("stop0", "why0", "stop1", "fused", "fused_action")


def score_requests(requests: DataFrame, blocks: DataFrame, threats: DataFrame, models: RequestModels,
                   book: R.RuleBook | None = None, key: str = "request_id", limit: int = K.RATE_LIMIT_SESSION, window: int = K.CORRELATION_WINDOW) -> DataFrame:
    """Requests (headers, query_params, body, ip, t_us, ...) to decided events."""
    live = PR.skip_paths(requests)
    judged = judge_texts(live, models, key, book)
    state = W.lookup_state(live.select(key, "ip", "t_us"), blocks, threats, tie=key, limit=limit).drop("ip", "t_us")
    # Stored once: the correlation step reads the verdicts several times, the texts must be judged only once.
    decided = materialize(decide(judged.join(state, key)), "verdicts")

    part = ~F.col("short_circuited") & (F.col("final_score") > 0.05)
    app = decided.withColumn("layer", F.when(part, "application")).withColumn("type", F.when(part, PR.last_label())).withColumn("__app", F.lit(True))
    net = threats.where(F.col("score") >= K.NETWORK_THREAT_FLOOR).select("ip", "t_us", F.lit("network").alias("layer"), F.col("attack_type").alias("type"), F.lit(False).alias("__app"))
    seen = W.trailing_sets(app.unionByName(net, allowMissingColumns=True), window).where("__app")
    out = FU.apply_correlation(W.amplify(seen, "final_score"), short="short_circuited")
    return out.select(key, "ip", "t_us", "method", "path", F.col("new_score").alias("final_score"), F.col("new_action").alias("action"), F.col("new_reason").alias("block_reason"), "short_circuited",
                      "network_score", "regex_conf", "app_lgbm_score", "deep_anomaly", "session_requests", "correlated", "layer_scores", F.col("action").alias("first_action")) \
              .withColumn("best_label", PR.best_label())
