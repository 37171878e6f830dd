"""The two models of the request path as stored Spark ML pipelines: an anomaly gate and the classifier behind it.

Both read features of the payload text that are computed in one projection, so scoring is a projection too:
no row moves and no text is read twice. What is shipped to the tasks are coefficients or trees of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import PCA, Binarizer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import scores as S
from palisade.functions.lexical import COMPACT_FEATURES, LEXICAL_FEATURES, lexical_features, payload_features
from palisade.operators.models import fit_classifier, predict
from palisade.operators.scale import percentile_values
from palisade.session import materialize

#: Lexical features that say what occurs in a text; the first twelve are sizes, ratios and the entropy.
EVIDENCE = LEXICAL_FEATURES[12:]


def compact(df: DataFrame, text: str) -> DataFrame:
    """Append the compact features of a text column as doubles, prefix ``c_``; NULL counts as empty text."""
    t = payload_features(df.select(F.struct("*").alias("__row"), F.col(text).alias("__text")), "__text")
    return t.select("__row.*", *[F.col(c).cast("double").alias(f"c_{c}") for c in COMPACT_FEATURES])


def lexical(df: DataFrame, text: str, names: list[str] = LEXICAL_FEATURES) -> DataFrame:
    """Append the lexical features (or those named) of a text column as doubles, prefix ``x_``; NULL counts as empty text."""
    t = lexical_features(df.select(F.struct("*").alias("__row"), F.col(text).alias("__text")), "__text")
    return t.select("__row.*", *[F.col(c).cast("double").alias(f"x_{c}") for c in names])


# -- anomaly gate ------------------------------------------------------------------------------------

def fit_gate(benign: DataFrame, axes: int | None = None) -> PipelineModel:
    """Scaling of the compact features by benign rows and, with ``axes``, their principal axes."""
    stages = [VectorAssembler(inputCols=[f"c_{c}" for c in COMPACT_FEATURES], outputCol="__compact", handleInvalid="keep"),
              StandardScaler(inputCol="__compact", outputCol="__scaled", withMean=True, withStd=True)]
    if axes:
        stages.append(PCA(k=min(axes, len(COMPACT_FEATURES)), inputCol="__scaled", outputCol="__axes"))
    return Pipeline(stages=stages).fit(benign)


def _squares(vec: str) -> Column:
    return F.aggregate(vector_to_array(vec), F.lit(0.0), lambda a, x: a + x * x)


def gate_error(df: DataFrame, gate: PipelineModel, out: str = "gate_error") -> DataFrame:
    """Mean square of what the axes do not explain (of all of it when the gate has no axes).

    The axes are orthonormal and the data centred, so the residue is the difference of two sums of squares.
    """
    told = gate.transform(df)
    residue = _squares("__scaled") - (_squares("__axes") if "__axes" in told.columns else F.lit(0.0))
    return told.withColumn(out, F.greatest(F.lit(0.0), residue) / F.lit(float(len(COMPACT_FEATURES)))).drop("__compact", "__scaled", "__axes")


# -- classifier --------------------------------------------------------------------------------------

def fit_forest(rows: DataFrame, label: str, trees: int = 50, depth: int = 10, seed: int = 42) -> PipelineModel:
    """Random forest over all lexical features, classes weighted by their frequency."""
    return fit_classifier(rows, [f"x_{c}" for c in LEXICAL_FEATURES], label, trees=trees, depth=depth, seed=seed)


def fit_bayes(rows: DataFrame, label: str, smoothing: float = 1.0) -> PipelineModel:
    """Naive Bayes over which pieces of evidence occur: one aggregate over the rows, coefficients in closed form."""
    stages = [StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="skip"),
              VectorAssembler(inputCols=[f"x_{c}" for c in EVIDENCE], outputCol="__counts", handleInvalid="keep"),
              Binarizer(inputCol="__counts", outputCol="features", threshold=0.0),
              NaiveBayes(labelCol="label_index", modelType="bernoulli", smoothing=smoothing)]
    return Pipeline(stages=stages).fit(rows)


# -- both --------------------------------------------------------------------------------------------

@dataclass
class RequestModels:
    """Gate, its threshold (the error whose score is 0.5) and classifier."""

    gate: PipelineModel
    threshold: float
    classifier: PipelineModel

    def save(self, path: str) -> None:
        """Store both pipelines and the threshold below ``path``, a folder every executor reaches."""
        self.gate.write().overwrite().save(f"{path}/gate")
        self.classifier.write().overwrite().save(f"{path}/classifier")
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(float(self.threshold),)], "threshold double").write.mode("overwrite").parquet(f"{path}/threshold")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "RequestModels":
        threshold = spark.read.schema("threshold double").parquet(f"{path}/threshold").first()["threshold"]
        return cls(PipelineModel.load(f"{path}/gate"), threshold, PipelineModel.load(f"{path}/classifier"))

    def score(self, df: DataFrame, gate_text: Column, text: Column) -> DataFrame:
        """Append ``anomaly_score``, ``app_score`` and ``app_label``; all other columns stay, whatever their names.

        Rows the gate lets pass hand an empty text to the classifier's features and are "clean" with score 0.
        """
        t = compact(df.select(F.struct("*").alias("__kept"), gate_text.alias("__gate"), text.alias("__payload")), "__gate")
        t = gate_error(t, self.gate, "__error").select("__kept", "__payload", S.threshold_score(F.col("__error"), self.threshold).alias("anomaly_score"))
        flagged = F.col("anomaly_score") > 0.5
        t = lexical(t.select("__kept", "anomaly_score", F.when(flagged, F.col("__payload")).alias("__suspect")), "__suspect")
        t = predict(t, self.classifier, ["__kept", "anomaly_score"])
        return t.select("__kept.*", "anomaly_score", F.when(flagged, F.col("threat")).otherwise(0.0).alias("app_score"), F.when(flagged, F.col("pred_label")).otherwise("clean").alias("app_label"))


def fit_request_models(labelled: DataFrame, payload: str, label: str, benign: str = "norm", kind: str = "forest", axes: int | None = None, share: float = 0.99) -> RequestModels:
    """Fit gate and classifier on labelled payloads. Rows without a label take no part.

    ``kind`` is "forest" or "bayes"; ``share`` is the part of the benign rows that stays under the threshold.
    The features are stored once: texts are read by one projection, the fits read numbers.
    """
    if kind not in ("forest", "bayes"):
        raise ValueError(f"unknown kind of classifier: {kind}")
    known = labelled.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.col(payload).alias("text"))
    names = LEXICAL_FEATURES if kind == "forest" else EVIDENCE  # only what the classifier reads is computed
    rows = materialize(lexical(compact(known, "text"), "text", names).drop("text"), "payload-features")
    normal = rows.where(F.col("label") == benign)
    if normal.isEmpty():
        raise ValueError(f"no payload is labelled {benign}")
    gate = fit_gate(normal, axes)
    threshold = percentile_values(gate_error(normal, gate).select("gate_error"), ["gate_error"], [share])["gate_error"][0]
    if not threshold:
        raise ValueError("the gate needs benign rows that differ")
    return RequestModels(gate, threshold, (fit_forest if kind == "forest" else fit_bayes)(rows, "label"))
