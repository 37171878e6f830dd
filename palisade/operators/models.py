"""Classifiers on pyspark.ml: training, tuning, importances, sweeps and scoring of other corpora."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators.evaluate import per_class
from palisade.operators.fusion import classify
from palisade.operators.sampling import with_weights
from palisade.session import materialize


def assembled(feats: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="skip")


#: Rows a training task reads. A task of a forest gets all trees and returns all their histograms, however few rows it has.
TASK_ROWS = 500_000


def training_rows(df: DataFrame, cols: list[str], alike: bool = False, idle: bool = False) -> DataFrame:
    """The columns a fit reads, stored once and dealt by row count; ``unpersist`` them after the fit.

    A fit reads its rows many times. The joins before it are few partitions, or one a class, after the adaptive planner;
    here a task has at most about ``TASK_ROWS`` rows, and no core is idle. The dealt rows are kept on the disks of the
    executors, or every reading would deal them anew; memory is left to the fit. ``alike`` puts the rows of a task in the
    order of their columns, those of few values first: neighbours then go down the same branches of a tree. ``idle`` leaves
    cores to other fits: tasks are as few as ``TASK_ROWS`` allows.
    """
    rows = materialize(df.select(*[F.col(f"`{c}`") for c in cols]), "training")
    n, *values = rows.agg(F.count(F.lit(1)), *[F.approx_count_distinct(f"`{c}`") for c in cols if alike]).first()
    dealt = rows.repartition(max(1 if idle else 2 * df.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS)))
    if alike:
        dealt = dealt.sortWithinPartitions(*[F.col(f"`{c}`") for _, c in sorted(zip(values, cols))])
    return dealt.persist(StorageLevel.DISK_ONLY)


def fit_classifier(df: DataFrame, feats: list[str], label: str, weighted: bool = True, trees: int = 50, depth: int = 10, seed: int = 42) -> PipelineModel:
    """Random forest over named features; class weights counter imbalance. Labels are indexed alphabetically."""
    rows = training_rows(with_weights(df, label) if weighted else df.withColumn("weight", F.lit(1.0)), [label, *feats, "weight"], alike=True)
    stages = [StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="skip"), assembled(feats),
              RandomForestClassifier(labelCol="label_index", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt")]
    model = Pipeline(stages=stages).fit(rows)
    rows.unpersist()
    return model


def classes_of(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def predict(df: DataFrame, model: PipelineModel, keep: list[str] | None = None) -> DataFrame:
    """Class, confidence, probabilities and threat score per row (the true label need not be there)."""
    out = df
    for stage in model.stages[1:]:
        out = stage.transform(out)
    out = out.withColumn("probs", vector_to_array("probability"))
    out = classify(out, "probs", classes_of(model))
    return out.select(*(keep or df.columns), "pred_label", "confidence", "class_probs", "threat")


def importances(model: PipelineModel, feats: list[str]) -> DataFrame:
    """Feature importance table, largest first."""
    forest = model.stages[-1]
    rows = [(f, float(v)) for f, v in zip(feats, forest.featureImportances.toArray())]
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, gain double").orderBy(F.desc("gain"), "feature")


def top_features(model: PipelineModel, feats: list[str], k: int = 10) -> DataFrame:
    return importances(model, feats).limit(k)


class MacroF1(Evaluator):
    """Plain mean of the per-class F1 (the built-in evaluator only weighs by support)."""

    def __init__(self, label: str = "label_index", prediction: str = "prediction"):
        super().__init__()
        self.label, self.prediction = label, prediction

    def _evaluate(self, dataset: DataFrame) -> float:
        return per_class(dataset, self.label, self.prediction).agg(F.avg("f1")).first()[0] or 0.0

    def isLargerBetter(self) -> bool:  # noqa: N802 - name fixed by the base class
        return True


def grid_search(df: DataFrame, feats: list[str], label: str, grid: dict[str, list] | None = None, folds: int = 3, parallelism: int | None = None, seed: int = 42) -> DataFrame:
    """Cross-validated macro F1 of every grid point, best first; 27 points unless the caller names others.

    Every task of a forest returns the histograms of all trees, so rows lie in as few tasks as ``TASK_ROWS`` allows, and so
    many points are fitted at a time as fill the cores (or ``parallelism``), at most eight: the driver holds their forests.
    """
    grid = grid or {"numTrees": [20, 50, 100], "maxDepth": [5, 8, 12], "minInstancesPerNode": [1, 5, 20]}
    rf = RandomForestClassifier(labelCol="label_index", seed=seed)
    built = ParamGridBuilder()
    for name, values in grid.items():
        built = built.addGrid(rf.getParam(name), values)
    maps = built.build()
    rows = training_rows(df, [label, *feats], alike=True, idle=True)
    parallelism = parallelism or max(1, min(8, df.sparkSession.sparkContext.defaultParallelism // rows.rdd.getNumPartitions()))
    prep = Pipeline(stages=[StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc"), assembled(feats)]).fit(rows)
    cv = CrossValidator(estimator=rf, estimatorParamMaps=maps, evaluator=MacroF1(), numFolds=folds, parallelism=parallelism, seed=seed)
    fitted = cv.fit(prep.transform(rows).select("features", "label_index"))
    rows.unpersist()
    scores = [(*[m[rf.getParam(n)] for n in grid], float(s)) for m, s in zip(maps, fitted.avgMetrics)]
    return df.sparkSession.createDataFrame(scores, ", ".join(f"{n} int" for n in grid) + ", macro_f1 double").orderBy(F.desc("macro_f1"), *grid)


def fit_normality(df: DataFrame, feats: list[str], label: str = "y") -> PipelineModel:
    """Benign-versus-rest model whose score is the probability of not being normal."""
    rows = training_rows(df, [label, *feats])
    model = Pipeline(stages=[assembled(feats), StandardScaler(inputCol="features", outputCol="scaled", withMean=True),
                             LogisticRegression(featuresCol="scaled", labelCol=label, maxIter=50, regParam=1e-3)]).fit(rows)
    rows.unpersist()
    return model


def normality_score(df: DataFrame, model: PipelineModel, keep: list[str], out: str = "abnormality") -> DataFrame:
    return model.transform(df).select(*keep, vector_to_array("probability")[1].alias(out))


def boundary_sweep(model: PipelineModel, base: DataFrame, feats: list[str], grid: dict[str, list[float]]) -> DataFrame:
    """Class and probabilities of baseline rows with one feature at a time set to each grid value."""
    points = [F.struct(F.lit(f).alias("swept"), F.lit(float(v)).alias("value")) for f, vs in grid.items() for v in vs]
    rows = base.select(*[F.col(f"`{f}`") for f in feats], F.explode(F.array(*points)).alias("p"))
    swept = rows.select(F.col("p.swept").alias("swept"), F.col("p.value").alias("value"),
                        *[F.when(F.col("p.swept") == f, F.col("p.value")).otherwise(F.col(f"`{f}`")).alias(f) for f in feats])
    return predict(swept, model, ["swept", "value"])


def cross_evaluate(model: PipelineModel, other: DataFrame, feats: list[str], truth: Column, keep: list[str]) -> DataFrame:
    """Predictions of a model on another corpus whose columns are aligned by name first."""
    from palisade.operators.projections import align_features

    rows = align_features(other.withColumn("__truth", truth), feats, keep=[*keep, "__truth"])
    return predict(rows, model, [*keep, "__truth"]).withColumnRenamed("__truth", "true_label")
