"""Evaluation reports.

Everything ranked runs on counts per distinct score, not on rows; fixed threshold grids are answered
from a histogram over the grid, so no row is ever multiplied by the number of thresholds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions.scores import clamp
from palisade.operators.scale import descending_totals, null_safe_join, percentile_values, score_counts, top_n


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0."""
    return F.when(b != 0, a / b).otherwise(0.0)


def f1_of(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def n_of(test: Column) -> Column:
    return F.count(F.when(test, 1))


# -- class reports -----------------------------------------------------------------------------------

def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Dense confusion matrix with row shares. Everything after the first count has classes^2 rows."""
    counts = df.groupBy(F.col(truth).alias("true_label"), F.col(pred).alias("pred_label")).agg(F.count(F.lit(1)).alias("n"))
    names = counts.select(F.col("true_label").alias("c")).union(counts.select("pred_label")).distinct()
    # classes x classes grid of a few labels, not a join of data rows.
    grid = names.select(F.col("c").alias("true_label")).crossJoin(F.broadcast(names.select(F.col("c").alias("pred_label"))))
    full = grid.join(counts, ["true_label", "pred_label"], "left").na.fill(0, ["n"])
    total = F.sum("n").over(Window.partitionBy("true_label"))
    return full.withColumn("share", F.round(ratio(F.col("n"), total), 6))


def per_class(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """tp, support and predicted count per class from one pass."""
    counts = df.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = counts.select(F.explode(F.array(
        F.struct(F.col("t").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("tp")))).alias("s")).select("s.*")
    out = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return out.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f1_of(F.col("precision"), F.col("recall")))


def class_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Rows per class plus ``accuracy``, ``macro avg`` and ``weighted avg``."""
    c = per_class(df, truth, pred)
    total = F.sum("support")
    w = lambda m: ratio(F.sum(F.col(m) * F.col("support")), total)
    agg = c.agg(total.alias("support"), ratio(F.sum("tp"), total).alias("acc"), *[F.avg(m).alias(f"m_{m}") for m in ("precision", "recall", "f1")],
                *[w(m).alias(f"w_{m}") for m in ("precision", "recall", "f1")])
    row = lambda name, p, r, f: F.struct(F.lit(name).alias("label"), p.alias("precision"), r.alias("recall"), f.alias("f1"), F.col("support"))
    extra = agg.select(F.explode(F.array(row("accuracy", F.col("acc"), F.col("acc"), F.col("acc")), row("macro avg", F.col("m_precision"), F.col("m_recall"), F.col("m_f1")),
                                         row("weighted avg", F.col("w_precision"), F.col("w_recall"), F.col("w_f1")))).alias("r")).select("r.*")
    out = c.select("label", "precision", "recall", "f1", "support").unionByName(extra)
    return out.select("label", *[F.round(m, 6).alias(m) for m in ("precision", "recall", "f1")], "support")


def class_accuracy(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Per-class accuracy, F1 and its status band."""
    c = per_class(df, truth, pred)
    band = F.when(F.col("f1") >= 0.85, "good").when(F.col("f1") >= 0.70, "fair").otherwise("poor")
    total = F.sum("support").over(Window.partitionBy(F.lit(0)))  # one row per class
    return c.select("label", "support", F.round(ratio(F.col("support"), total), 6).alias("share"), F.round("recall", 6).alias("accuracy"), F.round("f1", 6).alias("f1"), band.alias("status"))


def error_pairs(df: DataFrame, truth: str, pred: str, limit: int | None = None) -> DataFrame:
    """Misclassified (true, predicted) pairs with their share of all errors, most frequent first."""
    pairs = df.where(F.col(truth) != F.col(pred)).groupBy(F.col(truth).alias("true_label"), F.col(pred).alias("pred_label")).agg(F.count(F.lit(1)).alias("n"))
    total = pairs.agg(F.sum("n").alias("total"))
    out = pairs.crossJoin(F.broadcast(total)).select("true_label", "pred_label", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))
    out = out.orderBy(F.desc("n"), "true_label", "pred_label")
    return out.limit(limit) if limit else out


def top_confusions(df: DataFrame, truth: str, pred: str, key: str, k: int = 10, pairs: int = 5, samples: int = 3) -> DataFrame:
    """The k most frequent error pairs; for the first few, also the keys of some sample rows."""
    top = error_pairs(df, truth, pred, k)
    shown = top.limit(pairs).select("true_label", "pred_label")
    wrong = df.where(F.col(truth) != F.col(pred)).select(F.col(truth).alias("true_label"), F.col(pred).alias("pred_label"), key)
    rows = top_n(wrong.join(F.broadcast(shown), ["true_label", "pred_label"], "left_semi"), ["true_label", "pred_label"], [F.asc(key)], samples, [key])
    picked = rows.groupBy("true_label", "pred_label").agg(F.array_sort(F.collect_list(key)).alias("samples"))
    return top.join(picked, ["true_label", "pred_label"], "left").orderBy(F.desc("n"), "true_label", "pred_label")


def examples(df: DataFrame, truth: str, pred: str, cls: str, key: str, good: int = 5, bad: int = 3) -> DataFrame:
    """A few right and a few wrong predictions of one class."""
    rows = df.where(F.col(truth) == cls).withColumn("correct", F.col(pred) == cls)
    kept = top_n(rows, ["correct"], [F.asc(key)], max(good, bad), [key])
    return kept.where(F.when(F.col("correct"), F.col("row_rank") <= good).otherwise(F.col("row_rank") <= bad))


# -- binary reports ------------------------------------------------------------------------------------

def rates(df: DataFrame, tp="tp", fp="fp", fn="fn", tn="tn") -> DataFrame:
    a, b, c, d = (F.col(x) for x in (tp, fp, fn, tn))
    out = df.withColumn("accuracy", ratio(a + d, a + b + c + d)).withColumn("precision", ratio(a, a + b)).withColumn("recall", ratio(a, a + c))
    return (out.withColumn("f1", f1_of(F.col("precision"), F.col("recall"))).withColumn("fpr", ratio(b, b + d)).withColumn("fnr", ratio(c, c + a))
               .withColumn("detection_rate", ratio(a, a + c)))


RATES = ["accuracy", "precision", "recall", "f1", "fpr", "fnr", "detection_rate"]


def binary_report(df: DataFrame, truth: str, positive: Column, by: list[str] | None = None) -> DataFrame:
    """Counts and rates of a yes/no decision against 0/1 truth."""
    y, p = F.col(truth) == 1, F.coalesce(positive, F.lit(False))
    g = df.groupBy(*(by or [])).agg(n_of(y & p).alias("tp"), n_of(~y & p).alias("fp"), n_of(y & ~p).alias("fn"), n_of(~y & ~p).alias("tn"))
    return rates(g).select(*(by or []), "tp", "fp", "fn", "tn", *[F.round(m, 6).alias(m) for m in RATES])


def roc_curve(df: DataFrame, truth: str, score: str, by: list[str] | None = None) -> DataFrame:
    """tp, fp, tpr and fpr at every distinct score (ties grouped)."""
    by = by or []
    counts = score_counts(df, truth, score, by)
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    cum = descending_totals(counts, by)
    joined = null_safe_join(cum, totals, by) if by else cum.crossJoin(F.broadcast(totals))
    return joined.withColumn("tpr", ratio(F.col("tp"), F.col("p"))).withColumn("fpr", ratio(F.col("fp"), F.col("n")))


def roc_auc(df: DataFrame, truth: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Exact area under the curve; tied scores count half."""
    return auc_of_counts(score_counts(df, truth, score, by), by)


def auc_of_counts(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The same from ``pos`` and ``neg`` per distinct ``score``."""
    by = by or []
    cum = descending_totals(counts, by)
    # Each positive outranks the negatives strictly below it: those not counted in fp yet.
    g = cum.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"),
                             F.sum(F.col("pos").cast("double") * (F.col("fp") - F.col("neg") / 2.0)).alias("above"))
    auc = F.when((F.col("p") > 0) & (F.col("n") > 0), 1.0 - F.col("above") / (F.col("p").cast("double") * F.col("n")))
    return g.select(*by, auc.alias("auc"))


def roc_auc_ovr(df: DataFrame, truth: str, probs: dict[str, str]) -> DataFrame:
    """One-vs-rest area per class and their plain mean (row ``macro``)."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("label"), (F.col(truth) == c).cast("int").alias("y"), F.col(s).alias("s")) for c, s in probs.items()])).alias("r")).select("r.*")
    per = roc_auc(long, "y", "s", ["label"])
    return per.unionByName(per.agg(F.lit("macro").alias("label"), F.avg("auc").alias("auc"))).select("label", F.round("auc", 6).alias("auc"))


def threshold_at_fpr(df: DataFrame, truth: str, score: str, fpr: float = 0.05) -> DataFrame:
    """Highest threshold whose false-positive rate reaches the target, with its rates."""
    c = roc_curve(df, truth, score).where(F.col("fpr") >= fpr)
    best = c.agg(F.max_by(F.struct("score", "tp", "fp", "p", "n", "tpr", "fpr"), "score").alias("b")).select("b.*")
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), F.col("tpr")
    return best.select(F.col("score").alias("threshold"), F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"), F.round(p, 6).alias("precision"), F.round(f1_of(p, r), 6).alias("f1"))


def grid_counts(df: DataFrame, truth: str, score: str, grid: list[float], by: list[str] | None = None, strict: bool = False) -> DataFrame:
    """tp, fp, fn, tn at every threshold of a fixed ascending grid.

    A row counts for all thresholds up to its score, so it is enough to count rows per grid cell and
    sum the (grid x classes) cells from the top; the rows themselves are aggregated once.
    """
    by = by or []
    s = F.col(score)
    passed = reduce(lambda a, b: a + b, [((s > t) if strict else (s >= t)).cast("int") for t in grid])
    cells = df.where(s.isNotNull()).groupBy(*by, passed.alias("cell")).agg(n_of(F.col(truth) == 1).alias("pos"), n_of(F.col(truth) != 1).alias("neg"))
    hist = cells.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("cell", F.struct("pos", "neg").alias("c")))).alias("h"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    at = lambda i, f: F.aggregate(F.map_entries("h"), F.lit(0).cast("bigint"), lambda acc, e: acc + F.when(e["key"] > i, e["value"][f]).otherwise(0))
    points = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(grid)]))
    out = hist.select(*by, "h", "p", "n", points.alias("g")).select(*by, "p", "n", "g.threshold", at(F.col("g.i"), "pos").alias("tp"), at(F.col("g.i"), "neg").alias("fp"))
    return out.withColumn("fn", F.col("p") - F.col("tp")).withColumn("tn", F.col("n") - F.col("fp")).drop("p", "n")


def threshold_table(df: DataFrame, truth: str, score: str, grid: list[float] | None = None, strict: bool = True) -> DataFrame:
    """Precision, recall, F1 and FPR per threshold; the best F1 (lowest threshold on ties) is marked."""
    grid = grid or [round(0.05 * i, 2) for i in range(1, 11)]
    t = rates(grid_counts(df, truth, score, grid, strict=strict))
    best = t.agg(F.max_by("threshold", F.struct("f1", (-F.col("threshold")).alias("o"))).alias("best"))
    return t.crossJoin(F.broadcast(best)).select("threshold", "tp", "fp", "fn", "tn", *[F.round(m, 6).alias(m) for m in ("precision", "recall", "f1", "fpr")], (F.col("threshold") == F.col("best")).alias("is_best"))


def thresholds_at_recall(df: DataFrame, truth: str, probs: dict[str, str], recall: float = 0.95, benign: str = "benign") -> DataFrame:
    """Per class the threshold of best F1 among those with enough recall (grid .10 to .89), else 0.5."""
    grid = [round(0.10 + 0.01 * i, 2) for i in range(80)]
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("label"), (F.col(truth) == c).cast("int").alias("y"), F.col(s).alias("s")) for c, s in probs.items()])).alias("r")).select("r.*")
    t = rates(grid_counts(long, "y", "s", grid, ["label"]))
    ok = (F.col("recall") >= recall) & (F.col("tp") + F.col("fp") > 0) & (F.col("f1") > 0)
    best = t.groupBy("label").agg(F.max_by("threshold", F.when(ok, F.struct("f1", (-F.col("threshold")).alias("o")))).alias("t"))
    return best.select("label", F.when(F.col("label") == benign, 0.5).otherwise(F.coalesce("t", F.lit(0.5))).alias("threshold"))


def best_f1_threshold(df: DataFrame, truth: str, score: str, k: int = 200, fallback: float = 0.95, **kw) -> DataFrame:
    """Best F1 over ``k`` even candidates between p5 and p99; without attacks, a percentile of benign scores."""
    if df.where(F.col(truth) == 1).limit(1).count() == 0:
        cut = percentile_values(df, [score], [fallback], **kw)[score][0]
        return df.sparkSession.createDataFrame([(None if cut is None else float(cut), "percentile_benign")], "threshold double, method string")
    a, b = percentile_values(df, [score], [0.05, 0.99], **kw)[score]
    grid = [a + (b - a) * i / (k - 1) for i in range(k)]
    t = rates(grid_counts_many(df, truth, score, a, b, k, grid))
    best = t.agg(F.max_by(F.struct("threshold", "f1", "precision", "recall"), F.struct("f1", (-F.col("threshold")).alias("o"))).alias("b")).select("b.*")
    return best.select(F.col("threshold"), F.round("f1", 6).alias("f1"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.lit("optimal_f1").alias("method"))


def grid_counts_many(df: DataFrame, truth: str, score: str, low: float, high: float, k: int, grid: list[float]) -> DataFrame:
    """``grid_counts`` for long even grids: the cell comes from arithmetic plus one exact correction."""
    s, step = F.col(score), (high - low) / (k - 1)
    points = F.array(*[F.lit(g) for g in grid])
    guess = F.greatest(F.lit(0), F.least(F.lit(k - 1), F.floor((s - F.lit(low)) / F.lit(step or 1.0)))).cast("int")
    over = F.when(F.get(points, guess) > s, guess - 1).when(F.get(points, guess + 1) <= s, guess + 1).otherwise(guess)
    cell = F.when(s < F.lit(low), F.lit(-1)).otherwise(over) + 1
    cells = df.where(s.isNotNull()).groupBy(cell.alias("cell")).agg(n_of(F.col(truth) == 1).alias("pos"), n_of(F.col(truth) != 1).alias("neg"))
    # At most k + 1 rows from here on, whatever the input size.
    every = df.sparkSession.range(k + 1).select(F.col("id").cast("int").alias("cell")).join(F.broadcast(cells), "cell", "left").na.fill(0)
    up = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cum = every.select("cell", F.sum("pos").over(up).alias("tp"), F.sum("neg").over(up).alias("fp"), F.sum("pos").over(whole).alias("p"), F.sum("neg").over(whole).alias("n"))
    return cum.where(F.col("cell") > 0).select(F.get(points, F.col("cell") - 1).alias("threshold"), "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"), (F.col("n") - F.col("fp")).alias("tn"))


def percentile_threshold(df: DataFrame, truth: str, score: str, share: float = 0.95, **kw) -> DataFrame:
    """Threshold at a percentile of benign scores, with the distribution it came from."""
    benign = df.where(F.col(truth) == 0)
    cut, p50, p95, p99 = percentile_values(benign, [score], [share, 0.5, 0.95, 0.99], **kw)[score] if share not in (0.5, 0.95, 0.99) else _with(benign, score, share, **kw)
    stats = benign.agg(F.avg(score).alias("m"), F.stddev_pop(score).alias("s"))
    return stats.select(F.lit(cut).alias("threshold"), F.lit(share).alias("percentile"), F.round("m", 6).alias("benign_mean"), F.round("s", 6).alias("benign_std"),
                        F.lit(p50).alias("benign_p50"), F.lit(p95).alias("benign_p95"), F.lit(p99).alias("benign_p99"))


def _with(benign: DataFrame, score: str, share: float, **kw) -> tuple:
    got = dict(zip((0.5, 0.95, 0.99), percentile_values(benign, [score], [0.5, 0.95, 0.99], **kw)[score]))
    return got[share], got[0.5], got[0.95], got[0.99]


def detection_by_type(df: DataFrame, kind: str, score: str, threshold: float) -> DataFrame:
    hit = F.col(score) > threshold
    return df.groupBy(kind).agg(F.count(F.lit(1)).alias("total"), n_of(hit).alias("detected"), F.round(F.avg(hit.cast("double")), 6).alias("rate"))


def score_stats(df: DataFrame, truth: str, score: str) -> DataFrame:
    return df.groupBy(truth).agg(F.count(score).alias("n"), F.round(F.avg(score), 6).alias("mean"), F.round(F.stddev_pop(score), 6).alias("std"), F.min(score).alias("min"), F.max(score).alias("max"))


def score_histogram(df: DataFrame, truth: str, score: str, bins: int = 100, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Counts and density per class and equal-width bin; scores outside are clipped to the ends."""
    width = (high - low) / bins
    cell = F.least(F.lit(bins - 1), F.floor((clamp(F.col(score), low, high) - low) / width)).cast("int")
    counts = df.where(F.col(score).isNotNull()).groupBy(truth, cell.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(truth))  # at most ``bins`` rows per class
    return counts.withColumn("density", F.round(F.col("n") / (total * width), 6))


def score_summary(df: DataFrame, score: str, flag: str, truth: str | None = None) -> DataFrame:
    n = F.count(F.lit(1))
    aggs = [n.alias("n_rows"), n_of(F.col(flag)).alias("anomalies"), F.round(n_of(F.col(flag)) / n, 6).alias("share"), F.round(F.avg(score), 6).alias("mean"),
            F.round(F.stddev_pop(score), 6).alias("std"), F.min(score).alias("min"), F.max(score).alias("max")]
    if truth:
        aggs.append(F.round(n_of(F.col(flag) == (F.col(truth) == 1)) / n, 6).alias("accuracy"))
    return df.agg(*aggs)


def leaderboard(df: DataFrame, truth: str, models: list[str], share: float = 0.95, **kw) -> DataFrame:
    """Each model alone: area under the curve and its report at its own benign percentile."""
    cuts = percentile_values(df.where(F.col(truth) == 0), models, [share], **kw)
    long = df.select(truth, F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(m).alias("s"), F.lit(cuts[m][0]).alias("threshold")) for m in models])).alias("r")).select(truth, "r.*")
    auc = roc_auc(long, truth, "s", ["model"])
    rep = binary_report(long, truth, F.col("s") > F.col("threshold"), ["model", "threshold"])
    return rep.join(F.broadcast(auc), "model").withColumn("auc", F.round("auc", 6))


def compare(df: DataFrame, truth: str, scores: dict[str, str]) -> DataFrame:
    """Areas of several score columns side by side, with the gain over the first."""
    long = df.select(truth, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("s"), F.lit(i).alias("place")) for i, (n, c) in enumerate(scores.items())])).alias("r")).select(truth, "r.*")
    auc = roc_auc(long, truth, "s", ["name", "place"])
    first = auc.where(F.col("place") == 0).select(F.col("auc").alias("base"))
    return auc.crossJoin(F.broadcast(first)).select("name", F.round("auc", 6).alias("auc"), F.round(F.col("auc") - F.col("base"), 6).alias("gain"))


def compare_cuts(df: DataFrame, truth: str, score: str, share: float = 0.95, **kw) -> DataFrame:
    """What the threshold of best F1 gains over a percentile of the benign scores: one row each, F1 gain over the percentile.

    Rows without score or truth take no part. Without attacks both are percentiles and F1 is 0.
    """
    rows = df.where(F.col(score).isNotNull() & F.col(truth).isNotNull())
    cut = percentile_values(rows.where(F.col(truth) == 0), [score], [share], **kw)[score][0]
    best = best_f1_threshold(rows, truth, score, fallback=share, **kw).first()["threshold"]
    cuts = {f"p{round(share * 100)}": cut, "best_f1": best}
    hit = lambda c, y: n_of((F.col(truth) == y) & (F.col(score) >= F.lit(c)))
    one = rows.agg(*[e.alias(f"{kind}{i}") for i, c in enumerate(cuts.values()) for kind, e in (("tp", hit(c, 1)), ("fp", hit(c, 0)))], n_of(F.col(truth) == 1).alias("p"))
    made = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(c).cast("double").alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp")) for i, (n, c) in enumerate(cuts.items())])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp = F.col("c.tp"), F.col("c.fp")
    f1 = lambda t, f: ratio(2 * t, t + f + F.col("p"))
    table = one.select("p", F.col("tp0"), F.col("fp0"), F.explode(made).alias("c"))
    return table.select("c.name", "c.threshold", F.round(ratio(tp, tp + fp), 6).alias("precision"), F.round(ratio(tp, F.col("p")), 6).alias("recall"),
                        F.round(f1(tp, fp), 6).alias("f1"), F.round(f1(tp, fp) - f1(F.col("tp0"), F.col("fp0")), 6).alias("gain"))


AUDIT = {
    "union_select": lambda p, t: p.ilike("%union%") & p.ilike("%select%"),
    "api_path": lambda p, t: p.ilike("%/api/%"),
    "norm_with_quote_and_sql": lambda p, t: (t == "norm") & p.contains("'") & p.rlike("(?i)SELECT|UNION|INSERT"),
    "sqli_union": lambda p, t: (t == "sqli") & p.ilike("%union%"),
}


def audit_slices(df: DataFrame, payload: str = "payload", label: str = "attack_type") -> DataFrame:
    """Rows per class in the suspicious slices of a payload corpus, all slices in one pass."""
    p, t = F.col(payload), F.col(label)
    hits = F.array_compact(F.array(*[F.when(test(p, t), F.lit(name)) for name, test in AUDIT.items()]))
    return df.select(label, F.explode(hits).alias("slice")).groupBy("slice", label).agg(F.count(F.lit(1)).alias("n"))
