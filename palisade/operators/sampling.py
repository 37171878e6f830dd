"""Splits, balancing and hold-outs.

All sampling is in hash order of the row key (md5 of key and seed): repeatable, independent of the
partitioning, and cut per class without ranking whole classes (``take_by_hash``). A class may hold
most rows, so no window is ever partitioned by class alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.operators.scale import hash52, hash_cuts, hash_position, in_ranges, null_safe_join, ordered_scan, percentile_values, take_by_hash, top_n
from palisade.session import materialize


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def stratified_split(df: DataFrame, label: str, key: list[str], shares: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """Append ``split``: per class, the first share of the hash order is the first split, and so on.

    The cut positions of all classes and shares are found first; the split itself is then a projection.
    """
    shares = shares or {"train": 0.70, "val": 0.15, "test": 0.15}
    names = list(shares)
    ends = [round(sum(list(shares.values())[:i + 1]), 12) for i in range(len(names) - 1)]
    goal = lambda e: F.round(F.col("n") * F.lit(e)).cast("bigint")
    points = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), goal(e).alias("target")) for i, e in enumerate(ends)]))
    targets = materialize(class_counts(df, label).select(label, points.alias("t")).select(label, "t.i", "t.target"), "targets")
    found = null_safe_join(targets, hash_cuts(df, [label], targets, key, seed), [label, "target"], "left") if ends else targets
    table = found.groupBy(label).agg(*[F.max(F.when(F.col("i") == i, F.col(c))).alias(f"__{c[0]}{i}") for i in range(len(ends)) for c in ("target", "cut")])
    table = materialize(table, "splits")  # one row a class
    at, out = hash_position(key, seed), None
    for i, name in enumerate(names[:-1]):
        # No position means that the share ends behind the last row of the class.
        test = (F.col(f"__t{i}") > 0) & (F.col(f"__c{i}").isNull() | (at <= F.col(f"__c{i}")))
        out = F.when(test, name) if out is None else out.when(test, name)
    split = F.lit(names[-1]) if out is None else out.otherwise(names[-1])
    return null_safe_join(df, table, [label]).select(*[F.col(f"`{c}`") for c in df.columns], split.alias("split"))


def undersample(df: DataFrame, label: str, majority: str, key: list[str], ratio: int = 3, seed: int = 42) -> DataFrame:
    """Keep at most ``ratio`` times as many majority rows as there are other rows."""
    big = F.coalesce(F.col(label) == majority, F.lit(False))  # rows without a label are other rows
    size = df.agg(F.count(F.when(big, 1)).alias("m"), F.count(F.when(~big, 1)).alias("o"))
    target = size.select(F.lit(majority).alias(label), F.least("m", F.col("o") * ratio).alias("target"))
    return take_by_hash(df.where(big), [label], target, key, seed).unionByName(df.where(~big))


def copies(df: DataFrame, label: str, targets: DataFrame, key: list[str], seed: int = 42) -> DataFrame:
    """Exactly ``target`` rows per class: a hash-ordered part, or whole copies plus a hash-ordered rest.

    Appends ``copy`` (0 for the first appearance of a row). ``targets``: (label, target).
    """
    sized = materialize(null_safe_join(class_counts(df, label), targets, [label]), "sized")  # one row a class
    whole = sized.select(label, F.floor(F.col("target") / F.col("n")).cast("int").alias("times"))
    rest = sized.select(label, F.pmod(F.col("target"), F.col("n")).alias("target"), F.floor(F.col("target") / F.col("n")).cast("int").alias("copy"))
    full = null_safe_join(df, whole, [label]).where(F.col("times") > 0).select(*df.columns, F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("copy"))
    part = take_by_hash(df, [label], rest.select(label, "target"), key, seed)
    part = null_safe_join(part, rest.select(label, "copy"), [label]).select(*df.columns, "copy")
    return full.unionByName(part)


def balance(df: DataFrame, label: str, key: list[str], method: str = "none", seed: int = 42) -> DataFrame:
    """Binary classes 0/1 made equal by ``downsample`` or ``upsample``; rows labelled -1 are kept.

    With one class missing, or ``none``, the rows come back as they are. Appends ``copy``.
    """
    plain = df.withColumn("copy", F.lit(0))
    if method not in ("downsample", "upsample"):
        return plain
    known = df.where(F.col(label) != -1)
    n = {r[label]: r["n"] for r in class_counts(known, label).collect()}
    if not n.get(0) or not n.get(1):
        return plain
    target = min(n.values()) if method == "downsample" else max(n.values())
    targets = df.sparkSession.createDataFrame([(c, target) for c in n], f"{label} int, target bigint")
    return copies(known, label, targets, key, seed).unionByName(plain.where(F.col(label) == -1))


def fixed_prevalence(df: DataFrame, label: str, key: list[str], benign_share: float = 0.95, total: int = 100_000, seed: int = 42) -> DataFrame:
    """``total`` labelled rows with the given benign share; a class that is too small is repeated."""
    benign = int(total * benign_share)
    targets = df.sparkSession.createDataFrame([(0, benign), (1, total - benign)], f"{label} int, target bigint")
    return copies(df.where(F.col(label) != -1), label, targets, key, seed)


def n_per_class(df: DataFrame, label: str, n: int, key: list[str], seed: int = 42) -> DataFrame:
    """Up to ``n`` rows of every class, in hash order."""
    targets = class_counts(df, label).select(label, F.lit(n).cast("bigint").alias("target"))
    return take_by_hash(df, [label], targets, key, seed)


def cap_rows(df: DataFrame, key: list[str], n: int = 50_000, seed: int = 42) -> DataFrame:
    """At most ``n`` rows, in hash order (the calibration set has this size by design)."""
    one = df.withColumn("__g", F.lit(0))
    target = one.limit(1).select("__g", F.lit(n).cast("bigint").alias("target"))
    return take_by_hash(one, ["__g"], target, key, seed).drop("__g")


def head_per_class(df: DataFrame, label: str, n: int, order: list[str]) -> DataFrame:
    """First ``n`` rows per class in a stated order."""
    return top_n(df, [label], [F.asc(o) for o in order], n, order).drop("row_rank")


def rarest_classes(df: DataFrame, label: str, fraction: int = 4) -> DataFrame:
    """The rarest quarter of the classes (at least one)."""
    counts = class_counts(df.where(F.col(label).isNotNull()), label)
    total = counts.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / fraction)).alias("k"))
    return _positions(counts, ["n", label]).crossJoin(F.broadcast(total)).where(F.col("__r") <= F.col("k")).select(label, "n")


def _positions(df: DataFrame, order: list[str]) -> DataFrame:
    """Appends ``__r``: position (1, 2, ...) of each row in ``order``; ranges of it are counted in separate tasks."""
    dealt = in_ranges(df.withColumn("__all", F.lit(0)).withColumn("__one", F.lit(1).cast("bigint")), order)
    return ordered_scan(dealt, ["__all"], "__part", order, running_sum={"__r": "__one"}).drop("__all", "__one", "__part")


def holdout_types(df: DataFrame, label: str, benign: str = "benign") -> DataFrame:
    """Append ``split``: rows of the rarest attack types are ``holdout``, everything else ``train``."""
    held = rarest_classes(df.where(F.lower(label) != benign), label).select(label, F.lit("holdout").alias("__s"))
    return df.join(held, label, "left").withColumn("split", F.coalesce("__s", F.lit("train"))).drop("__s")


def holdout_extremes(df: DataFrame, label: str, feats: list[str], key: list[str], low: float = 0.05, high: float = 0.95, seed: int = 42,
                     first: int | None = None, **kw) -> DataFrame:
    """Attacks beyond the percentiles of any of the features form the test set, with as many benign rows.

    ``first`` looks at the first features only. Appends ``role``: train, test. Benign rows drawn for the test also stay
    in train, as in the source; so do rows without a label.
    """
    use = feats[:first]
    attack, benign = df.where(F.col(label) == 1), df.where(F.col(label) == 0)
    other = df.where(F.col(label).isNull())
    cuts = percentile_values(attack, use, [low, high], **kw)
    test = F.lit(False)
    for f in use:
        test = test | (F.col(f"`{f}`") < F.lit(cuts[f][0])) | (F.col(f"`{f}`") > F.lit(cuts[f][1]))
    test = F.coalesce(test, F.lit(False))
    extreme = attack.where(test)
    target = extreme.agg(F.count(F.lit(1)).alias("target")).withColumn(label, F.lit(0))
    drawn = take_by_hash(benign, [label], target, key, seed)
    return (extreme.withColumn("role", F.lit("test")).unionByName(drawn.withColumn("role", F.lit("test")))
            .unionByName(attack.where(~test).withColumn("role", F.lit("train"))).unionByName(benign.unionByName(other).withColumn("role", F.lit("train"))))


def holdout_temporal(df: DataFrame, label: str, period: str, key: list[str], share: float = 0.75, total: int = 20_000,
                     benign_share: float = 0.95, seed: int = 42) -> DataFrame:
    """Early periods train; late periods give a test set of fixed prevalence (without repeats)."""
    periods = df.select(period).distinct()
    order = _positions(periods.where(F.col(period).isNotNull()), [period])
    cut = periods.agg(F.floor(F.count(period) * share).alias("__k"))
    # A row without a period is in no late period.
    marked = df.join(order, period, "left").withColumn("__r", F.coalesce("__r", F.lit(0))).crossJoin(F.broadcast(cut))
    early = marked.where(F.col("__r") <= F.col("__k")).select(*df.columns)
    late = marked.where(F.col("__r") > F.col("__k")).select(*df.columns)
    benign = int(total * benign_share)
    targets = df.sparkSession.createDataFrame([(0, benign), (1, total - benign)], f"{label} int, target bigint")
    test = take_by_hash(late, [label], targets, key, seed)
    return early.withColumn("role", F.lit("train")).unionByName(test.withColumn("role", F.lit("test")))


def class_weights(df: DataFrame, label: str, boost: bool = True, benign: str = "benign") -> DataFrame:
    """n / (k n_c) per class; with ``boost`` benign is halved and every attack doubled."""
    counts = class_counts(df, label)
    total = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    base = F.col("total") / (F.col("k") * F.col("n"))
    weight = F.when(F.col(label).eqNullSafe(F.lit(benign)), base * 0.5).otherwise(base * 2.0) if boost else base
    return counts.crossJoin(F.broadcast(total)).select(label, "n", weight.alias("weight"))


def with_weights(df: DataFrame, label: str, boost: bool = True) -> DataFrame:
    return null_safe_join(df, class_weights(df, label, boost).select(label, "weight"), [label])


def shuffle(df: DataFrame, key: list[str], seed: int = 42) -> DataFrame:
    return df.orderBy(hash52(*key, seed=seed), *key)


def contamination(df: DataFrame, label: str) -> DataFrame:
    """Attack share clipped to the range a forest accepts."""
    share = F.avg(F.when(F.col(label) == 1, 1.0).otherwise(0.0))
    return df.where(F.col(label) != -1).agg(share.alias("ratio")).select("ratio", F.greatest(F.lit(0.001), F.least(F.lit(0.499), F.col("ratio"))).alias("contamination"))


def unit(key: list[str], name: str, seed: int = 42) -> Column:
    """A repeatable number in (0, 1) per row and purpose."""
    return (hash52(*key, F.lit(name), seed=seed) + 0.5) / F.lit(float(1 << 52))


def normal(key: list[str], name: str, seed: int = 42) -> Column:
    """A repeatable standard normal number per row and purpose."""
    return F.sqrt(-2.0 * F.log(unit(key, name + "|r", seed))) * F.cos(2.0 * math.pi * unit(key, name + "|a", seed))


def pseudo_negatives(df: DataFrame, feats: list[str], key: list[str], scale: float = 3.0, seed: int = 42) -> DataFrame:
    """One far-out copy of each benign row: every feature moved by N(0, scale) of its deviation."""
    q = lambda f: F.col(f"`{f}`")
    stds = df.agg(*[(F.coalesce(F.stddev_pop(q(f)), F.lit(0.0)) + 1e-6).alias(f"s{i}") for i, f in enumerate(feats)])
    noisy = [(q(f) + F.lit(scale) * normal(key, f, seed) * F.col(f"s{i}")).alias(f) for i, f in enumerate(feats)]
    return df.crossJoin(F.broadcast(stds)).select(*[F.col(k) for k in key], *noisy)
