"""Building blocks that keep ordered and ranked work spread over the cluster.

One source address or class may own a third of all rows, so nothing here puts a whole key into one
window partition. Keys are cut into buckets (of time, of score or of hash); each bucket is summarised,
the small summaries are chained, and the chained value is joined back to the rows of the bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.session import SPREAD, materialize

US = 1_000_000
HASH_BITS = 52


def hash52(*cols: Column | str, seed: int = 42) -> Column:
    """A repeatable, evenly spread integer in [0, 2**52) from the key columns and a seed."""
    parts = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]
    digest = F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan to all cores where the session asks for it (setting ``SPREAD``, off by default).

    For work that is heavy per row over a table of one split, as on a single machine. Results don't depend on it.
    """
    spark = df.sparkSession
    return df.repartition(spark.sparkContext.defaultParallelism) if spark.conf.get(SPREAD, "false") == "true" else df


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where null equals null; the keys are taken from ``left``, all other columns from both."""
    renamed = right.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], *[F.col(f"`{c}`") for c in right.columns if c not in keys])
    on = reduce(lambda x, y: x & y, [left[f"`{k}`"].eqNullSafe(renamed[f"__k{i}"]) for i, k in enumerate(keys)])
    return left.join(renamed, on, how).drop(*[f"__k{i}" for i in range(len(keys))])


def in_ranges(df: DataFrame, order: list[str], name: str = "__part") -> DataFrame:
    """``df`` stored with the number of the range of ``order`` that a row lies in: as even as the data allow.

    The ranges come from a sample of the data, so a column may be skewed in any way. The table is stored because the
    ranges of two runs of the same plan may differ.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(parts, *order).withColumn(name, F.spark_partition_id()), "ranges")


# -- ordered scans -------------------------------------------------------------------------------

def time_bucket(ts_us: Column, seconds: int) -> Column:
    return F.floor(ts_us / F.lit(seconds * US)).cast("bigint")


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    bucket: str,
    order: list[str],
    fill: dict[str, str] | None = None,
    running_sum: dict[str, str] | None = None,
    running_max: dict[str, str] | None = None,
) -> DataFrame:
    """Per key, in order: last non-null value, running sum and running maximum up to each row.

    ``bucket`` must be non-decreasing along ``order``. The sequential part runs over one summary row
    per (key, bucket), so its length depends on the number of buckets a key spans, not on its rows.
    """
    fill, running_sum, running_max = fill or {}, running_sum or {}, running_max or {}
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    position = F.struct(*order)

    summary_aggs = []
    carried = []
    for out, src in fill.items():
        summary_aggs.append(
            F.max_by(F.struct(F.col(src).alias("v")), F.when(F.col(src).isNotNull(), position)).alias(f"__f_{out}"))
        carried.append(F.last(F.col(f"__f_{out}"), ignorenulls=True).over(before).alias(f"__f_{out}"))
    for out, src in running_sum.items():
        summary_aggs.append(F.sum(src).alias(f"__s_{out}"))
        carried.append(F.sum(f"__s_{out}").over(before).alias(f"__s_{out}"))
    for out, src in running_max.items():
        summary_aggs.append(F.max(src).alias(f"__m_{out}"))
        carried.append(F.max(f"__m_{out}").over(before).alias(f"__m_{out}"))

    rows = df
    for out, src in fill.items():
        rows = rows.withColumn(f"__lf_{out}", F.last(F.col(src), ignorenulls=True).over(inside))
    for out, src in running_sum.items():
        rows = rows.withColumn(f"__ls_{out}", F.sum(src).over(inside))
    for out, src in running_max.items():
        rows = rows.withColumn(f"__lm_{out}", F.max(src).over(inside))

    chain = df.groupBy(*keys, bucket).agg(*summary_aggs).select(*keys, bucket, *carried)
    joined = null_safe_join(rows, chain, [*keys, bucket], "left")
    out_cols = [F.col(c) for c in df.columns]
    for out in fill:
        out_cols.append(F.coalesce(F.col(f"__lf_{out}"), F.col(f"__f_{out}.v")).alias(out))
    for out in running_sum:
        out_cols.append((F.coalesce(F.col(f"__ls_{out}"), F.lit(0)) + F.coalesce(F.col(f"__s_{out}"), F.lit(0))).alias(out))
    for out in running_max:
        out_cols.append(F.greatest(F.col(f"__lm_{out}"), F.col(f"__m_{out}")).alias(out))
    return joined.select(*out_cols)


def with_context(df: DataFrame, ts_us: str, seconds: int, back: bool = True) -> DataFrame:
    """Copy every row into its own time bucket and the neighbouring one.

    With ``back`` a window over (key, ``__bucket``) can look ``seconds`` into the past: a row of bucket
    b also appears, flagged ``__context``, in bucket b+1. Otherwise the copy goes to b-1 (look ahead).
    """
    b = time_bucket(F.col(ts_us), seconds)
    step = 1 if back else -1
    copies = F.explode(F.array(
        F.struct(b.alias("b"), F.lit(False).alias("c")),
        F.struct((b + F.lit(step)).alias("b"), F.lit(True).alias("c")),
    ))
    return (df.withColumn("__copy", copies)
              .withColumn("__bucket", F.col("__copy.b")).withColumn("__context", F.col("__copy.c"))
              .drop("__copy"))


def sliding_sum(instants: DataFrame, keys: list[str], ts_us: str, span_us: int, value: str, out: str,
                last: dict[str, str] | None = None) -> DataFrame:
    """Sum of ``value`` over the window that an instant enters now and leaves ``span_us`` later.

    Expects one row per key and instant. Every row appears once more, negated, at the time it leaves,
    so the sliding sum is one running sum: linear even for a flood, where a sliding frame would read
    its whole window again for every row. ``last`` adds running maxima (times last seen, say).
    """
    leave = instants.select(*keys, (F.col(ts_us) + span_us).alias(ts_us), F.lit(0).alias("__kind"), (-F.col(value)).alias(value))
    both = instants.withColumn("__kind", F.lit(1)).unionByName(leave, allowMissingColumns=True)
    both = both.withColumn("__bucket", F.floor(F.col(ts_us) / F.lit(span_us)))
    done = ordered_scan(both, keys, "__bucket", [ts_us, "__kind"], running_sum={out: value}, running_max=last)
    return done.where(F.col("__kind") == 1).drop("__kind", "__bucket")


def previous_within(df: DataFrame, keys: list[str], order: list[str], ts_us: str, seconds: int,
                    cols: list[str]) -> DataFrame:
    """``prev_<col>`` of the preceding row of the key, NULL when it is ``seconds`` or more away.

    A predecessor that is near enough lies in the same time bucket or the one before, so each bucket
    only needs the last row of its neighbour, which a partial aggregate delivers.
    """
    need = list(dict.fromkeys([*keys, *order, ts_us, *cols]))
    rows = df.withColumn("__bucket", time_bucket(F.col(ts_us), seconds))
    last = (rows.groupBy(*keys, "__bucket")
                .agg(F.max(F.struct(*[F.col(c) for c in order],
                                    *[F.col(c).alias(f"x_{c}") for c in need if c not in keys])).alias("l"))
                .select(*keys, (F.col("__bucket") + 1).alias("__bucket"),
                        *[F.col(f"l.x_{c}").alias(c) for c in need if c not in keys],
                        F.lit(True).alias("__context")))
    both = rows.withColumn("__context", F.lit(False)).unionByName(last, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "__bucket").orderBy(*order)
    near = F.col(ts_us) - F.lag(ts_us).over(w) < F.lit(seconds * US)
    out = both.select("*", *[F.when(near, F.lag(c).over(w)).alias(f"prev_{c}") for c in cols])
    return out.where(~F.col("__context")).drop("__bucket", "__context")


# -- ranked cuts -----------------------------------------------------------------------------------

def hash_position(key: list[str], seed: int) -> Column:
    """What the hash order compares: hash first, key columns for the (rare) equal hashes."""
    return F.struct(hash52(*key, seed=seed).alias("h"), *key)


def hash_cuts(df: DataFrame, by: list[str], targets: DataFrame, key: list[str], seed: int = 42, bits: int = 12) -> DataFrame:
    """(group..., target, cut): the hash position of the target-th row, for every group and target of 1 and above.

    Two narrow passes over group and key columns only. Rows are counted per (group, leading hash bits); then only
    the one bucket that holds a cut is ordered. ``cut`` is null when a group has no more rows than its target. Any
    number of groups; a null group is a group. The result is stored: its size is known to the planner.
    """
    slim = df.select(*[F.col(f"`{c}`") for c in by], *[F.col(f"`{c}`") for c in key if c not in by]).withColumn("__p", hash_position(key, seed))
    slim = slim.withColumn("__hb", F.shiftright(F.col("__p.h"), HASH_BITS - bits)).select(*by, "__p", "__hb")
    counts = slim.groupBy(*by, "__hb").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*by).orderBy("__hb").rowsBetween(Window.unboundedPreceding, -1)  # 2 ** bits rows a group
    wanted = targets.select(*by, "target").where("target > 0").distinct()
    placed = null_safe_join(wanted, counts.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0))), by, "left")
    hit = (F.col("__before") < F.col("target")) & (F.col("target") <= F.col("__before") + F.col("__n"))
    edges = placed.groupBy(*by, "target").agg(F.max(F.when(hit, F.struct("__hb", "__before"))).alias("e"))
    inside = edges.where(F.col("e").isNotNull()).select(*by, "target", F.col("e.__hb").alias("__hb"), (F.col("target") - F.col("e.__before")).alias("__nth"))
    rank = F.row_number().over(Window.partitionBy(*by, "__hb").orderBy("__p"))
    pool = null_safe_join(slim, inside.select(*by, "__hb").distinct(), [*by, "__hb"]).withColumn("__r", rank)
    found = null_safe_join(pool, inside.withColumnRenamed("__nth", "__r"), [*by, "__hb", "__r"]).select(*by, "target", F.col("__p").alias("cut"))
    return materialize(null_safe_join(edges.select(*by, "target"), found, [*by, "target"], "left"), "cuts")


def take_by_hash(df: DataFrame, by: list[str], targets: DataFrame, key: list[str], seed: int = 42, bits: int = 12) -> DataFrame:
    """Exactly ``target`` rows per group (all of a smaller group), in hash order of ``key``.

    After ``hash_cuts`` this is a filter against one row a group.
    """
    cuts = hash_cuts(df, by, targets, key, seed, bits).select(*by, F.col("cut").alias("__cut"))
    joined = null_safe_join(df, cuts, by)
    kept = joined.where(F.col("__cut").isNull() | (hash_position(key, seed) <= F.col("__cut")))
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])


def rank_by_hash(df: DataFrame, by: list[str], key: list[str], seed: int = 42, bits: int = 12,
                 name: str = "rank") -> DataFrame:
    """Position of each row in the hash order of its group (1, 2, ...), ranked bucket by bucket."""
    shift = HASH_BITS - bits
    hashed = df.withColumn("__h", hash52(*key, seed=seed)).withColumn("__hb", F.shiftright("__h", shift))
    out = ordered_scan(hashed.withColumn("__one", F.lit(1).cast("bigint")), by, "__hb", ["__h", *key],
                       running_sum={name: "__one"})
    return out.drop("__h", "__hb", "__one")


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int, salt_key: list[str],
          salts: int = 64) -> DataFrame:
    """First ``n`` rows per group in ``order`` (which must be total); a hot group is thinned under salt first."""
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*salt_key), F.lit(salts)))
    near = F.row_number().over(Window.partitionBy(*by, "__salt").orderBy(*order))
    thinned = salted.withColumn("__r", near).where(F.col("__r") <= n).drop("__r", "__salt")
    final = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return thinned.withColumn("row_rank", final).where(F.col("row_rank") <= n)


# -- cumulative counts over scores -------------------------------------------------------------------

def score_counts(df: DataFrame, truth: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Positives and negatives per distinct score: all any ranked metric needs, and ties are grouped."""
    return (df.where(F.col(score).isNotNull() & F.col(truth).isNotNull())
              .groupBy(*(by or []), F.col(score).cast("double").alias("score"))
              .agg(F.sum(F.when(F.col(truth) == 1, 1).otherwise(0)).cast("bigint").alias("pos"),
                   F.sum(F.when(F.col(truth) == 1, 0).otherwise(1)).cast("bigint").alias("neg")))


def descending_totals(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``tp`` and ``fp``: positives and negatives with a score at or above each distinct score.

    Scores are dealt by ranges of the scores themselves, so the running sums of different ranges run in different
    tasks however the scores are spread; one summary row per range is chained.
    """
    by = by or []
    cells = in_ranges(counts.withColumn("__all", F.lit(0)).withColumn("__neg_score", -F.col("score")), [*by, "__neg_score"])
    out = ordered_scan(cells, ["__all", *by], "__part", ["__neg_score"], running_sum={"tp": "pos", "fp": "neg"})
    return out.drop("__all", "__part", "__neg_score")


# -- percentiles -------------------------------------------------------------------------------------

def percentiles(df: DataFrame, cols: list[str], probs: list[float], exact: bool = True, accuracy: float = 1e-4) -> DataFrame:
    """Linear-interpolated percentiles in long form: (column, prob, value).

    Exact at any size, in one pass over the rows: all columns are folded to counts per distinct value, the counts are
    dealt by ranges of the values and summed along them, and the values at the two ranks of each percentile are
    picked. Null and NaN are left out; a column without any value gives null. ``exact=False`` takes a sketch.
    """
    data = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    if not exact:
        wide = data.agg(*[F.percentile_approx(F.nanvl(f"`{c}`", F.lit(None).cast("double")), probs, int(1 / accuracy)).alias(c) for c in cols])
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(float(p)).alias("prob"), F.col(f"`{c}`")[i].alias("value")) for c in cols for i, p in enumerate(probs)]))
        return wide.select(pairs.alias("p")).select("p.*")
    spark = df.sparkSession
    wanted = spark.createDataFrame([(i, c, k, float(p)) for i, c in enumerate(cols) for k, p in enumerate(probs)], "c int, column string, k int, prob double")
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), (F.col(f"`{c}`") + F.lit(0.0)).alias("v")) for i, c in enumerate(cols)]))
    values = data.select(cells.alias("x")).select("x.c", "x.v").where("v is not null and not isnan(v)").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    summed = ordered_scan(in_ranges(values, ["c", "v"]), ["c"], "__part", ["v"], running_sum={"upto": "n"})
    totals = values.groupBy("c").agg(F.sum("n").alias("total"))
    ranks = wanted.join(totals, "c").withColumn("rank", F.col("prob") * (F.col("total") - 1))  # a row per column and percentile
    at = summed.join(F.broadcast(ranks), "c").where((F.col("upto") > F.floor("rank")) & (F.col("upto") - F.col("n") <= F.ceil("rank")))
    low = F.max(F.when(F.col("upto") - F.col("n") <= F.floor("rank"), F.col("v")))
    high = F.min(F.when(F.col("upto") > F.ceil("rank"), F.col("v")))
    picked = at.groupBy("c", "k").agg(low.alias("low"), high.alias("high"), F.first("rank").alias("rank"))
    value = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * (F.col("rank") - F.floor("rank")))
    return wanted.join(picked, ["c", "k"], "left").select("column", "prob", value.alias("value"))


def percentile_values(df: DataFrame, cols: list[str], probs: list[float], **kw) -> dict[str, list[float]]:
    """The same as plain numbers: len(cols) x len(probs) of them reach the driver."""
    got: dict[str, dict[float, float]] = {}
    for r in percentiles(df, cols, probs, **kw).collect():
        got.setdefault(r["column"], {})[r["prob"]] = r["value"]
    return {c: [got[c][float(p)] for p in probs] for c in cols}
