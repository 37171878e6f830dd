"""Mixing sources to target weights: repetition rates per source, whole copies plus one seeded draw.

Everything is DataFrame work. Sizes are counted once per document and stored; sources are aggregated with
partial sums, so a source with a third of all rows costs no more than any other; ranks of sources come from a
range partitioning with per-partition offsets, and the resharing of targets iterates over aggregates of one row.

Null text: size 0. Null source: a source of its own, last. Null or repeated doc_id: allowed, equal ids share
the draw. Size 0 source: target 0. Empty table: empty result. Extra columns pass through ``mix`` untouched,
except that result columns of the same name replace them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
MOST_COPIES = 3
WEIGHTS = 3
DRAW_BITS = 52


def draw(seed: int) -> Column:
    """A repeatable number in [0, 1) from doc_id and seed."""
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, DRAW_BITS // 4), 16, 10).cast("double") / F.lit(float(2**DRAW_BITS))


def ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank`` (0, 1, ...) by code point of ``source``, null last, without a one-task sort."""
    spark = sources.sparkSession
    parts = spark.sparkContext.defaultParallelism
    key = F.coalesce(F.encode("source", "UTF-8"), F.unhex(F.lit("F8")))  # F8 is above all of UTF-8
    placed = (sources.withColumn("k", key).repartitionByRange(parts, "k").sortWithinPartitions("k")
              .withColumn("m", F.monotonically_increasing_id()))
    placed = stored(placed.select("source", "source_size", F.shiftright("m", 33).alias("part"), F.col("m").bitwiseAND((1 << 33) - 1).alias("pos")), "ranked")
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row per partition
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"))
    return placed.join(before, "part").select("source", "source_size", (F.col("off") + F.col("pos")).alias("rank"))


def targets(sources: DataFrame, weight: Column | None = None, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target): all words shared by weight, no target above ``most`` times its source.

    A source that would exceed its bound stays at the bound and the rest is shared again by weight, until no
    source is above; each round is one aggregate over the sources.
    """
    w = ranked(sources).withColumn("weight", F.col("rank") % WEIGHTS + 1 if weight is None else weight)
    w = stored(w.select("source", "source_size", "weight"), "weights")
    total = w.agg(F.sum("source_size")).first()[0] or 0
    left, share = total, None
    while True:
        # A source is at its bound where most * size <= left * weight / share, all in integers.
        bound = F.lit(False) if share is None else F.col("source_size").cast("decimal(38,0)") * most * share <= F.col("weight").cast("decimal(38,0)") * left
        full = w.agg(F.sum(F.when(bound, F.col("source_size") * most)).alias("used"), F.sum(F.when(~bound, F.col("weight"))).alias("share")).first()
        new = (total - (full["used"] or 0), full["share"] or 0)
        if new == (left, share) or not new[1]:
            break
        left, share = new
    if not share:
        return w.select("source", "source_size", F.lit(0.0).alias("target"))
    at = F.col("source_size").cast("decimal(38,0)") * most * share <= F.col("weight").cast("decimal(38,0)") * left
    free = F.lit(float(left)) * F.col("weight").cast("double") / F.lit(float(share))
    return w.select("source", "source_size", F.when(at, (F.col("source_size") * most).cast("double")).otherwise(free).alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))


def rates(docs: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(source, source_size, target, rate) of every source."""
    sizes = sized(docs) if sizes is None else sizes
    goal = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    return goal.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def copies(seed: int) -> Column:
    """How often a document of rate ``rate`` is emitted: the whole part, and once more with the fraction as chance."""
    whole = F.floor("rate")
    return (whole + F.when(draw(seed) < F.col("rate") - whole, 1).otherwise(0)).cast("bigint")


def take(docs: DataFrame, seed: int = 42) -> DataFrame:
    """Per document: doc_id, size, source, source_size, target, copies, taken."""
    sizes = stored(sized(docs), "sizes")
    goal = rates(docs, sizes).withColumnRenamed("source", "__s")
    joined = sizes.join(goal, F.col("source").eqNullSafe(F.col("__s")), "left")
    out = joined.withColumn("copies", copies(seed))
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The mixed corpus: every document as often as its rate says, numbered by ``copy`` (from 1)."""
    sizes = stored(sized(docs), "sizes")
    goal = rates(docs, sizes).select(F.col("source").alias("__s"), F.col("rate"))
    base = docs.drop("rate", "copy")
    joined = base.join(goal, F.col("source").eqNullSafe(F.col("__s")), "left").withColumn("__n", copies(seed))
    many = joined.where(F.col("__n") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__n"))))
    return many.select(*[F.col(f"`{c}`") for c in base.columns], "copy")
