"""Small helpers that the corpus operators share.

Rows are told apart by (doc_id, hash of the text): repeated rows share that key and get equal results, so
joining results back by it never multiplies rows. A null doc_id is a value of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.session import materialize, pin_utc, ship_package

ARROW_ROWS = 2000
NULL_ID = np.iinfo(np.int64).min


def ready(spark: SparkSession) -> SparkSession:
    """Package on the workers, UTC, Arrow batches of bounded length: texts may be long."""
    pin_utc(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def row_key() -> Column:
    """Hash of the text: with doc_id it tells rows apart."""
    return F.xxhash64(F.col("text"))


def with_results(docs: DataFrame, results: DataFrame, names: list[str]) -> DataFrame:
    """``docs`` with the columns ``names`` of ``results`` (one row per (doc_id, key) at most), null where it has none."""
    right = results.select(F.col("doc_id").alias("__rid"), F.col("key").alias("__rkey"), *[F.col(n).alias(f"__r_{n}") for n in names])
    left = docs.withColumn("__lkey", row_key())
    joined = left.join(right, F.col("doc_id").eqNullSafe(F.col("__rid")) & (F.col("__lkey") == F.col("__rkey")), "left")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return joined.select(*kept, *[F.col(f"__r_{n}").alias(n) for n in names])


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read again: cuts lineage, survives lost executors."""
    return materialize(df, name)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``most`` bytes in each (one row may hold more)."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = np.array(pc.fill_null(pc.binary_length(b.column(column)), 0), dtype=np.int64)
        block = np.cumsum(sizes) // most
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            yield b.slice(lo, hi - lo)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over undirected ``edges`` (a, b).

    Alternating large-star and small-star steps; every step is a grouped minimum and a join of the edge table
    with itself, written to the shared folder. Nodes without an edge are not in the result.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = stored(e, "edges")
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = large.where("a <> b")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(down, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("s"))
                 .select("s.a", "s.b").where("a <> b").distinct())
        new = stored(small, "edges")
        left, right = e.agg(*_fingerprint()).first(), new.agg(*_fingerprint()).first()
        e = new
        if left == right:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct())


def _fingerprint() -> list[Column]:
    h = F.xxhash64("a", "b")
    return [F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))]
