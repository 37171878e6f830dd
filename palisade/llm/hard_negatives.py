"""Hard negatives of anchors by a cover tree over norm-augmented candidates.

The top of the tree is one level of cells: pivots, taken farthest first from a sample of ``SAMPLE`` rows, with the radius
that covers all rows of the cell, measured over the whole table. A cell of many rows is split by the hash of the ids into
parts; a task builds the tree of a part (``cover_tree``) and lets anchors stream through it. An anchor goes to a part
only if the cell's bounds allow a score that its windows still need; the pivots are rows themselves, so the fifth best
of them bounds what is needed before anything is shuffled. Inside a part whole nodes are skipped by the same bounds,
leaves are visited best first, and leaf scores are exact integers in double precision.

Two passes: the positives of every anchor (one window without ends, same label), then the windows under its positives
(other labels). All of it is exact; pivots and parts only decide how much is skipped. Vectors that are spread evenly in
many dimensions leave little to skip, and then every anchor meets every row, block by block.

Bounds: at most ``MOST_CELLS`` pivots and ``PIVOT_BYTES`` of them are broadcast. A part holds about ``PART_ROWS`` rows.

Rows take no part if id, label or vector is null, if a component is null or not finite, or if the vector has another
length than most (of equally common lengths the smaller one counts). Rows equal in all three count once; rows that share
an id only are rows of their own, but never an anchor's positive for the anchor of that id. Ties go to the smaller id.
An empty table has no rows in the result. Extra columns play no part. Scores from 2^53 on raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import ready, stored
from palisade.llm.cover_tree import CoverTree, augmented, bounds, farthest_first, label_bit

K = 5
SAMPLE = 8192
MOST_CELLS = 4096
PIVOT_BYTES = 32_000_000
PART_ROWS = (2048, 16384)
ANCHORS = 512

ROW = "part int, kind int, a bigint, id bigint, label bigint, v array<double>, low array<double>, high array<double>"
FOUND = "a bigint, w int, id bigint, score bigint"


def quantised(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, v): components as floor(256 x); labels of every seventh row moved on by one, modulo 10."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return embeddings.where(F.col("embedding").isNotNull() & finite).select("vec_id", label.alias("label"), v.alias("v"))


def usable(rows: DataFrame) -> DataFrame:
    """Rows that take part, each once."""
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "v").where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (length["d"] if length else 0)).dropDuplicates(["id", "label", "v"])


def _matrix(column) -> np.ndarray:
    return np.array(column.flatten(), np.float64).reshape(len(column), -1)


class Cells:
    """The pivots, what their cells hold, and how an anchor finds the parts it has to visit."""

    def __init__(self, sample: list, cells: int, longest: float):
        self.longest = longest
        self.ids = np.array([r["id"] for r in sample], np.int64)
        self.labels = np.array([r["label"] for r in sample], np.int64)
        x = np.array([r["v"] for r in sample], np.float64)
        self.sample = x
        chosen = farthest_first(augmented(x, longest), cells)[0]
        self.pivots = x[chosen]
        self.whole = augmented(self.pivots, longest)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot of every row and the distance to it."""
        whole = augmented(x, self.longest)
        squared = 2 * self.longest ** 2 - 2 * (whole @ self.whole.T)
        cell = squared.argmin(axis=1)
        return cell, np.sqrt(((whole - self.whole[cell]) ** 2).sum(axis=1))

    def measure(self, stats: list, part_rows: int) -> None:
        n = len(self.pivots)
        self.radius, self.mask, self.parts = np.full(n, -1.0), np.zeros(n, np.uint64), np.zeros(n, np.int64)
        for r in stats:
            self.radius[r["cell"]], self.mask[r["cell"]] = r["radius"], np.uint64(r["mask"] & 0xFFFFFFFFFFFFFFFF)
            self.parts[r["cell"]] = -(-r["n"] // part_rows)
        self.first = np.concatenate([[0], np.cumsum(self.parts)[:-1]])

    def needed(self, q: np.ndarray, own: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool) -> np.ndarray:
        """``low``, raised to the fifth best score that the sample has in the window."""
        s = q @ self.sample.T
        equal = self.labels[None, :] == label[:, None]
        fit = equal & (self.ids[None, :] != own[:, None]) if same else ~equal
        out = low.copy()
        if s.shape[1] < K:
            return out
        for i in range(low.shape[1]):
            inside = np.where(fit & (s <= high[:, i:i + 1]), s, -np.inf)
            out[:, i] = np.maximum(out[:, i], np.partition(inside, s.shape[1] - K, axis=1)[:, s.shape[1] - K])
        return out

    def visits(self, q: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, part) of all parts that may hold what a query needs."""
        lo, hi = bounds(q, self.pivots, self.radius, self.longest)
        ok = np.zeros(lo.shape, bool)
        for i in range(low.shape[1]):
            ok |= (lo <= high[:, i:i + 1]) & (np.minimum(hi, high[:, i:i + 1]) >= low[:, i:i + 1])
        ok &= self.parts > 0
        if same:
            ok &= (label_bit(label)[:, None] & self.mask[None, :]) > 0
        query, cell = np.nonzero(ok)
        n = self.parts[cell]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(query, n), np.repeat(self.first[cell], n) + within


def _lists(a: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.ravel()))


def _found(candidates: DataFrame, anchors: DataFrame, cells: Cells, same: bool) -> DataFrame:
    """(a, w, id, score): the K best of every window of every anchor.

    ``candidates`` are (part, id, label, v), ``anchors`` (a, id, label, v, low, high), with as many windows in all of them.
    """
    sent = candidates.sparkSession.sparkContext.broadcast(cells)

    def route(batches):
        top = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, ANCHORS):
                b = whole.slice(at, ANCHORS)
                q, own, label = _matrix(b.column("v")), np.array(b.column("id")), np.array(b.column("label"))
                low, high = _matrix(b.column("low")), _matrix(b.column("high"))
                low = top.needed(q, own, label, low, high, same)
                query, part = top.visits(q, label, low, high, same)
                for cut in range(0, len(query), 4 * ANCHORS):
                    i, p = query[cut:cut + 4 * ANCHORS], part[cut:cut + 4 * ANCHORS]
                    taken = b.take(pa.array(i))
                    yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(np.ones(len(i)), pa.int32()), taken.column("a"), taken.column("id"), taken.column("label"), taken.column("v"), _lists(low[i]), taken.column("high")],
                                                     names=["part", "kind", "a", "id", "label", "v", "low", "high"])

    def search(batches):
        part, tree, held = None, None, []
        for whole in batches:
            ids = np.array(whole.column("part"))
            kinds = np.array(whole.column("kind"))
            edges = [0, *(np.flatnonzero((np.diff(ids) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), whole.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                if hi == lo:
                    continue
                if ids[lo] != part:
                    part, tree, held = ids[lo], None, []
                b = whole.slice(lo, hi - lo)
                if kinds[lo] == 0:
                    held.append((np.array(b.column("id")), np.array(b.column("label")), _matrix(b.column("v"))))
                    continue
                if tree is None:
                    if not held:
                        continue
                    tree, held = CoverTree(*(np.concatenate([h[c] for h in held]) for c in range(3)), sent.value.longest), []
                for at in range(0, b.num_rows, ANCHORS):
                    c = b.slice(at, ANCHORS)
                    query, window, found, score = tree.search(_matrix(c.column("v")), np.array(c.column("id")), np.array(c.column("label")), _matrix(c.column("low")), _matrix(c.column("high")), K, same)
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(c.column("a"))[query], pa.int64()), pa.array(window, pa.int32()), pa.array(found, pa.int64()), pa.array(score.astype(np.int64))], names=["a", "w", "id", "score"])

    none = F.lit(None)
    rows = candidates.select("part", F.lit(0).alias("kind"), none.cast("long").alias("a"), "id", "label", "v", none.cast("array<double>").alias("low"), none.cast("array<double>").alias("high"))
    rows = rows.unionByName(anchors.mapInArrow(route, ROW))
    found = rows.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(search, FOUND)
    best = Window.partitionBy("a", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= K)


def hard_negatives(rows: DataFrame, is_anchor: Column) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for rows (vec_id, label, v)."""
    spark = ready(rows.sparkSession)
    rows = stored(usable(rows), "vectors")
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("longest")).first()
    n, d, longest = shape["n"], shape["d"] or 0, float(np.sqrt(shape["longest"] or 0.0)) * (1 + 1e-12)
    if longest ** 2 >= 2.0 ** 53:
        raise ValueError("inner products do not fit in 53 bits")
    if not n or not d:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part_rows = min(PART_ROWS[1], max(PART_ROWS[0], n // (2 * partitions)))
    most = max(1, min(MOST_CELLS, PIVOT_BYTES // (8 * d + 8)))
    sample = rows.orderBy(F.xxhash64("id", "label"), "id").limit(int(min(SAMPLE, max(16, PIVOT_BYTES // (8 * d))))).collect()
    cells = Cells(sample, int(min(most, max(1, n // part_rows))), longest)
    sent = spark.sparkContext.broadcast(cells)

    def assign(batches):
        for b in batches:
            if not b.num_rows:
                continue
            cell, dist = sent.value.nearest(_matrix(b.column("v")))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(dist), *b.columns], names=["cell", "dist", *b.schema.names])

    placed = stored(rows.mapInArrow(assign, "cell int, dist double, id bigint, label bigint, v array<double>"), "cells")
    bit = F.expr("shiftleft(1L, cast(pmod(label, 64) as int))")
    cells.measure(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius"), F.bit_or(bit).alias("mask")).collect(), part_rows)
    of_cell = F.broadcast(spark.createDataFrame([(i, int(cells.first[i]), int(cells.parts[i])) for i in range(len(cells.parts)) if cells.parts[i]], "cell int, first int, parts int"))  # at most MOST_CELLS rows
    candidates = placed.join(of_cell, "cell").select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("part"), "id", "label", "v")

    anchors = rows.withColumnRenamed("id", "vec_id").where(is_anchor).withColumnRenamed("vec_id", "id").select(F.xxhash64("id", "label", "v").alias("a"), "id", "label", "v")
    ends = lambda x: F.array(F.lit(x))
    positives = stored(_found(candidates, anchors.select("*", ends(-np.inf).alias("low"), ends(np.inf).alias("high")), cells, True).select("a", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # below zero no score is both at least 0.8 times and at most the positive's
    windows = positives.where("positive_score >= 0").groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("w", "positive_score"))).alias("of"))
    high = lambda w: F.coalesce(F.col("of")[w].cast("double"), F.lit(-np.inf))
    low = lambda w: F.coalesce(F.expr(f"(4 * of[{w}] + 4) div 5").cast("double"), F.lit(np.inf))
    windowed = anchors.join(windows, "a").select("a", "id", "label", "v", F.array(*[low(w) for w in range(K)]).alias("low"), F.array(*[high(w) for w in range(K)]).alias("high"))
    negatives = _found(candidates, windowed, cells, False).select("a", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    owners = anchors.select("a", F.col("id").alias("anchor_id"))
    return negatives.join(positives, ["a", "w"]).join(owners, "a").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def mined(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of every hundredth row of (vec_id, embedding, label)."""
    return hard_negatives(quantised(embeddings), F.col("vec_id") % 100 == 0)
