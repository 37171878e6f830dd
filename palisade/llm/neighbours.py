"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

Vectors become unit vectors (for the inner product with one more coordinate that makes up the length), are turned
by pseudo-random rotations (sign flips and fast Hadamard transforms, three times) and go to the bucket of the
nearest signed axis, once per table. A query probes the buckets of its nearest axes; all inner products with the
vectors in them are taken in double precision, as matrix products of blocks, and the best are kept per query.
The number of probes is the smallest that reaches ``RECALL`` against brute force on ``SAMPLE`` queries.

The number of buckets follows the number of vectors (about ``BUCKET_ROWS`` each). Equal vectors are one entry with
the k + 1 smallest ids, which is all that can matter, so copies fill no bucket; a bucket of more than ``BLOCK``
entries is split and its queries visit every part. Buckets travel in parts of about ``PART_ROWS`` entries, so a
query is sent once to a part and not once to a bucket. Queries that find fewer than k are searched in all buckets.

Vectors that are null, zero or hold a null or non-finite component take no part; nor do those of another length
than most. Repeated rows count once. Ties go to the smaller id. Empty table: empty result. Extra columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import ready, stored

TABLES = 8
BUCKET_ROWS = 100
MOST_AXES = 1 << 14
BLOCK = 1024
PART_ROWS = 8192
RECALL = 0.96
SAMPLE = 128
SEED = 11
HELD = 1_000_000


def hadamard(x: np.ndarray) -> np.ndarray:
    n, d = x.shape
    h = 1
    while h < d:
        pair = x.reshape(n, -1, 2, h)
        x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


class CrossPolytope:
    """``tables`` hash functions of unit vectors to the 2 x axes signed axes."""

    def __init__(self, dimension: int, rows: int, longest: float, tables: int = TABLES):
        axes = 1 << max(dimension, 1).bit_length()  # holds the coordinate that makes up the length
        while axes < MOST_AXES and 2 * axes * BUCKET_ROWS < rows:
            axes *= 2
        self.dimension, self.axes, self.tables, self.longest = dimension, axes, tables, longest
        self.signs = np.random.default_rng(SEED).choice(np.array([-1.0, 1.0]), (tables, 3, axes))

    def unit(self, x: np.ndarray, query: bool) -> np.ndarray:
        out = np.zeros((len(x), self.axes))
        if query:
            out[:, :self.dimension] = x / np.linalg.norm(x, axis=1, keepdims=True)
        else:
            out[:, :self.dimension] = x / self.longest
            out[:, self.dimension] = np.sqrt(np.maximum(0, 1 - (out[:, :self.dimension] ** 2).sum(axis=1)))
        return out

    def rotated(self, unit: np.ndarray, table: int) -> np.ndarray:
        for signs in self.signs[table]:
            unit = hadamard(unit * signs)
        return unit

    def buckets(self, unit: np.ndarray, table: int) -> np.ndarray:
        y = self.rotated(unit, table)
        axis = np.abs(y).argmax(axis=1)
        return 2 * axis + (y[np.arange(len(y)), axis] < 0)

    def probes(self, unit: np.ndarray, table: int, n: int) -> np.ndarray:
        """The n nearest signed axes of every row, nearest first."""
        y = self.rotated(unit, table)
        score = np.stack([y, -y], axis=2).reshape(len(y), -1)
        if n >= score.shape[1]:
            return np.argsort(-score, axis=1, kind="stable")
        part = np.argpartition(-score, n - 1, axis=1)[:, :n]
        return np.take_along_axis(part, np.argsort(-np.take_along_axis(score, part, 1), axis=1, kind="stable"), 1)


def _matrix(b: pa.RecordBatch, column: str = "v") -> np.ndarray:
    values = b.column(column)
    return np.array(values.flatten(), np.float64).reshape(len(values), -1)


def best(query: np.ndarray, entry: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of every query: larger score, then smaller entry; an entry counts once."""
    order = np.lexsort((entry, -score, query))
    q, e = query[order], entry[order]
    # Copies of an entry found in several tables stand together unless rounding parts them.
    pair = np.lexsort((np.arange(len(q)), e, q))
    once = np.zeros(len(q), bool)
    once[pair[np.concatenate([[True], (q[pair][1:] != q[pair][:-1]) | (e[pair][1:] != e[pair][:-1])])]] = True
    order, q = order[once], q[once]
    start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[rank < k]


def top_of_block(ids: np.ndarray, v: np.ndarray, queries: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, entry, score) of the k best entries of a block, and all that tie with the last, for every query."""
    s = q @ v.T
    if s.shape[1] > k:
        edge = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        i, j = np.nonzero(s >= edge[:, None])
    else:
        i, j = (x.ravel() for x in np.indices(s.shape))
    return queries[i], ids[j], s[i, j]


def _lists(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> pa.RecordBatch:
    q, e, s = (np.concatenate([f[x] for f in found]) for x in range(3))
    keep = best(q, e, s, k)
    q, e, s = q[keep], e[keep], s[keep]
    start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
    offsets = pa.array(np.append(start, len(q)), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(q[start]), pa.ListArray.from_arrays(offsets, pa.array(e)), pa.ListArray.from_arrays(offsets, pa.array(s))], names=["q", "e", "s"])


FOUND = "q bigint, e array<bigint>, s array<double>"


def merged(found: DataFrame, k: int) -> DataFrame:
    """One row for each query: the k best of its lists."""

    def run(batches):
        held, size, last = [], 0, None
        for b in batches:
            q = np.array(b.column("q"))
            lists = np.diff(np.array(b.column("e").offsets))
            e, s = (np.array(b.column(c).flatten()) for c in ("e", "s"))
            held.append((np.repeat(q, lists), e, s))
            size += len(e)
            last = q[-1]
            if size > HELD:  # rows come in order of q: only the last query may go on
                every = tuple(np.concatenate([h[x] for h in held]) for x in range(3))
                done = every[0] != last
                if done.any():
                    yield _lists([tuple(x[done] for x in every)], k)
                held = [tuple(x[~done] for x in every)]
                keep = best(*held[0], k)
                held = [tuple(x[keep] for x in held[0])]
                size = len(held[0][0])
        if held and size:
            yield _lists(held, k)

    return found.repartition("q").sortWithinPartitions("q").mapInArrow(run, FOUND)


def search(entries: DataFrame, entries_rows: int, queries: DataFrame, hashing: CrossPolytope, probes: int, k: int) -> DataFrame:
    """The k best entries (id, v) found for every query (id, v): rows (q, e, s)."""
    every = probes >= 2 * hashing.axes
    tables = 1 if every else hashing.tables

    slots_ = 2 * hashing.axes
    parts = 1 if every else max(1, min(slots_, entries_rows // PART_ROWS))  # of a table

    def place(batches, query: bool):
        for b in batches:
            unit = hashing.unit(_matrix(b), query)
            slots = [hashing.probes(unit, t, probes) + slots_ * t if query else (hashing.buckets(unit, t) + slots_ * t)[:, None] for t in range(tables)]
            slots = np.hstack(slots)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(slots) + 1) * slots.shape[1], pa.int32()), pa.array(slots.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), lists], names=["id", "v", "slots"])

    placed = "id bigint, v array<double>, slots array<int>"
    posted = stored(entries.select("id", "v").mapInArrow(lambda x: place(x, False), placed), "posted")
    asked = queries.select("id", "v").mapInArrow(lambda x: place(x, True), placed)
    part = lambda slot: F.floor(slot * F.lit(parts) / F.lit(slots_)).cast("int")
    # As many rows as tables x 2 x axes at most.
    sizes = posted.select(F.explode("slots").alias("slot")).groupBy("slot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    per_part = sizes.groupBy(part(F.col("slot")).alias("part")).agg(F.max("blocks").alias("blocks"))
    stand = (posted.select("id", "v", F.explode("slots").alias("slot")).join(F.broadcast(sizes), "slot")
             .select(part(F.col("slot")).alias("part"), F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.lit(0).alias("kind"), "id", "v", F.array("slot").alias("slots")))
    visit = asked.select("id", "v", "slots", F.explode(F.array_distinct(F.transform("slots", part))).alias("part")).join(F.broadcast(per_part), "part")
    visit = visit.select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), "id", "v", F.filter("slots", lambda x: part(x) == F.col("part")).alias("slots"))

    def compare(batches):
        found, size = [], 0
        at, held, block = None, [], None
        for b in batches:
            group = np.array(b.column("part"), np.int64) * (1 << 31) + np.array(b.column("block"), np.int64)
            kind, number, v = np.array(b.column("kind")), np.array(b.column("id")), _matrix(b)
            lists = np.diff(np.array(b.column("slots").offsets))
            slots, first = np.array(b.column("slots").flatten()), np.append(0, np.cumsum(lists))
            edges = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (kind[1:] != kind[:-1]), [True]]))
            for lo, hi in zip(edges[:-1], edges[1:]):
                if group[lo] != at:
                    at, held, block = group[lo], [], None
                if kind[lo] == 0:
                    held.append((slots[first[lo]:first[hi]], number[lo:hi], v[lo:hi]))
                    continue
                if not held:
                    continue
                if block is None:  # entries in order of their bucket
                    block = [np.concatenate([h[x] for h in held]) for x in range(3)]
                    order = np.argsort(block[0], kind="stable")
                    block = [x[order] for x in block]
                wanted, who = slots[first[lo]:first[hi]], np.repeat(np.arange(lo, hi), lists[lo:hi])
                order = np.argsort(wanted, kind="stable")
                wanted, who = wanted[order], who[order]
                cut = np.flatnonzero(np.concatenate([[True], wanted[1:] != wanted[:-1], [True]]))
                left, right = (np.searchsorted(block[0], wanted[cut[:-1]], side) for side in ("left", "right"))
                for c, d, x, y in zip(cut[:-1], cut[1:], left, right):
                    if x < y:
                        found.append(top_of_block(block[1][x:y], block[2][x:y], number[who[c:d]], v[who[c:d]], k))
                        size += len(found[-1][0])
                if size > HELD:
                    every_ = tuple(np.concatenate([f[x] for f in found]) for x in range(3))
                    keep = best(*every_, k)
                    found, size = [tuple(x[keep] for x in every_)], len(keep)
                    if size > HELD // 2:
                        yield _lists(found, k)
                        found, size = [], 0
        if size:
            yield _lists(found, k)

    both = stand.unionByName(visit).repartition("part", "block").sortWithinPartitions("part", "block", "kind")
    return merged(both.mapInArrow(compare, FOUND), k)


def vectors(table: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v): the rows that take part, each once, as doubles."""
    v = F.col(vector).cast("array<double>")
    rows = table.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).where(F.col("v").isNotNull() & F.col("id").isNotNull()).where(_clean())
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (sizes["n"] if sizes else 0))


def _clean() -> Column:
    return F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))


def distinct_vectors(rows: DataFrame, keep: int, is_query: Column) -> DataFrame:
    """(id, h, g, v, ids, asked): every vector once, with its ``keep`` smallest ids and whether a query has it.

    Ids are ranked under a salt first, so copies of one vector fill no task.
    """
    named = rows.select("id", "v", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g"), is_query.alias("asked"))
    salted = named.select("id", "h", "g", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).distinct()
    first = salted.withColumn("r", F.row_number().over(Window.partitionBy("h", "g", "salt").orderBy("id"))).where(F.col("r") <= keep)
    first = first.withColumn("r", F.row_number().over(Window.partitionBy("h", "g").orderBy("id"))).where(F.col("r") <= keep)
    ids = first.groupBy("h", "g").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    values = named.groupBy("h", "g").agg(F.any_value("v").alias("v"), F.max("asked").alias("asked"))
    return values.join(ids, ["h", "g"]).select(F.get("ids", F.lit(0)).alias("id"), "h", "g", "v", "ids", "asked")


def brute_force(entries: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(entry ids, vectors) of the k best entries for each of a few queries."""
    shared = entries.sparkSession.sparkContext.broadcast(q)

    def run(batches):
        held = None
        for b in batches:
            number, v = np.array(b.column("id")), _matrix(b)
            e, s, i = (np.tile(number, len(q)), (shared.value @ v.T).ravel(), np.repeat(np.arange(len(q)), len(number)))
            w = np.tile(np.arange(len(number)), len(q))
            keep = best(i, e, s, k)
            new = (i[keep], e[keep], s[keep], v[w[keep]])
            held = new if held is None else tuple(np.concatenate([a, c]) for a, c in zip(held, new))
            keep = best(*held[:3], k)
            held = tuple(x[keep] for x in held)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.int64()), pa.array(held[1], pa.int64()), pa.array(held[2]), pa.array(list(held[3]), pa.list_(pa.float64()))], names=["q", "e", "s", "v"])

    parts = entries.select("id", "v").mapInArrow(run, "q bigint, e bigint, s double, v array<double>")
    near = parts.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "e"))).where(F.col("r") <= k).collect()
    out = []
    for i in range(len(q)):
        mine = [r for r in near if r["q"] == i and r["e"] != ids[i]]
        out.append((np.array([r["e"] for r in mine]), np.array([r["v"] for r in mine]).reshape(len(mine), q.shape[1])))
    return out


def probes_for(recall: float, hashing: CrossPolytope, q: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]]) -> int:
    """The smallest number of probes a table that finds ``recall`` of the true neighbours of the sample."""
    owner = np.repeat(np.arange(len(near)), [len(n[0]) for n in near])
    if not len(owner):
        return 1
    v = np.concatenate([n[1] for n in near])
    rank = np.full(len(owner), 2 * hashing.axes)
    for t in range(hashing.tables):
        bucket = hashing.buckets(hashing.unit(v, False), t)
        order = hashing.probes(hashing.unit(q, True), t, 2 * hashing.axes)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :].repeat(len(order), 0), 1)
        rank = np.minimum(rank, place[owner, bucket])
    return int(np.sort(rank)[min(len(rank) - 1, int(np.ceil(recall * len(rank))) - 1)]) + 1


def nearest(table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest inner products found for every row where ``is_query`` (over ``id``)."""
    spark = ready(table.sparkSession)
    rows = vectors(table, id_col, vector)
    entries = stored(distinct_vectors(rows, k + 1, is_query), "vectors")
    stats = entries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("m")).first()
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    if not stats["n"]:
        return spark.createDataFrame([], empty)
    hashing = CrossPolytope(stats["d"], stats["n"], stats["m"])
    asked = entries.where("asked")
    sample = asked.orderBy(F.xxhash64("id")).limit(SAMPLE).select("id", "v").collect()
    if not sample:
        return spark.createDataFrame([], empty)
    ids, q = np.array([r["id"] for r in sample]), np.array([r["v"] for r in sample])
    probes = probes_for(recall, hashing, q, brute_force(entries, ids, q, k + 1))
    found = stored(search(entries, stats["n"], asked, hashing, probes, k + 1), "found")
    enough = min(k + 1, stats["n"])
    short = asked.join(found.where(F.size("e") >= enough).select(F.col("q").alias("id")), "id", "left_anti")
    if short.limit(1).count():
        rest = stored(search(entries, stats["n"], short, hashing, 2 * hashing.axes, k + 1), "found")
        found = found.where(F.size("e") >= enough).unionByName(rest)
    pairs = found.select("q", F.explode("e").alias("e"))
    far = entries.select(F.col("id").alias("e"), F.col("v").alias("w"), "ids")
    own = entries.select(F.col("id").alias("q"), "h", "g", "v")
    dot = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.join(far, "e").join(own, "q").select("q", "h", "g", dot.alias("score"), "ids")
    # All ids of equal vectors that can be among the k nearest of any query with this vector.
    listed = scored.select("q", "h", "g", "score", F.explode("ids").alias("vec_id"))
    listed = listed.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    near = listed.groupBy("h", "g").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))
    queries = rows.where(is_query).select(F.col("id").alias("query_id"), F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g")).distinct()
    mine = queries.join(near, ["h", "g"]).select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    out = mine.select("query_id", F.posexplode("near").alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
