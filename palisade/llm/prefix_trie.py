"""The prefix trie of conversations, built around the skeleton of its range-partition splitters.

A conversation is its path: one digest a turn, 16 bytes, joined, so equal beginnings are equal prefixes and byte order
keeps every node's members together. Splitters from a sample of the rows cut that order into shards. A node whose
members lie on both sides of a splitter is a prefix of the splitter; all such nodes are the trie of the splitter paths,
the skeleton, which is broadcast. Every other node has all its members in one shard and is finished there in one pass
over the sorted rows, with a stack as deep as the path. For skeleton nodes a shard gives partial aggregates; these are
summed per node, and what skeleton nodes add to their ancestors follows from the skeleton's own order.

The conversations that end in a node are hashed in the order of their ids. A skeleton node may have any number of them
(a conversation that a third of all repeat): shards write their ids in chunks of text, and one stream a node hashes the
chunks, which is all that a hash over the whole list leaves to one task.

Bounds: the skeleton has at most ``MOST_NODES`` nodes (splitters are thinned, so shards get larger, no row is left out);
splitter paths are cut after ``SPLITTER_TURNS`` turns, which moves a splitter and changes no result. A conversation of n
turns is a row of 20 n bytes.

Input: ``conv_id, turn, role, text``. Rows without a conv_id belong to no conversation. A null turn comes first; rows
with equal turns stand in the order of their digests, so repeated rows are turns of their own. A null role or text is
empty. An empty table has no node, not even a root. Extra columns play no part.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import ready, stored

WIDTH = 16
SHARD_BYTES = 8_000_000
SAMPLE_PER_SHARD = 8
MOST_SHARDS = 4000
MOST_NODES = 1_000_000
SPLITTER_TURNS = 256
CHUNK_IDS = 4096
HEAD = 9

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
#: kind: a finished node, a finished node below a skeleton node, a shard's part of a skeleton node, a chunk of ids
DONE, BELOW, PART, CHUNK = range(4)
SHARDED = ("kind int, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
           "saved_tokens bigint, size bigint, ends_sha256 string, skeleton int, shard int, seq int")


def turn_digest() -> Column:
    """16 bytes, as hexadecimal text, that tell (role, text) apart."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * WIDTH)


def ordered_turns(conversations: DataFrame, by: Column) -> DataFrame:
    """(base, conv_id, turns): the turns of every conversation in order, as (turn, digest, bytes), dealt by ``base``."""
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        by.alias("base"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn_digest().alias("digest"),
        F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("size"))
    return turns.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "size"))).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the first h turns of conversation c - c % 5, then c's own after its first h; h = crc32(c) % 9."""
    turns = ordered_turns(conversations, F.expr("cast(conv_id as bigint) - cast(conv_id as bigint) % 5"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).cast("int")
    heads = turns.where(F.col("conv_id") == F.col("base")).select("base", F.slice("turns", 1, HEAD - 1).alias("head"))
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    first = F.coalesce(F.slice("head", F.lit(1), h), F.slice("turns", 1, 0))
    return turns.join(heads, "base", "left").select("conv_id", F.concat(first, own).alias("turns"))


def as_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path, sizes) of (conv_id, turns): the digests joined, and the bytes of every turn's text."""
    digests = F.array_join(F.transform("turns", lambda t: t["digest"]), "")
    return turns.select("conv_id", F.unhex(digests).alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes"))


class Skeleton:
    """The trie of the splitters' paths, numbered from the root (0) in the order of the paths."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters = sorted(set(splitters))
        self.child: dict[tuple[int, bytes], int] = {}
        self.parent, self.depth = [-1], [0]
        for path, _ in self.splitters:
            node = 0
            for at in range(0, len(path), WIDTH):
                key = (node, path[at:at + WIDTH])
                node = self.child.get(key, -1)
                if node < 0:
                    node = self.child[key] = len(self.parent)
                    self.parent.append(key[0])
                    self.depth.append(at // WIDTH + 1)

    @staticmethod
    def of(splitters: list[tuple[bytes, int]], most: int = MOST_NODES) -> Skeleton:
        """With every second splitter left out until at most ``most`` nodes remain."""
        while True:
            made = Skeleton(splitters)
            if len(made.parent) <= most:
                return made
            splitters = made.splitters[::2] if len(made.splitters) > 1 else []


def splitters(paths: DataFrame, shards: int, per_shard: int = SAMPLE_PER_SHARD) -> list[tuple[bytes, int]]:
    """Quantiles of the rows with the smallest hashes: at most ``shards`` - 1 places in the order of the paths."""
    if shards < 2:
        return []
    cut = F.substring("path", 1, WIDTH * SPLITTER_TURNS).alias("path")
    rows = paths.select(F.xxhash64("conv_id").alias("h"), "conv_id", cut).orderBy("h", "conv_id").limit(shards * per_shard).collect()
    places = sorted((bytes(r["path"]), r["conv_id"]) for r in rows)
    return [places[len(places) * i // shards] for i in range(1, shards)] if places else []


class _Shard:
    """One pass over the rows of shards in order; finished rows gather in ``out``."""

    def __init__(self, child: dict[tuple[int, bytes], int]):
        self.child, self.out, self.shard = child, [], None

    def start(self, shard: int) -> None:
        self.shard, self.path, self.seq = shard, b"", 0
        # a node: smallest member, members, children, leaves and saved tokens below, bytes, skeleton number, ids or hash, rows that wait
        self.stack = [self._node(0, 0)]

    @staticmethod
    def _node(size: int, skeleton: int) -> list:
        return [None, 0, 0, 0, 0, size, skeleton, [] if skeleton >= 0 else None, []]

    def add(self, path: bytes, conv_id: int, sizes: list[int]) -> None:
        stack, last, top = self.stack, self.path, min(len(path), len(self.path))
        if path[:top] == last[:top]:
            shared = top
        else:
            shared = 0
            while path[shared:shared + WIDTH] == last[shared:shared + WIDTH]:
                shared += WIDTH
        while len(stack) - 1 > shared // WIDTH:
            self._close()
        for at in range(shared, len(path), WIDTH):
            above = stack[-1][6]
            stack.append(self._node(sizes[at // WIDTH], self.child.get((above, path[at:at + WIDTH]), -1) if above >= 0 else -1))
        self.path = path
        node = stack[-1]
        node[0] = conv_id if node[0] is None else min(node[0], conv_id)
        node[1] += 1
        if node[6] >= 0:
            node[7].append(conv_id)
            if len(node[7]) == CHUNK_IDS:
                self._chunk(node)
        elif node[7] is None:
            node[7] = hashlib.sha256(str(conv_id).encode())
        else:
            node[7].update(f",{conv_id}".encode())

    def _chunk(self, node: list) -> None:
        text = ",".join(map(str, node[7]))
        self.out.append((CHUNK, None, None, None, None, None, None, None, None, text, node[6], self.shard, self.seq))
        self.seq += 1
        node[7] = []

    def _close(self) -> None:
        least, convs, children, leaves, saved, size, skeleton, ends, waiting = self.stack.pop()
        depth, above = len(self.stack), self.stack[-1] if self.stack else None
        if skeleton >= 0:
            if ends:
                self._chunk([None] * 6 + [skeleton, ends])
            self.out.append((PART, least, depth, None, convs, children, leaves, saved, size, None, skeleton, self.shard, None))
        else:
            leaves, saved = leaves or 1, saved + (convs - 1) * size
            self.out.extend((DONE, r[0], r[1], least, *r[2:], None, None, None) for r in waiting)
            row = (least, depth, convs, children, leaves, saved, None, (ends or hashlib.sha256()).hexdigest())
            if above[6] >= 0:
                self.out.append((BELOW, least, depth, None, *row[2:], above[6], None, None))
            else:
                above[8].append(row)
            above[2] += 1
        if above is not None:
            above[0] = least if above[0] is None else min(above[0], least)
            above[1] += convs
            above[3] += leaves
            above[4] += saved

    def finish(self) -> None:
        while self.shard is not None and self.stack:
            self._close()


def _sharded(paths: DataFrame, skeleton: Skeleton, partitions: int) -> DataFrame:
    sent = paths.sparkSession.sparkContext.broadcast((skeleton.splitters, skeleton.child))
    names = [c.split()[0] for c in SHARDED.split(", ")]
    types = [pa.int32() if c.endswith(" int") else pa.string() if c.endswith("string") else pa.int64() for c in SHARDED.split(", ")]
    schema = pa.schema(list(zip(names, types)))

    def deal(batches):
        places = sent.value[0]
        for b in batches:
            rows = zip(b.column("path").to_pylist(), b.column("conv_id").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([bisect_right(places, r) for r in rows], pa.int32()), *b.columns], names=["shard", *b.schema.names])

    def passes(batches):
        work = _Shard(sent.value[1])
        for b in batches:
            flat, ends = b.column("sizes").flatten().to_pylist(), np.array(b.column("sizes").offsets) - b.column("sizes").offsets[0].as_py()
            for i, (shard, conv_id, path) in enumerate(zip(*(b.column(c).to_pylist() for c in ("shard", "conv_id", "path")))):
                if shard != work.shard:
                    work.finish()
                    work.start(shard)
                work.add(path, conv_id, flat[ends[i]:ends[i + 1]])
            if len(work.out) > 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*work.out), types)], schema=schema)
                work.out = []
        work.finish()
        for at in range(0, len(work.out), 2000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*work.out[at:at + 2000]), types)], schema=schema)

    dealt = paths.mapInArrow(deal, "shard int, conv_id bigint, path binary, sizes array<int>")
    return dealt.repartition(partitions, "shard").sortWithinPartitions("shard", "path", "conv_id").mapInArrow(passes, SHARDED)


def _hashed(chunks: DataFrame) -> DataFrame:
    """(skeleton, ends): one streaming hash a skeleton node over its chunks in order."""

    def run(batches):
        node, digest = None, None
        for b in batches:
            done = []
            for skeleton, text in zip(b.column("skeleton").to_pylist(), b.column("ends_sha256").to_pylist()):
                if skeleton != node:
                    if node is not None:
                        done.append((node, digest.hexdigest()))
                    node, digest = skeleton, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int32()), pa.array([d[1] for d in done])], names=["skeleton", "ends"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int32()), pa.array([digest.hexdigest()])], names=["skeleton", "ends"])

    return chunks.repartition("skeleton").sortWithinPartitions("skeleton", "shard", "seq").mapInArrow(run, "skeleton int, ends string")


def _skeleton_nodes(parts: DataFrame, skeleton: Skeleton) -> DataFrame:
    """(skeleton, node columns but the hash): the parts summed in Spark, at most ``MOST_NODES`` sums added up along the skeleton."""
    sums = parts.groupBy("skeleton").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("size").alias("size"))
    got = sums.select("skeleton", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "size").toPandas().sort_values("skeleton")
    n = len(skeleton.parent)
    least, convs, children, leaves, saved, size = (np.zeros(n, np.int64) for _ in range(6))
    at = got["skeleton"].to_numpy(np.int64)
    for a, c in ((least, "conv_id"), (convs, "n_convs"), (children, "n_children"), (leaves, "n_leaves"), (saved, "saved_tokens"), (size, "size")):
        a[at] = got[c].to_numpy(np.int64)
    parent = np.array(skeleton.parent)
    np.add.at(children, parent[1:], 1)
    own_leaf, own_saved = (children == 0).astype(np.int64), (convs - 1) * size
    for i in range(n - 1, -1, -1):  # a parent has a smaller number than its children
        leaves[i] += own_leaf[i]
        saved[i] += own_saved[i]
        if i:
            own_leaf[parent[i]] += own_leaf[i]
            own_saved[parent[i]] += own_saved[i]
    above = pa.array(np.where(parent >= 0, least[parent], 0), mask=parent < 0)
    table = pa.table({"skeleton": pa.array(np.arange(n), pa.int32()), "conv_id": least, "depth": pa.array(skeleton.depth, pa.int64()), "parent_conv_id": above,
                      "n_convs": convs, "n_children": children, "n_leaves": leaves, "saved_tokens": saved})
    return parts.sparkSession.createDataFrame(table.filter(pa.array(convs > 0)))


def prefix_trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """One row a node of the trie of ``paths`` (conv_id, path, sizes); the module says what it returns."""
    spark = ready(paths.sparkSession)
    paths = stored(paths, "paths")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if shards is None:
        total = paths.agg(F.sum(F.length("path") + 16)).first()[0] or 0
        shards = min(MOST_SHARDS, max(partitions, total // SHARD_BYTES))
    skeleton = Skeleton.of(splitters(paths, shards))
    out = stored(_sharded(paths, skeleton, max(partitions, shards)), "trie")
    nodes = _skeleton_nodes(out.where(F.col("kind") == PART), skeleton)
    hashes = _hashed(out.where(F.col("kind") == CHUNK))
    top = nodes.join(hashes, "skeleton", "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(hashlib.sha256().hexdigest()))).select(*COLUMNS)
    # at most MOST_NODES pairs of numbers
    least = F.broadcast(nodes.select("skeleton", F.col("conv_id").alias("above")))
    below = out.where(F.col("kind") == BELOW).join(least, "skeleton").withColumn("parent_conv_id", F.col("above")).select(*COLUMNS)
    return out.where(F.col("kind") == DONE).select(*COLUMNS).unionByName(below).unionByName(top)


def conversation_trie(conversations: DataFrame, shards: int | None = None) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of every node of the rebuilt conversations."""
    return prefix_trie(as_paths(rebuilt(conversations)), shards)
