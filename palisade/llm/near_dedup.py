"""MinHash near-dedup by an inverted join over signature coordinates.

1. Every text becomes its set of word shingles and a signature of ``COORDINATES`` minima. Texts with equal sets
   are one class from here on, so copies are never compared.
2. Classes are posted under each (coordinate, value). Two classes linked by the threshold agree in at least
   ``LEAST_EQUAL`` coordinates but for a chance of about 1e-5, and then share a posting list even when each class
   leaves out its ``LEAST_EQUAL - 1`` most frequent values (prefix); values that no other class has are never
   posted. So lists of common passages are skipped, and a class without a partner posts nothing.
3. Classes that share a list form families (connected through the smallest class of a list; no pairs). Members of
   a family are compared in blocks of bounded size: coordinates are counted, pairs that agree in ``LEAST_EQUAL``
   are confirmed on the full sets, most alike first, and pairs that are already connected are skipped. A family of
   several blocks is dealt into blocks twice, and then what is still outside its largest component is compared
   with all of it, block by block, so no link between components is lost.
4. Links give components; the document with the smallest doc_id stays.

Null or blank text: empty set, linked with nothing, kept. Fewer than ``WORDS`` words: the whole sequence is the one
shingle. Null doc_id: never the smallest unless there is no other. Repeated rows: equal results. Empty table:
empty result. Extra columns are kept.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import components, ready, slices, stored

WORDS = 5
PERCENT = 85
COORDINATES = 64
LEAST_EQUAL = 42
BLOCK_CLASSES = 4096
BLOCK_SHINGLES = 2_000_000
REMEMBERED = 300_000
SEED = 20240229


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1 << 62, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Shingler:
    """Hashed word shingles of texts; remembers hashes of words."""

    def __init__(self, words: int = WORDS):
        from xxhash import xxh3_64_intdigest

        class Hashes(dict):
            def __missing__(self, word):
                self[word] = h = xxh3_64_intdigest(word)
                return h

        self.words, self.known = words, Hashes()
        self.place = _odd(words, SEED)

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingle hashes."""
        split = text.encode().lower().split() if text else []
        if not split:
            return np.zeros(0, np.uint64)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        h = np.fromiter(map(self.known.__getitem__, split), np.uint64, len(split))
        k = min(self.words, len(h))
        n = len(h) - k + 1
        out = np.full(n, k, np.uint64)
        for j in range(k):
            out += h[j:j + n] * self.place[j]
            out ^= out >> np.uint64(31)
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        return np.unique(out)


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Minima per coordinate for every non-empty set; zeros for empty ones."""
    out = np.zeros((len(sets), coordinates), np.int64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        joined = np.concatenate([sets[i] for i in full])
        starts = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
        for c, a in enumerate(_odd(coordinates, SEED + 1)):
            v = joined * a
            v ^= v >> np.uint64(32)
            out[full, c] = np.minimum.reduceat(v, starts).view(np.int64)
    return out


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("k1"), F.hash("text").alias("k2"), "text")


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, n_shingles, node, signature): node names the set, null for an empty one."""
    base = _identified(docs)

    def sign(batches):
        from xxhash import xxh3_64_intdigest

        shingle = Shingler()
        for b in slices(batches, "text", 4_000_000):
            sets = [shingle(t) for t in b.column("text").to_pylist()]
            nodes = [xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets]
            values = pa.array(signatures(sets, COORDINATES).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * COORDINATES, pa.int32()), values)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("k1"), b.column("k2"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), lists],
                names=["doc_id", "k1", "k2", "n_shingles", "node", "signature"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(sign, f"doc_id {kind}, k1 bigint, k2 int, n_shingles bigint, node bigint, signature array<bigint>")


def least_equal_for(percent: int, coordinates: int = COORDINATES, miss: float = 1e-5) -> int:
    """The largest number of equal coordinates that a pair at ``percent`` falls short of with a chance of ``miss`` at most."""
    p, below = percent / 100, 0.0
    for k in range(coordinates + 1):
        below += comb(coordinates, k) * p**k * (1 - p) ** (coordinates - k)
        if below > miss:
            return k
    return coordinates


def postings(classes: DataFrame, coordinates: int = COORDINATES, least: int = LEAST_EQUAL) -> DataFrame:
    """(node, key): every class under its values that others have too, but for its least - 1 most frequent ones."""
    posted = classes.select("node", F.posexplode("signature").alias("c", "v")).select("node", F.xxhash64("c", "v").alias("key"))
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = posted.join(shared, "key")
    by_node = Window.partitionBy("node")  # at most ``coordinates`` rows
    ranked = rows.withColumn("r", F.row_number().over(by_node.orderBy(F.desc("n"), "key")))
    return ranked.where(F.col("r") >= least).select("node", "key")


def families(posted: DataFrame) -> DataFrame:
    """(node, family) of the classes that share posting lists, directly or through others."""
    head = posted.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("z")).where("b <> z").select("key", "b")
    edges = posted.join(head, "key").select(F.col("node").alias("a"), "b").where("a <> b").distinct()
    return components(edges).select("node", F.col("component").alias("family"))


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, labels: np.ndarray):
        first: dict[int, int] = {}
        self.up = np.array([first.setdefault(x, i) for i, x in enumerate(labels.tolist())], dtype=np.int64)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            nxt = up[up]
            if (nxt == up).all():
                return up
            self.up = up = nxt

    def join(self, a: int, b: int) -> None:
        self.up[max(a, b)] = min(a, b)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def links(signature: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, left: np.ndarray | None = None, percent: int = PERCENT, least_equal: int = LEAST_EQUAL) -> list[tuple[int, int]]:
    """Confirmed links that connect different labels: enough of them to connect all that any link connects.

    ``left``: compare these members with all; by default all with all.
    """
    g = len(sets)
    rows = np.arange(g) if left is None else left
    forest = Forest(labels)
    size = np.array([len(s) for s in sets])
    low = np.ascontiguousarray(signature.T.astype(np.int32))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for start in range(0, len(rows), 512):
        some = rows[start:start + 512]
        equal = np.zeros((len(some), g), np.uint8)
        for c in low:
            equal += c[some][:, None] == c[None, :]
        i, j = np.nonzero(equal >= least_equal)
        n = equal[i, j]
        i = some[i]
        keep = (labels[i] != labels[j]) & (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j]))
        keep &= (i < j) if left is None else (i != j)
        found.append((i[keep], j[keep], n[keep]))
    i, j, n = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, int) for k in range(3))
    order = np.argsort(-n.astype(int), kind="stable")
    i, j = i[order], j[order]
    out = []
    for start in range(0, len(i), 5000):
        root = forest.roots()
        a, b = i[start:start + 5000], j[start:start + 5000]
        open_ = root[a] != root[b]
        for x, y in zip(a[open_].tolist(), b[open_].tolist()):
            rx, ry = forest.root(x), forest.root(y)
            if rx != ry and similar(sets[x], sets[y], percent):
                forest.join(rx, ry)
                out.append((x, y))
    return out


def linked(groups: DataFrame, percent: int = PERCENT, least_equal: int = LEAST_EQUAL) -> DataFrame:
    """(a, b): links within every group of rows (group, node, label, side, signature, shingles); side 1 rows are
    compared with all of their group, or all with all where every row is of side 1."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        current = None

        def solve():
            t = pa.Table.from_batches(held).combine_chunks()
            node = t.column("node").to_numpy()
            side = t.column("side").to_numpy()
            # One row for each node: repeated rows and members on both sides come twice.
            order = np.lexsort((-side, node))
            order = order[np.concatenate([[True], node[order][1:] != node[order][:-1]])]
            node, side, label = node[order], side[order], t.column("label").to_numpy()[order]
            blobs = t.column("shingles").to_pylist()
            sets = [np.frombuffer(blobs[k], np.uint64) for k in order]
            signature = np.array(t.column("signature").combine_chunks().flatten()).reshape(-1, COORDINATES)[order]
            left = None if side.all() else np.flatnonzero(side)
            pairs = links(signature, sets, label, left, percent, least_equal)
            return pa.RecordBatch.from_arrays([pa.array([node[x] for x, _ in pairs], pa.int64()), pa.array([node[y] for _, y in pairs], pa.int64())], names=["a", "b"])

        for b in batches:
            keys = b.column("group").to_pylist()
            start = 0
            for k in range(len(keys) + 1):
                if k == len(keys) or keys[k] != (current if k == start else keys[start]):
                    if k > start:
                        held.append(b.slice(start, k - start))
                        current = keys[start]
                    if k < len(keys):
                        if held:
                            yield solve()
                        held, start, current = [], k, keys[k]
        if held:
            yield solve()

    cols = ["group", "node", "label", "side", "signature", "shingles"]
    return groups.select(*cols).repartition("group").sortWithinPartitions("group").mapInArrow(run, "a bigint, b bigint")


def member_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` (node, k1, k2, ...) with their shingle sets, read again from the texts."""
    names = [c for c in members.columns if c not in ("k1", "k2")]
    rows = _identified(docs).select("k1", "k2", "text").join(members, ["k1", "k2"]).select(*names, "text")

    def shingled(batches):
        shingle = Shingler()
        for b in slices(batches, "text", 4_000_000):
            blobs = [shingle(t).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(blobs, pa.binary())], names=[*names, "shingles"])

    return rows.mapInArrow(shingled, ", ".join(f"{n} {members.schema[n].dataType.simpleString()}" for n in names) + ", shingles binary")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, least_equal: int = LEAST_EQUAL) -> DataFrame:
    """(doc_id, k1, k2, n_shingles, component_id, kept) per row; sets are linked that share ``percent`` of 100 shingles.

    ``least_equal`` coordinates must agree before a pair is confirmed: ``least_equal_for(percent)`` or fewer.
    """
    spark = ready(docs.sparkSession)
    rows = stored(signed(docs), "signed")
    full = rows.where("node is not null")
    classes = full.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("m"), F.any_value("n_shingles").alias("n"), F.any_value("signature").alias("signature"))
    classes = stored(classes.select("node", F.col("m.doc_id").alias("doc"), F.col("m.k1").alias("k1"), F.col("m.k2").alias("k2"), "n", "signature"), "classes")
    family = families(stored(postings(classes, least=least_equal), "postings"))
    sized = classes.join(family, "node")
    blocks = sized.groupBy("family").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    members = sized.join(blocks, "family").select("node", "family", "blocks", "k1", "k2", "n", "signature")
    members = stored(member_sets(docs, members), "members")

    def block(seed: int, count):
        return F.pmod(F.xxhash64("node", F.lit(seed)), count)

    edges = None
    for seed in (1, 2):  # the second deal only for families of several blocks
        some = members if edges is None else members.where("blocks > 1")
        some = some.withColumn("label", F.col("node")) if edges is None else _labelled(some, edges)
        dealt = some.withColumn("group", F.struct("family", block(seed, F.col("blocks")).alias("b"))).withColumn("group", F.concat_ws(":", "group.family", "group.b")).withColumn("side", F.lit(1))
        new = stored(linked(dealt, percent, least_equal), "links")
        edges = new if edges is None else edges.unionByName(new)
        if not members.where("blocks > 1").limit(1).count():
            break
    else:
        edges = edges.unionByName(stored(linked(_outside(members, edges, block), percent, least_equal), "links"))
    found = components(edges) if edges.limit(1).count() else spark.createDataFrame([], "node bigint, component bigint")
    reach = classes.join(found, "node", "left").select("node", "doc", F.coalesce("component", "node").alias("component"))
    smallest = reach.groupBy("component").agg(F.min("doc").alias("component_id"))
    named = reach.join(smallest, "component").select("node", "component_id")
    out = rows.drop("signature").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "k1", "k2", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def _labelled(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Members with ``label``, the component they are in so far."""
    found = components(edges)
    return members.drop("label").join(found, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")


def _outside(members: DataFrame, edges: DataFrame, block) -> DataFrame:
    """Groups that compare what is outside the largest component of its family with the whole family."""
    some = stored(_labelled(members.where("blocks > 1"), edges), "labelled")
    sizes = some.groupBy("family", "label").agg(F.count(F.lit(1)).alias("c"))
    largest = sizes.groupBy("family").agg(F.max(F.struct("c", "label")).alias("top")).select("family", F.col("top.label").alias("top"))
    marked = some.join(largest, "family")
    rest = marked.where("label <> top")
    parts = rest.groupBy("family").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    marked = marked.join(parts, "family")
    cell = lambda i, j: F.concat_ws(":", "family", i, j)
    a = marked.where("label <> top").withColumn("i", block(3, F.col("parts"))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).withColumn("side", F.lit(1))
    b = marked.withColumn("j", block(4, F.col("blocks"))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).withColumn("side", F.lit(0))
    return a.unionByName(b).withColumn("group", cell("i", "j"))


def deduplicated(docs: DataFrame, percent: int = PERCENT, least_equal: int = LEAST_EQUAL) -> DataFrame:
    """``docs`` with one row of each group of near copies: that with the smallest doc_id; repeated rows stay once."""
    names = docs.columns
    keep = near_duplicates(docs, percent, least_equal).where("kept").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct()
    keyed = docs.withColumn("__k1", F.xxhash64("doc_id", "text")).withColumn("__k2", F.hash("text"))
    kept = keyed.join(keep, ["__k1", "__k2"], "left_semi").dropDuplicates(["__k1", "__k2"])
    return kept.select(*[F.col(f"`{c}`") for c in names])
