"""Exact substring dedup with a logarithmic family of suffix arrays.

A byte goes when a string of ``LEAST`` bytes that covers it also starts in a document with a smaller doc_id.

* The suffix space is cut by content: a string of ``LEAST`` bytes belongs to the smallest hash of the ``GRAM``-byte
  grams inside it, so equal strings meet in one bucket wherever they stand. Runs of consecutive strings with one
  smallest hash travel together.
* First only (hash, row, run) are dealt to buckets; runs whose hash no other row has can't repeat and end there.
* The bytes of the other runs are dealt to the buckets again. A bucket takes them in the order of doc_id in
  batches: every new batch gets a suffix array, is merge-scanned against the existing levels for strings of
  ``LEAST`` bytes, and becomes a level; levels of equal size merge, so sizes grow geometrically and every suffix is
  merged a logarithmic number of times. Levels hold a string once, with the smallest doc_id it starts in.
* The spans found are joined back to the texts, by the one exchange of the texts that brought them their runs.

A text that as a whole also stands in a smaller document is removed as a whole and takes no part in the second
deal: what starts in it starts in that smaller document, too.

Null text: empty. Null doc_id: before all others. Rows with one doc_id are one document: they don't cover each
other. Texts under ``LEAST`` bytes: nothing removed. Repeated rows: equal results. Empty table: empty result. Extra
columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import NULL_ID, ready, slices

LEAST = 50
GRAM = 20
CHUNK = 1 << 16
BATCH = 1 << 17
LEAST_BUCKETS = 128
BUCKET_BYTES = 8_000_000
SEED = 7


def _constants() -> tuple[np.ndarray, np.uint64]:
    r = np.random.default_rng(SEED)
    return r.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), np.uint64(0x9E3779B97F4A7C15)


BYTE, BASE = _constants()


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes at every position, by doubling."""
    with np.errstate(over="ignore"):
        h = {1: BYTE[data]}
        k, power = 1, BASE
        while 2 * k <= GRAM:
            h[2 * k] = h[k][:-k] * power + h[k][k:]
            power = power * power
            k *= 2
        out, length = h[k], k
        while length < GRAM:
            step = max(s for s in h if s <= GRAM - length)
            power = BASE
            for _ in range(step - 1):
                power = power * BASE
            n = len(data) - length - step + 1
            out = out[:n] * power + h[step][length:length + n]
            length += step
        out = out ^ (out >> np.uint64(32))
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
    return out


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        v = np.minimum(v[:-k], v[k:])
        k *= 2
    return np.minimum(v[:len(v) - (width - k)], v[width - k:]) if width > k else v


def runs(texts: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first string, strings, smallest hash) of every run of strings with one smallest hash."""
    found = []
    group: list[int] = []
    size = 0

    def solve():
        data = np.frombuffer(b"".join(texts[i] for i in group), np.uint8)
        smallest = sliding_min(gram_hashes(data), least - GRAM + 1)
        length = np.array([len(texts[i]) for i in group])
        start = np.cumsum(length) - length
        # Strings that start in a text and end in it.
        edge = np.zeros(len(smallest) + 1, bool)
        edge[0] = True
        np.not_equal(smallest[1:], smallest[:-1], out=edge[1:-1])
        edge[start[start < len(edge)]] = True
        stop = start + length - least + 1
        edge[stop[stop < len(edge)]] = True
        first = np.flatnonzero(edge[:-1])
        n = np.diff(np.append(first, len(smallest)))
        doc = np.searchsorted(start, first, side="right") - 1
        inside = first < stop[doc]
        first, n, doc = first[inside], n[inside], doc[inside]
        found.append((np.array(group)[doc], first - start[doc], n, smallest[first]))

    for i, t in enumerate(texts):
        if len(t) < least:
            continue
        group.append(i)
        size += len(t)
        if size >= CHUNK:
            solve()
            group, size = [], 0
    if group:
        solve()
    if not found:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate([f[k] for f in found]) for k in range(4))


def words(keys: np.ndarray) -> np.ndarray:
    """The strings as rows of numbers: quick to compare for equality."""
    return keys.view(np.uint64).reshape(len(keys), -1)


def differs(keys: np.ndarray) -> np.ndarray:
    """Where a string is another than the one before it."""
    w = words(keys)
    return np.concatenate([[True], (w[1:] != w[:-1]).any(axis=1)]) if len(keys) else np.zeros(0, bool)


class IndexFamily:
    """Levels of sorted strings with the smallest document each starts in."""

    def __init__(self, least: int):
        self.least, self.width = least, -(-least // 8) * 8
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def keys(self, rows: np.ndarray) -> np.ndarray:
        """Rows of ``least`` bytes as sortable strings, padded to whole numbers."""
        out = np.zeros((len(rows), self.width), np.uint8)
        out[:, :self.least] = rows
        return out.view(f"S{self.width}")[:, 0]

    @staticmethod
    def _distinct(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted keys each once, with its smallest document."""
        at = np.flatnonzero(differs(keys))
        return keys[at], np.minimum.reduceat(docs, at)

    def add(self, keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Index a batch; True for its strings that also start in a smaller document seen so far or in the batch."""
        order = np.argsort(keys, kind="stable")
        keys, docs = keys[order], docs[order]
        once, smallest = self._distinct(keys, docs)
        earliest = smallest.copy()
        for level, first in self.levels:
            at = np.searchsorted(level, once)  # both sorted: each search goes on from the last
            at[at == len(level)] = 0
            same = (words(level)[at] == words(once)).all(axis=1)
            earliest[same] = np.minimum(earliest[same], first[at[same]])
        which = np.cumsum(differs(keys)) - 1
        hit = np.empty(len(keys), bool)
        hit[order] = earliest[which] < docs
        self.levels.append((once, smallest))
        while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) >= len(self.levels[-2][0]):
            (a, da), (b, db) = self.levels.pop(), self.levels.pop()
            joined, docs_ = np.concatenate([a, b]), np.concatenate([da, db])
            merge = np.argsort(joined, kind="stable")  # two sorted runs: one merge
            self.levels.append(self._distinct(joined[merge], docs_[merge]))
        return hit


def _planes(a: np.ndarray) -> bytes:
    """The bytes of numbers by significance: the high ones of small numbers compress away."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b""


def _pack(**arrays: np.ndarray) -> bytes:
    body = b"".join(_planes(a) for a in arrays.values())
    return np.array([len(a) for a in arrays.values()], np.int64).tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, np.int64, len(kinds)).tolist()
    widths = [np.dtype(k).itemsize for k in kinds]
    body = np.frombuffer(pa.decompress(blob[8 * len(kinds):], sum(n * w for n, w in zip(sizes, widths)), codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for n, w, kind in zip(sizes, widths, kinds):
        out.append(np.ascontiguousarray(body[at:at + n * w].reshape(w, n).T).view(kind).reshape(n))
        at += n * w
    return out


RUN = (np.int64, np.uint16, np.uint32, np.uint32, np.uint32)  # rows; and for each run: row number, hash, first, strings
#: A run with a hash that another row has, and a span of bytes: blobs of such records.
HIT = np.dtype([("hash", np.uint32), ("first", np.uint32), ("n", np.uint32)])
SPAN = np.dtype([("s", np.uint32), ("e", np.uint32)])
PIECE = (np.int64, np.int64, np.int32, np.uint16, np.uint32, np.uint32, np.uint8)  # doc, k1, k2; row number, first, length; bytes


def by_bucket(df: DataFrame, buckets: int) -> DataFrame:
    return df.repartition(buckets, "bucket").sortWithinPartitions("bucket")


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The blobs of every bucket of a partition sorted by bucket."""
    held: list[bytes] = []
    current = None
    for b in batches:
        for bucket, blob in zip(b.column("bucket").to_pylist(), b.column("blob").to_pylist()):
            if bucket != current and held:
                yield held
                held = []
            current = bucket
            held.append(blob)
    if held:
        yield held


def _split(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    edges = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1], [True]])) if len(sorted_) else []
    for lo, hi in zip(edges[:-1], edges[1:]):
        yield int(sorted_[lo]), order[lo:hi]


def _bytes(b: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in b.column("text").cast(pa.binary()).to_pylist()]


def repeated_runs(base: DataFrame, least: int, buckets: int) -> DataFrame:
    """(k1, blob): runs of a row whose smallest hash another row has too."""

    def emit(batches):
        for b in slices(batches, "text"):
            doc, first, n, h = runs(_bytes(b), least)
            keys = np.array(b.column("k1"), np.int64)
            out: tuple[list, list] = ([], [])
            for bucket, at in _split((h % np.uint64(buckets)).astype(np.int64)):
                rows, local = np.unique(doc[at], return_inverse=True)
                out[0].append(bucket)
                out[1].append(_pack(rows=keys[rows], local=local.astype(np.uint16), hash=(h[at] >> np.uint64(32)).astype(np.uint32), first=first[at].astype(np.uint32), n=n[at].astype(np.uint32)))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], names=["bucket", "blob"])

    def compare(batches):
        for blobs in grouped(batches):
            parts = [_unpack(x, *RUN) for x in blobs]
            row = np.concatenate([p[0][p[1]] for p in parts])
            h, first, n = (np.concatenate([p[k] for p in parts]) for k in (2, 3, 4))
            order = np.lexsort((row, h))
            hs, rs = h[order], row[order]
            start = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]]))
            end = np.append(start[1:], len(hs))
            several = rs[start] != rs[end - 1]
            at = order[np.repeat(several, end - start)]
            del hs, rs, parts
            found = np.empty(len(at), HIT)
            found["hash"], found["first"], found["n"] = h[at], first[at], n[at]
            yield from _by_row(found, row[at])

    dealt = base.select("k1", "text").mapInArrow(emit, "bucket int, blob binary")
    return by_bucket(dealt, buckets).mapInArrow(compare, "k1 bigint, blob binary")


def _by_row(records: np.ndarray, k1: np.ndarray, k2: np.ndarray | None = None, most: int = 2000) -> Iterator[pa.RecordBatch]:
    """(k1, k2 if given, blob of its records) for every row."""
    order = np.argsort(k1, kind="stable") if k2 is None else np.lexsort((k2, k1))
    records, k1 = records[order], k1[order]
    new = np.concatenate([[True], k1[1:] != k1[:-1]]) if len(k1) else np.zeros(0, bool)
    if k2 is not None:
        k2 = k2[order]
        new[1:] |= k2[1:] != k2[:-1]
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(k1))
    for i in range(0, len(start), most):
        some = start[i:i + most]
        blobs = pa.array([records[lo:hi].tobytes() for lo, hi in zip(some.tolist(), end[i:i + most].tolist())], pa.binary())
        if k2 is None:
            yield pa.RecordBatch.from_arrays([pa.array(k1[some]), blobs], names=["k1", "blob"])
        else:
            yield pa.RecordBatch.from_arrays([pa.array(k1[some]), pa.array(k2[some]), blobs], names=["k1", "k2", "blob"])


def covered(base: DataFrame, candidates: DataFrame, copies: DataFrame, least: int, buckets: int) -> DataFrame:
    """(k1, k2, blob): spans of bytes to remove, found by the index families of the buckets."""

    def emit(batches):
        for b in slices(batches, "text"):
            docs, k1, k2 = (np.array(b.column(c)) for c in ("doc", "k1", "k2"))
            texts = _bytes(b)
            blobs = b.column("blobs").to_pylist()
            runs_ = np.frombuffer(b"".join(x for some in blobs for x in some), HIT)
            row = np.repeat(np.arange(len(texts)), [sum(map(len, some)) // HIT.itemsize for some in blobs]).astype(np.uint16)
            size = runs_["n"] + np.uint32(least - 1)
            fits = runs_["first"].astype(np.int64) + size <= np.array([len(t) for t in texts])[row]  # another row may share k1
            h, first, size, row = runs_["hash"][fits], runs_["first"][fits], size[fits], row[fits]
            out: tuple[list, list] = ([], [])
            # The upper bits of the hash: the lower ones chose the first bucket and aren't kept.
            for bucket, at in _split((h % np.uint32(buckets)).astype(np.int64)):
                rows, local = np.unique(row[at], return_inverse=True)
                pieces = b"".join(texts[r][f:f + s] for r, f, s in zip(row[at].tolist(), first[at].tolist(), size[at].tolist()))
                out[0].append(bucket)
                out[1].append(_pack(doc=docs[rows].astype(np.int64), k1=k1[rows].astype(np.int64), k2=k2[rows].astype(np.int32), local=local.astype(np.uint16), first=first[at], size=size[at], data=np.frombuffer(pieces, np.uint8)))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], names=["bucket", "blob"])

    def index(batches):
        for blobs in grouped(batches):
            parts = [_unpack(x, *PIECE) for x in blobs]
            doc, k1, k2 = (np.concatenate([p[k][p[3]] for p in parts]) for k in range(3))
            first, size = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in (4, 5))
            data = np.concatenate([p[6] for p in parts])
            del parts
            place = np.cumsum(size) - size
            order = np.lexsort((first, k2, k1, doc))
            # A piece that a smaller document has as a whole is hit as a whole and need not be indexed again.
            raw, seen = data.tobytes(), {}
            again = np.zeros(len(order), bool)
            for i, (at, n, d) in enumerate(zip(place[order].tolist(), size[order].tolist(), doc[order].tolist())):
                again[i] = seen.setdefault(raw[at:at + n], d) < d
            del raw, seen
            whole, order = order[again], order[~again]
            family = IndexFamily(least)
            strings = size - least + 1
            view = np.lib.stride_tricks.sliding_window_view(data, least)
            batch = np.cumsum(strings[order]) // BATCH
            edges = np.flatnonzero(np.concatenate([[True], batch[1:] != batch[:-1], [True]])) if len(batch) else np.zeros(0, int)
            spans = [(whole, first[whole], first[whole] + size[whole])]
            for lo, hi in zip(edges[:-1], edges[1:]):
                some = order[lo:hi]
                n = strings[some]
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                keys = family.keys(view[np.repeat(place[some], n) + step])
                piece = np.repeat(some, n)
                hit = family.add(keys, doc[piece])
                piece, at = piece[hit], (first[piece] + step)[hit]
                if len(piece):
                    s = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (at[1:] != at[:-1] + 1)]))
                    spans.append((piece[s], at[s], at[np.append(s[1:], len(at)) - 1] + least))
            piece, s, e = (np.concatenate([x[k] for x in spans]) for k in range(3))
            found = np.empty(len(s), SPAN)
            found["s"], found["e"] = s, e
            yield from _by_row(found, k1[piece], k2[piece])

    wanted = candidates.groupBy("k1").agg(F.collect_list("blob").alias("blobs")).join(copies, "k1", "left_anti")  # as many as buckets a row at most
    rows = base.join(wanted, "k1").select(F.coalesce("doc_id", F.lit(NULL_ID)).cast("bigint").alias("doc"), "k1", "k2", "text", "blobs")
    dealt = rows.mapInArrow(emit, "bucket int, blob binary")
    return by_bucket(dealt, buckets).mapInArrow(index, "k1 bigint, k2 int, blob binary")


def later_copies(docs: DataFrame, least: int) -> DataFrame:
    """k1 of the rows whose whole text also stands in a smaller document."""
    rows = docs.where(F.octet_length("text") >= least).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    first = rows.groupBy("t1", "t2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first <> last").drop("last")
    return rows.join(first, ["t1", "t2"]).where("doc > first").select("k1").distinct()


def merged(found: list[dict] | None, k2: int, length: int) -> list[tuple[int, int]]:
    """Maximal spans of the row with this k2, in order; a null blob stands for the whole text."""
    mine = [x["blob"] for x in found or [] if x["blob"] is None or x["k2"] == k2]
    if None in mine:
        return [(0, length)]
    if not mine:
        return []
    spans = np.frombuffer(b"".join(mine), SPAN)
    spans = spans[np.argsort(spans["s"], kind="stable")]
    s, e = spans["s"].astype(np.int64), np.maximum.accumulate(spans["e"].astype(np.int64))
    at = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
    return list(zip(s[at].tolist(), e[np.append(at[1:], len(s)) - 1].tolist()))


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def with_spans(docs: DataFrame, least: int = LEAST, buckets: int | None = None) -> DataFrame:
    """(doc_id, k1, k2, text, found): what was found in rows with this k1, to be read by ``merged``."""
    spark = ready(docs.sparkSession)
    # By bytes, whatever the cluster: a bucket of twice the bytes takes twice the memory.
    buckets = buckets or max(LEAST_BUCKETS, (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES)
    base = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.hash("text").alias("k2"))
    copies = later_copies(docs, least)
    spans = covered(base, repeated_runs(base, least, buckets), copies, least, buckets)
    spans = spans.unionByName(copies.select("k1", F.lit(None).cast("int").alias("k2"), F.lit(None).cast("binary").alias("blob")))
    found = spans.groupBy("k1").agg(F.collect_list(F.struct("k2", "blob")).alias("found"))  # as many as buckets a row at most
    return base.join(found, "k1", "left").select("doc_id", "k1", "k2", "text", "found")


def repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def measure(batches):
        for b in slices(batches, "text"):
            texts = _bytes(b)
            spans = [merged(x, k, len(t)) for x, k, t in zip(b.column("found").to_pylist(), b.column("k2").to_pylist(), texts)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([sum(y - x for x, y in s) for s in spans], pa.int64()),
                 pa.array([len(s) for s in spans], pa.int64()), pa.array([hashlib.sha256(cut(t, s)).hexdigest() for t, s in zip(texts, spans)], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_spans(docs, least).select("doc_id", "k2", "text", "found").mapInArrow(measure, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
