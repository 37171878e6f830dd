"""Benchmark decontamination by an FM-index per training shard.

Every task cuts its texts into shards, turns them into numbers of benchmark words and indexes those stretches
of a shard that are long enough to hold a benchmark phrase (nothing else can match). All phrases are searched
backwards through wavelet-tree ranks, occurrences are located by sampled suffix positions and merged to spans.
Documents are never shuffled. The benchmark reaches the tasks in blocks of ``BLOCK_WORDS`` words; with more than
one block the corpus is passed once per block and spans are merged, so no memory grows with the benchmark.

A phrase is ``WINDOW`` consecutive item words; an item of fewer, but not none, is one phrase. Null text (document
or item): no words. Repeated items or documents: each counts. Empty tables: no hits. Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import ready, slices, stored
from palisade.llm.fm_index import FmIndex

WINDOW = 10
BLOCK_WORDS = 500_000
#: Word bytes are digits, letters and everything beyond ASCII; A-Z is lowered.
WORD_BYTE = np.array([48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])
AS_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if WORD_BYTE[c] else 32 for c in range(256))
BREAK = 1


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(AS_WORDS).split() if text else []


class Phrases:
    """The phrases of a block of items, as rows of word numbers, and the items each belongs to."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        self.items = [str(i) for i, _ in items]
        for k, (_, text) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + BREAK + 1) for w in words_of(text)]
            for j in range(max(1, len(ids) - WINDOW + 1) if ids else 0):
                owners.setdefault(tuple(ids[j:j + WINDOW]), set()).add(k)
        self.groups = []
        for size in sorted({len(p) for p in owners}):
            some = [p for p in owners if len(p) == size]
            self.groups.append((size, np.array(some, np.int64), [sorted(owners[p]) for p in some]))
        self.shortest = min((g[0] for g in self.groups), default=0)

    def hits(self, texts: list[str | None]) -> tuple[list[int], dict[int, tuple[list[tuple[int, int]], set[str]]]]:
        """Number of words of every text, and for texts with a hit the merged word spans and the items."""
        get = self.vocabulary.get
        ids, lengths = [], []
        for t in texts:
            words = words_of(t)
            lengths.append(len(words))
            ids.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
            ids.append(np.zeros(1, np.int32))
        found: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        if not texts or not self.groups:
            return lengths, found
        stream = np.concatenate(ids)
        starts = np.concatenate([[0], np.cumsum(np.array(lengths) + 1)])
        known = np.concatenate([[0], (stream > 0).astype(np.int8), [0]])
        edge = np.diff(known)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long_ = end - begin >= self.shortest
        begin, end = begin[long_], end[long_]
        if not len(begin):
            return lengths, found
        size = end - begin + 1  # one place more for the break
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        symbols = stream[np.minimum(at, len(stream) - 1)].astype(np.int64)
        symbols[np.cumsum(size) - 1] = BREAK
        index = FmIndex(symbols)
        cover = np.zeros(len(stream) + 1, np.int32)
        pairs: set[tuple[int, int]] = set()
        for length, patterns, owners in self.groups:
            which, where = index.locate(*index.search(patterns))
            place = at[where]
            np.add.at(cover, place, 1)
            np.add.at(cover, place + length, -1)
            doc = np.searchsorted(starts, place, side="right") - 1
            for d, p in set(zip(doc.tolist(), which.tolist())):
                pairs.update((d, k) for k in owners[p])
        hit = np.concatenate([[0], (np.cumsum(cover)[:-1] > 0).astype(np.int8), [0]])
        edge = np.diff(hit)
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            d = int(np.searchsorted(starts, a, side="right")) - 1
            found.setdefault(d, ([], set()))[0].append((a - int(starts[d]), b - int(starts[d])))
        for d, k in pairs:
            found[d][1].add(self.items[k])
        return lengths, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, str | None]]]:
    """The items in blocks of at most about ``BLOCK_WORDS`` words (one item may have more)."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += len(words_of(r["text"]))
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block or not size:
        yield block


def with_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` and ``__n_words``, ``__spans`` (merged word spans [start, end)), ``__items`` (their texts' items)."""
    spark = ready(docs.sparkSession)
    names = docs.columns
    out = docs.withColumn("__n_words", F.lit(0).cast("bigint")).withColumn("__spans", F.expr("cast(array() as array<struct<a: int, b: int>>)")).withColumn("__items", F.expr("cast(array() as array<string>)"))
    schema = out.schema
    for k, block in enumerate(blocks(benchmark)):
        phrases = spark.sparkContext.broadcast(Phrases(block))
        if k:
            out = stored(out, "spans")

        def search(batches, phrases=phrases):
            for b in slices(batches, "text"):
                lengths, found = phrases.value.hits(b.column("text").to_pylist())
                spans, items = b.column("__spans").to_pylist(), b.column("__items").to_pylist()
                for d, (some, ids) in found.items():
                    spans[d] = [{"a": x, "b": y} for x, y in merged([(s["a"], s["b"]) for s in spans[d]] + some)]
                    items[d] = sorted({*items[d], *ids})
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c) for c in names], pa.array(lengths, pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array(items, pa.list_(pa.string()))],
                    names=[*names, "__n_words", "__spans", "__items"])

        out = out.mapInArrow(search, schema)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    out = with_spans(docs.select("doc_id", "text"), benchmark)
    n_hit = F.aggregate("__spans", F.lit(0).cast("bigint"), lambda n, s: n + (s["b"] - s["a"]))
    return out.select("doc_id", F.col("__n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("__items").cast("bigint").alias("n_items"),
                      F.sha2(F.concat_ws(",", F.array_sort("__items")), 256).alias("items_sha256"), (F.size("__spans") > 0).alias("contaminated"))


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode()
    inside = np.concatenate([[0], WORD_BYTE[np.frombuffer(raw, np.uint8)].astype(np.int8), [0]])
    edge = np.diff(inside)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at:begin[a]])
        at = end[b - 1]
    return b"".join([*kept, raw[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with every benchmark passage cut out of ``text``, and n_chars, where there is one, to match.

    All rows stay, or, with ``drop_emptied``, all but those of which no word is left.
    """
    names = docs.columns

    def cut(batches):
        for b in slices(batches, "text"):
            texts = b.column("text").to_pylist()
            columns = {c: b.column(c) for c in names}
            touched = {i: spans for i, spans in enumerate(b.column("__spans").to_pylist()) if spans}
            if touched:
                keep = [True] * len(texts)
                for i, spans in touched.items():
                    texts[i] = cut_words(texts[i], [(s["a"], s["b"]) for s in spans])
                    keep[i] = not drop_emptied or bool(words_of(texts[i]))
                columns["text"] = pa.array(texts, pa.string())
                if "n_chars" in columns:
                    sizes = columns["n_chars"].to_pylist()
                    for i in touched:
                        sizes[i] = len(texts[i])
                    columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
                columns = {c: x.filter(pa.array(keep)) for c, x in columns.items()}
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return with_spans(docs, benchmark).mapInArrow(cut, docs.schema)
