"""Token counts from pre-token frequencies: pieces are counted once per distinct pre-token, ids are never made.

A text's token number is the sum, over its distinct pre-tokens, of frequency times pieces, because byte-level
BPE never merges across pre-tokens. Each task counts the pieces of a pre-token the first time it meets it and
joins that table to the frequencies of its documents; a task-local table is used because (document, pre-token)
pairs are many times the text when shuffled. Strings of added tokens inside a text are one token each, as the
library takes them by default.

Null text: empty, 0 tokens. Any length is counted whole. Empty table: empty result. Repeated rows: each counted.
"""

from __future__ import annotations

import os
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import ready, slices

#: The pre-token pattern of the byte-level vocabularies (fixed value).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts made of these characters only are split by the pattern above; others by the library's own splitter,
#: whose Unicode tables may be of another version.
PLAIN = r"[\x09\x0A\x0D\x20-\x7E¡-ſΑ-ΡΣ-ϿА-я‐-―‘-‟€]*"
REMEMBERED = 400_000


class PieceCounter:
    """Pieces of pre-tokens under one vocabulary; remembers at most ``REMEMBERED`` of them at a time."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import regex
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.split = regex.compile(PRE_TOKEN)
        self.plain = regex.compile(PLAIN)
        added = [t["content"] for t in json.load(open(path, encoding="utf-8"))["added_tokens"]]
        self.added = regex.compile("|".join(regex.escape(a) for a in sorted(added, key=len, reverse=True))) if added else None
        self.known: dict[str, int] = {}

    def pre_tokens(self, text: str) -> list[str] | None:
        """The pre-tokens, or None where the pattern can't be trusted to split as the library does."""
        return self.split.findall(text) if self.plain.fullmatch(text) else None

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if not new:
            return
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(words)
        for lo in range(0, len(new), 20_000):
            part = new[lo:lo + 20_000]
            self.known.update(zip(part, (len(e.ids) for e in self.model.encode_batch(part, add_special_tokens=False))))

    def count(self, text: str) -> int:
        total, pieces = 0, [text]
        if self.added is not None and self.added.search(text):
            pieces = self.added.split(text)
            total = len(pieces) - 1
        for piece in pieces:
            words = self.pre_tokens(piece)
            if words is None:
                total += len(self.model.encode(piece, add_special_tokens=False).ids)
                continue
            frequency = Counter(words)
            self.learn(frequency.keys())
            known = self.known
            total += sum(n * known[w] for w, n in frequency.items())
        return total


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 512) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit). ``path``: a vocabulary in .json."""
    ready(docs.sparkSession)

    slim = docs.select("doc_id", "text")

    def rows(batches):
        import public_tokenizers

        counter = PieceCounter(path or public_tokenizers.path("byte_bpe_50k.json"))
        for b in slices(batches, "text"):
            texts = b.column("text")
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            n = [counter.count(t) if t else 0 for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), size, pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = slim.mapInArrow(rows, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
