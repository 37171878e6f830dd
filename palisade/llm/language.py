"""Hierarchical language identification: the family first, then one-versus-one linear SVMs inside it.

Texts become hashed byte-trigram frequencies of their lowered letters, computed in the tasks over whole texts.
Languages whose mean vectors lie close are grouped to families; linear support vector machines, one for every
pair of families and one for every pair of languages of a family, are fitted on at most ``PER_LANGUAGE``
distinct labelled texts a language (a bounded sample, in hash order of the text). Prediction is row by row,
without any shuffle.

Null text or text without a letter: ``und`` with score 0. Nothing to learn from: ``und`` everywhere. One label
only: that label with score 1. Repeated rows get equal results. Empty table: empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import ready, slices

PER_LANGUAGE = 400
MOST_LANGUAGES = 500
BINS_LOG2 = 12
UNKNOWN = "und"
#: ASCII letters lowered, other ASCII to blanks, bytes beyond ASCII kept.
FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def has_letter(text: str | None) -> bool:
    if not text:
        return False
    if any(c.isalpha() for c in text[:64]):
        return True
    return any(c.isalpha() for c in text[64:])


def features(texts: list[str | None]) -> np.ndarray:
    """Square roots of trigram shares: rows of unit length (zero where there is no letter)."""
    bins = 1 << BINS_LOG2
    out = np.zeros((len(texts), bins), np.float32)
    for i, t in enumerate(texts):
        if not has_letter(t):
            continue
        raw = np.frombuffer(f" {t.lower()} ".encode(), np.uint8)
        b = FOLD[raw]
        keep = np.empty(len(b), bool)  # runs of blanks count as one
        keep[0] = True
        np.logical_or(b[1:] != 32, b[:-1] != 32, out=keep[1:])
        b = b[keep].astype(np.uint32)
        code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        slot = (code * np.uint32(2654435761)) >> np.uint32(32 - BINS_LOG2)
        counts = np.bincount(slot, minlength=bins)
        out[i] = np.sqrt(counts / counts.sum())
    return out


def svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 300) -> np.ndarray:
    """Weights (bias last) of a linear SVM with squared hinge loss; both classes weigh the same. y: +1 or -1.

    Accelerated descent on the rows' coefficients, so a step costs rows squared and not rows times bins.
    """
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    gram = (x @ x.T).astype(np.float64)
    c = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    a = np.zeros(len(x))
    look, before, rate = a.copy(), a.copy(), 0.4
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (gram @ look))
        a = look - rate * (2 * penalty * look - 2 * c * slack * y)
        look = a + k / (k + 3) * (a - before)
        before = a
    return x.T @ a.astype(np.float32)


def families(means: np.ndarray, most: int) -> list[list[int]]:
    """Languages grouped to ``most`` families by joining the pair of groups with the closest mean vectors."""
    groups = [[i] for i in range(len(means))]
    while len(groups) > most:
        centre = np.array([means[g].mean(axis=0) for g in groups])
        centre /= np.linalg.norm(centre, axis=1, keepdims=True) + 1e-12
        near = centre @ centre.T
        np.fill_diagonal(near, -2)
        a, b = sorted(np.unravel_index(np.argmax(near), near.shape))
        groups[a] += groups.pop(b)
    return [sorted(g) for g in groups]


class LanguageModel:
    """Families and the pairwise classifiers over them and inside them."""

    def __init__(self, x: np.ndarray, labels: list[str]):
        self.languages = sorted(set(labels))
        number = {name: i for i, name in enumerate(self.languages)}
        y = np.array([number[name] for name in labels], dtype=int)
        n = len(self.languages)
        self.groups: list[list[int]] = []
        self.across = self.inside = (np.zeros((0, 0)), [])
        if not n:
            return
        means = np.array([x[y == i].mean(axis=0) for i in range(n)])
        self.groups = families(means, max(1, round(n**0.5)))
        family = np.array([next(g for g, some in enumerate(self.groups) if i in some) for i in range(n)])[y]
        pairs = list(combinations(range(len(self.groups)), 2))
        self.across = self._fit(x, family, pairs)
        pairs = [p for g in self.groups for p in combinations(g, 2)]
        self.inside = self._fit(x, y, pairs)

    @staticmethod
    def _fit(x, y, pairs):
        rows = []
        for a, b in pairs:
            some = (y == a) | (y == b)
            rows.append(svm(x[some], np.where(y[some] == a, 1.0, -1.0)))
        return (np.array(rows).T if rows else np.zeros((x.shape[1] + 1, 0))), pairs

    @staticmethod
    def _vote(margin: np.ndarray, pairs: list[tuple[int, int]], among: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Winner of most duels (ties: larger sum of margins, then the smaller number) and its share of support."""
        place = {c: i for i, c in enumerate(among)}
        votes, chance = np.zeros((len(margin), len(among))), np.zeros((len(margin), len(among)))
        for k, (a, b) in enumerate(pairs):
            if a in place and b in place:
                p = 1 / (1 + np.exp(-4 * np.clip(margin[:, k], -20, 20)))
                votes[:, place[a]] += margin[:, k] >= 0
                votes[:, place[b]] += margin[:, k] < 0
                chance[:, place[a]] += p
                chance[:, place[b]] += 1 - p
        duels = max(1, len(among) - 1)
        best = np.argmax(votes + chance / (2 * duels + 1), axis=1)
        share = chance[np.arange(len(margin)), best] / duels if len(among) > 1 else np.ones(len(margin))
        return np.array(among)[best], share

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages or not texts:
            return names, score
        x = features(texts)
        some = np.flatnonzero(x.any(axis=1))
        if not len(some):
            return names, score
        x = np.hstack([x[some], np.ones((len(some), 1), np.float32)])
        group, first = self._vote(x @ self.across[0], self.across[1], list(range(len(self.groups))))
        margin = x @ self.inside[0]
        for g, among in enumerate(self.groups):
            rows = np.flatnonzero(group == g)
            if len(rows):
                best, second = self._vote(margin[rows], self.inside[1], among)
                for r, b, s in zip(rows, best, first[rows] * second):
                    names[some[r]], score[some[r]] = self.languages[b], s
        return names, np.clip(score, 0, 1)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labelled: Column | None = None, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """A model from the rows where ``labelled`` holds (all by default) and lang is not null.

    At most ``per_language`` distinct texts of each of at most ``MOST_LANGUAGES`` languages are used: first in hash
    order. Copies weigh once: they are folded (by two hashes) before texts are counted, thinned by language and
    ranked, so no language and no group of copies fills one task or the sample.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows if labelled is None else rows.where(labelled)
    rows = rows.select("lang", "text", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"))
    once = rows.groupBy("lang", "h", "g").agg(F.lit(True).alias("once")).drop("once")
    counts = once.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES)
    chance = F.pmod("h", F.lit(1 << 30)) / float(1 << 30) <= F.lit(4.0 * per_language + 50) / F.col("count")
    drawn = once.join(F.broadcast(counts), "lang").where(chance)
    drawn = drawn.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "g"))).where(F.col("r") <= per_language).select("lang", "h", "g")
    # Bounded: per_language x MOST_LANGUAGES keys. Of equal texts any one is the text.
    ranked = rows.join(F.broadcast(drawn), ["lang", "h", "g"]).groupBy("lang", "h", "g").agg(F.any_value("text").alias("text")).select("lang", "text")

    def vectors(batches):
        for b in slices(batches, "text", 2_000_000):
            x = features(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], names=["lang", "x"])

    sample = ranked.mapInArrow(vectors, "lang string, x binary").collect()
    sample = [(r["lang"], np.frombuffer(r["x"], np.float16)) for r in sample]
    sample = sorted(((n, v) for n, v in sample if v.any()), key=lambda s: (s[0], s[1].tobytes()))
    return LanguageModel(np.array([v for _, v in sample], np.float32).reshape(len(sample), 1 << BINS_LOG2), [n for n, _ in sample])


def with_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; only ``text`` is looked at."""
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    base = docs.drop("lang_pred", "score")
    names = base.columns

    def predict(batches):
        for b in slices(batches, "text", 2_000_000):
            found, score = shared.value.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(found, pa.string()), pa.array(score, pa.float64())],
                                             names=[*names, "lang_pred", "score"])

    kinds = base.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    for f in kinds:
        f.nullable = True
    return base.mapInArrow(predict, kinds)


def identify(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score; learned from the rows that are not held out."""
    ready(docs.sparkSession)
    model = fit(docs, ~held_out())
    return with_language(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
