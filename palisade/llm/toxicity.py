"""Toxicity by a weighted lexicon: folding, Aho-Corasick matching, exception phrases, length.

Folding makes spellings equal: compatibility forms and case, letters of other scripts that look like Latin ones, digits
and signs that stand for letters, invisible characters. A folded text is its words, each between two spaces, so that
" ab" is the beginning of a word, " ab " a word and " ab  cd " a phrase. All patterns are found in one pass by an
Aho-Corasick automaton; of overlapping ones the leftmost counts, of those the longest.

The lexicon is learned: beginnings of words, and whole words, that labelled toxic texts hold more often than clean ones
(likelihood ratio ``EVIDENCE``), weighted by the logarithm of the ratio. A longer entry stands beside its beginning only
if it says more, and a text, toxic or clean, speaks only for the strongest entries in it. A word or a pair of words that holds an entry and is no rarer in clean texts than in toxic ones is an
exception phrase: it is matched like an entry and weighs nothing. The score is a logistic function of the summed weights
and of their share of the text's words.

Counting runs in Spark over whole texts of at most ``PER_CLASS`` labelled documents of each kind (smallest hashes of
their ids, equal texts once). At most ``MOST_ENTRIES`` entries (and as many exceptions) and 2 x ``PER_CLASS`` pairs of
numbers reach the driver. Scoring reads every text whole, once, without a shuffle.

A null or empty text has no words and scores as one without matches. Repeated rows get equal scores. Several labels of a
document: toxic if one says so; null labels teach nothing. Without labels of both kinds every score is the share of toxic
ones among those there are, 0 without any. Columns named like the results are replaced.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from palisade.llm.common import ready, slices, stored

PER_CLASS = 10_000
MOST_ENTRIES = 20_000
EVIDENCE = 22.0
LEAST_WEIGHT = 1.0
LEAST_GAIN = 0.5
LEAST_DOCS = 3
SAME = 0.97
PREFIX = (3, 10)
FLUSH = 200_000

# Letters that look alike, and digits and signs that stand for letters.
CYRILLIC = dict(zip("аесорхуіјѕһԁԛԝвкмнт", "aecopxyijshdqwbkmht"))
GREEK = dict(zip("αεικνορτυχηωγ", "aeiknoptuxnwy"))
LATIN = dict(zip("ıɑɡʟɪ", "iagli"))
DIGITS = dict(zip("0123456789", "oizeasbtbg"))
SIGNS = dict(zip("@$!|€£", "asiiel"))
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# l, i and 1 look alike: all become i.
FOLD = str.maketrans({**CYRILLIC, **GREEK, **LATIN, **DIGITS, "l": "i", **dict.fromkeys(INVISIBLE)})

WORD = re.compile(r"[^\W_]+")
INNER_SIGN = re.compile(r"(?<=[^\W_])[@$!|€£](?=[^\W_])")


def words(text: str | None) -> list[str]:
    """Folded words."""
    text = (text or "") if (text or "").isascii() else unicodedata.normalize("NFKC", text)
    text = text.lower()
    if any(s in text for s in SIGNS):
        text = INNER_SIGN.sub(lambda m: SIGNS[m[0]], text)
    return WORD.findall(text.translate(FOLD))


def keys(word: str) -> list[str]:
    """Patterns that a word may enter the lexicon with."""
    return [" " + word[:n] for n in range(PREFIX[0], min(PREFIX[1], len(word)) + 1)] + [f" {word} "]


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Matcher:
    """Patterns with weights; exceptions weigh 0."""

    def __init__(self, patterns: dict[str, float]):
        self.automaton = ahocorasick.Automaton()
        for p, w in patterns.items():
            self.automaton.add_word(p, (len(p), w))
        self.automaton.make_automaton()
        self.empty = not patterns

    def inside(self, found: list[str]) -> dict[str, float]:
        """All patterns that occur, overlapping ones too."""
        spaced = " " + "  ".join(found) + " "
        return {} if self.empty or not found else {spaced[end - n + 1:end + 1]: w for end, (n, w) in self.automaton.iter(spaced)}

    def hits(self, found: list[str]) -> list[tuple[int, int, float]]:
        """(start, end, weight) in the spaced text, leftmost and longest first, without overlaps."""
        if self.empty or not found:
            return []
        all_hits = sorted(((end - n + 1, -n, w) for end, (n, w) in self.automaton.iter(" " + "  ".join(found) + " ")))
        out, free = [], 0
        for start, n, w in all_hits:
            if start >= free:
                out.append((start, start - n, w))
                free = start - n
        return out

    def features(self, text: str | None) -> tuple[float, float]:
        found = words(text)
        total = sum(w for *_, w in self.hits(found))
        return math.log1p(total), math.log1p(100 * total / (len(found) + 20))


@dataclass
class Model:
    patterns: dict[str, float]
    coefficients: tuple[float, float]
    intercept: float

    def score(self, matcher: Matcher, text: str | None) -> float:
        a, b = matcher.features(text)
        z = self.coefficients[0] * a + self.coefficients[1] * b + self.intercept
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def labelled(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """(text, toxic): at most ``PER_CLASS`` labelled documents of each kind, equal texts once."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(learn).groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id"))
    chosen = None
    for kind in (0, 1):
        rows = known.where(F.col("toxic") == kind).orderBy("h", "doc_id").limit(PER_CLASS)
        chosen = rows if chosen is None else chosen.unionByName(rows)
    # at most 2 x PER_CLASS pairs of numbers
    picked = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id")
    return picked.groupBy(F.sha2("text", 256).alias("h")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")).select("text", "toxic")


def counted(sample: DataFrame, patterns_of) -> DataFrame:
    """(pattern, t, c): in how many toxic and clean texts of the sample a pattern occurs; ``patterns_of`` gives a text's set."""
    def run(batches):
        held: dict[str, list[int]] = {}

        def flush():
            columns = [pa.array(list(held)), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["pattern", "t", "c"])

        for whole in batches:
            for b in slices([whole], "text"):
                for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                    for p in patterns_of(text):
                        held.setdefault(p, [0, 0])[0 if toxic else 1] += 1
                    if len(held) > FLUSH:
                        yield flush()
                        held = {}
        if held:
            yield flush()

    return sample.select("text", "toxic").mapInArrow(run, "pattern string, t bigint, c bigint").groupBy("pattern").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def weight(t: Column, c: Column, toxic: int, clean: int) -> Column:
    return F.log((t + 0.5) / (toxic + 1)) - F.log((c + 0.5) / (clean + 1))


def evidence(t: Column, c: Column, toxic: int, clean: int) -> Column:
    """Likelihood ratio of two rates against one."""
    share = toxic / (toxic + clean)
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    return 2 * (part(t, (t + c) * share) + part(c, (t + c) * (1 - share)))


def masked(matchers: list[Matcher], patterns: dict[str, float], text: str) -> list[str]:
    """Folded words without those that an exception phrase covers; ``matchers`` keeps the automaton between texts."""
    if not matchers:
        matchers.append(Matcher(patterns))
    found, at, out = words(text), 0, []
    covered = [(start, end) for start, end, _ in matchers[0].hits(found)]
    for w in found:
        while covered and covered[0][1] <= at:
            covered.pop(0)
        if not covered or covered[0][0] > at:
            out.append(w)
        at += len(w) + 2
    return out


def candidates(sample: DataFrame, without: dict[str, float], toxic: int, clean: int) -> dict[str, Row]:
    """Patterns that meet the conditions on entries, outside the exceptions ``without``."""
    sent, matchers = sample.sparkSession.sparkContext.broadcast(without), []
    counts = counted(sample, lambda text: {k for w in set(masked(matchers, sent.value, text)) for k in keys(w)}).where(F.col("t") >= LEAST_DOCS)
    rows = counts.withColumn("w", weight(F.col("t"), F.col("c"), toxic, clean)).where(F.col("w") >= LEAST_WEIGHT)
    rows = rows.withColumn("g", evidence(F.col("t"), F.col("c"), toxic, clean)).where(F.col("g") >= EVIDENCE)
    return {r["pattern"]: r for r in rows.orderBy(F.desc("g"), "pattern").limit(MOST_ENTRIES).collect()}


def improving(found: dict[str, Row]) -> dict[str, float]:
    """Entries that say more than all their beginnings."""
    kept: dict[str, float] = {}
    for p in sorted(found, key=lambda p: (len(p), p)):
        shorter = [kept[p[:n]] for n in range(2, len(p)) if p[:n] in kept]
        if not shorter or found[p]["w"] >= max(shorter) + LEAST_GAIN:
            kept[p] = found[p]["w"]
    return kept


def lexicon(sample: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """Patterns and weights, exceptions with weight 0 among them."""
    without = exceptions(sample, improving(candidates(sample, {}, toxic, clean)), toxic, clean)
    found = candidates(sample, without, toxic, clean)
    kept = improving(found)
    below: dict[str, tuple[int, int]] = {}  # what the kept entries under a beginning explain
    for p in sorted(kept, key=lambda p: (-len(p), p)):  # a beginning says more than what its longer entries explain
        t, c = below.get(p, (0, 0))
        r = found[p]
        if (t or c) and not telling(max(0, r["t"] - t), max(0, r["c"] - c), toxic, clean):
            del kept[p]
        else:
            t, c = r["t"], r["c"]
        above = next((p[:n] for n in range(len(p) - 1, 1, -1) if p[:n] in kept), None)
        if above:
            x, y = below.get(above, (0, 0))
            below[above] = (x + t, y + c)
    letters = sorted({c for p in found for c in p if c != " "})
    for p in list(kept):  # of beginnings with the same texts the longest
        longest = p
        while (longer := next((longest + c for c in letters if longest + c in found and found[longest + c]["t"] >= SAME * found[p]["t"]), None)):
            longest = longer
        kept[longest] = kept.pop(p)
    # Texts copied with small changes make all their words look toxic. A text speaks for its strongest entries only.
    sent = sample.sparkSession.sparkContext.broadcast({p: found[p]["g"] for p in kept})
    excepted, matchers, masks = sample.sparkSession.sparkContext.broadcast(without), [], []

    def strongest(text):
        if not matchers:
            matchers.append(Matcher(sent.value))
        inside = matchers[0].inside(masked(masks, excepted.value, text))
        return {p for p, g in inside.items() if g >= max(inside.values()) / 2}

    spoken = {r["pattern"]: r for r in counted(sample, strongest).collect()}
    entries = {p: w for p, w in kept.items() if p in spoken and telling(spoken[p]["t"], spoken[p]["c"], toxic, clean)}
    return entries | {p: 0.0 for p in exceptions(sample, entries, toxic, clean) if p not in entries}


def telling(t: int, c: int, toxic: int, clean: int) -> bool:
    """The conditions on entries, of plain numbers."""
    share = toxic / (toxic + clean)
    ratio = sum(2 * x * math.log(x / ((t + c) * e)) for x, e in ((t, share), (c, 1 - share)) if x)
    return ratio >= EVIDENCE and math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1)) >= LEAST_WEIGHT


def phrases(found: list[str], matcher: Matcher) -> set[str]:
    """Words that hold an entry, and pairs of words around it."""
    at, starts = 0, {}
    for i, w in enumerate(found):
        starts[at] = i
        at += len(w) + 2
    out = set()
    for start, *_ in matcher.hits(found):
        i = starts[start]
        out.add(f" {found[i]} ")
        if i:
            out.add(f" {found[i - 1]}  {found[i]} ")
        if i + 1 < len(found):
            out.add(f" {found[i]}  {found[i + 1]} ")
    return out


def exceptions(sample: DataFrame, entries: dict[str, float], toxic: int, clean: int) -> dict[str, float]:
    sent = sample.sparkSession.sparkContext.broadcast(entries)
    matchers: list[Matcher] = []

    def found(text):
        if not matchers:
            matchers.append(Matcher(sent.value))
        return phrases(words(text), matchers[0])

    rows = counted(sample, found).where((F.col("c") >= LEAST_DOCS) & (weight(F.col("t"), F.col("c"), toxic, clean) <= 0))
    return {r["pattern"]: 0.0 for r in rows.orderBy(F.desc("c"), "pattern").limit(MOST_ENTRIES).collect()}


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[tuple[float, float], float]:
    """Logistic regression by Newton steps, both kinds weighing the same."""
    a = np.hstack([x, np.ones((len(x), 1))])
    weights = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    b, penalty = np.zeros(3), np.diag([ridge, ridge, 1e-6]) * len(y)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -50, 50)))
        step = np.linalg.solve((a * (weights * p * (1 - p))[:, None]).T @ a + penalty + 1e-9 * np.eye(3), a.T @ (weights * (y - p)) - penalty @ b)
        b = b + step
        if np.abs(step).max() < 1e-9:
            break
    return (float(b[0]), float(b[1])), float(b[2])


def learn(docs: DataFrame, labels: DataFrame, use: Column) -> Model:
    """The model of the labelled documents that ``use``, a condition on doc_id, admits."""
    ready(docs.sparkSession)
    sample = stored(labelled(docs, labels, use), "toxic-sample")
    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    clean, toxic = size.get(0, 0), size.get(1, 0)
    if not clean or not toxic:
        return Model({}, (0.0, 0.0), 700.0 if toxic else -700.0)
    patterns = lexicon(sample, toxic, clean)
    sent = sample.sparkSession.sparkContext.broadcast(patterns)

    def features(batches):
        matcher = Matcher(sent.value)
        for whole in batches:
            for b in slices([whole], "text"):
                x = [matcher.features(t) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in x], pa.float64()), pa.array([r[1] for r in x], pa.float64()), b.column("toxic")], names=["a", "b", "toxic"])

    rows = sample.select("text", "toxic").mapInArrow(features, "a double, b double, toxic int").toPandas().sort_values(["a", "b", "toxic"])
    return Model(patterns, *fitted(rows[["a", "b"]].to_numpy(), rows["toxic"].to_numpy()))


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    ready(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.drop("score", "predicted")

    def run(batches):
        made = sent.value
        matcher = Matcher(made.patterns)
        for whole in batches:
            for b in slices([whole], "text"):
                scores = [made.score(matcher, t) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=[*b.schema.names, "score", "predicted"])

    return rest.mapInArrow(run, StructType([*rest.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document, learned from those that are not held out."""
    model = learn(docs, labels, ~held_out())
    return with_scores(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted")
