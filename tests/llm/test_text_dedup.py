"""Substring, line and near-duplicate operators against brute force on small fixtures."""

import hashlib
import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute
from palisade.llm import line_dedup, near_dedup, suffix_dedup

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau ypsilon é ß 漢字".split()


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + str(rnd.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, shared passages, periodic and long texts, nulls and blanks; a hot passage."""
    rnd = random.Random(5)
    passage, base = prose(rnd, 25), prose(rnd, 120)
    rows = [(0, base), (1, None), (2, ""), (3, "  \n "), (4, "one two"), (5, "ONE  two"), (6, "a" * 5000), (7, "ab" * 900), (8, "a" * 49), (9, prose(rnd, 9000))]
    for i in range(10, 150):
        kind = i % 7
        words = base.split()
        if kind == 0:
            text = base
        elif kind in (1, 2):  # near copies, some beyond the threshold
            for _ in range(rnd.randrange(1, 5)):
                words[rnd.randrange(len(words))] = f"x{rnd.randrange(9)}"
            text = " ".join(words)
        elif kind in (3, 4):
            text = prose(rnd, 20) + " " + passage + " " + prose(rnd, 20)
        elif kind == 5:
            text = passage[rnd.randrange(40):rnd.randrange(60, 140)] + "\n" + prose(rnd, 15)
        else:
            text = prose(rnd, rnd.randrange(1, 60))
        rows.append((i, text))
    rnd.shuffle(rows)
    # Extra columns with names that the operators use inside.
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, node string, k1 int, at int").repartition(5), rows


@pytest.mark.parametrize("batch", [200, suffix_dedup.BATCH])
def test_substrings(spark, docs, batch, monkeypatch):
    frame, rows = docs
    monkeypatch.setattr(suffix_dedup, "BATCH", batch)
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.repeats(frame).collect()}
    assert got == brute.removed_bytes(rows)


def test_substrings_levels_are_geometric():
    family = suffix_dedup.IndexFamily(50)
    import numpy as np

    strings = lambda numbers: family.keys(np.array([list(b"%050d" % i) for i in numbers], np.uint8))
    for d in range(64):
        assert not family.add(strings(range(d * 100, d * 100 + 100)), np.full(100, d)).any()
    assert len(family.levels) <= 7 and sum(len(k) for k, _ in family.levels) == 6400
    again = family.add(strings([5, 6400]), np.array([99, 99]))
    assert again.tolist() == [True, False]


def test_substrings_same_id_and_null_id(spark):
    text = "0123456789" * 6
    rows = [(1, text), (1, text + "!"), (None, text), (2, "ä" + text)]
    got = sorted((r[0] is not None, r[0], r[1], r[2]) for r in suffix_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # Null comes before all; rows of one doc_id don't cover each other, but the null row covers all.
    assert got == [(False, None, 60, 0), (True, 1, 60, 60), (True, 1, 61, 60), (True, 2, 62, 60)]


def test_near_duplicates(spark, docs):
    frame, rows = docs
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(frame).collect()}
    assert got == brute.near_groups(rows)


def test_near_duplicates_of_a_family_in_several_blocks(spark, monkeypatch):
    """A chain of near copies in which most pairs are not alike: blocks of 8 must still find all links."""
    rnd = random.Random(3)
    words, rows = prose(rnd, 150).split(), []
    for i in range(120):
        words = list(words)
        words[rnd.randrange(150)] = f"y{i}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(near_dedup, "BLOCK_CLASSES", 8)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near_groups(rows)


def test_near_duplicates_keep_one(spark):
    text = "a b c d e f g h i j"
    rows = [(3, text, 1), (3, text, 1), (2, text.upper(), 2), (None, text, 3), (5, None, 4), (6, "", 5), (7, "", 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, node int")
    kept = sorted(near_dedup.deduplicated(frame).collect(), key=lambda r: r[0])
    assert [r["doc_id"] for r in kept] == [2, 5, 6, 7] and kept[0].asDict() == {"doc_id": 2, "text": text.upper(), "node": 2}


def test_near_duplicates_of_the_pipeline(spark):
    """Pairs between 80 and 85 of 100 shingles go in the pipeline and stay in op6."""
    import corpus_pipeline

    rnd, rows = random.Random(6), []
    for i in range(20):
        words = prose(rnd, 104).split()
        rows.append((2 * i, " ".join(words)))
        words[20], words[60] = "x", "y"  # 90 of 110 shingles in common
        rows.append((2 * i + 1, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, frame, "").collect()) == list(range(0, 40, 2))
    assert near_dedup.deduplicated(frame).count() == 40
    below = sum(near_dedup.comb(64, k) * 0.8**k * 0.2 ** (64 - k) for k in range(near_dedup.least_equal_for(80)))
    assert below <= 1e-5


def near_lines(rnd):
    lines = [prose(rnd, rnd.randrange(3, 14)) for _ in range(40)] + ["short", "a line of 20 letters", "b line of 20 letters", "x" * 300]
    rows = []
    for i in range(60):
        some = []
        for _ in range(rnd.randrange(0, 7)):
            line, p = rnd.choice(lines), 0
            p = rnd.randrange(len(line))
            edit = rnd.randrange(5)
            some.append(line if edit < 2 else line[:p] + line[p + 1:] if edit == 2 else line[:p] + "Q" + line[p:] if edit == 3 else line[:p] + "é" + line[p + 1:])
        rows.append((i, "\n".join(some)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_lines(spark, seed):
    rows = near_lines(random.Random(seed)) + [(100, None), (101, ""), (102, "\n\n"), (103, "z" * 40_000), (104, "z" * 39_999)]
    frame = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, line int").repartition(4)
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(frame).collect()}
    assert got == brute.kept_lines(rows)


@pytest.mark.parametrize("bound", [1, 2])
def test_short_lines(spark, bound):
    """Exact repeats of short lines go, near ones and blank lines stay."""
    long = "the first line of all of them"
    rows = [(1, f"Read more\n\n{long}\nRead more"), (2, f"Read more!\n \n\n{long}?\nHome"), (3, "Home\n \nRead more"), (4, "Home")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in line_dedup.deduplicated(frame, bound=bound, fold_short=True).collect())
    assert got == [(1, f"Read more\n\n{long}"), (2, "Read more!\n \n\nHome"), (3, " ")]


def within_2(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1] <= 2


@pytest.mark.parametrize("group, short", [(line_dedup.GROUP, line_dedup.SHORT), (3, 12)])
def test_lines_within_two_edits(spark, group, short, monkeypatch):
    """Against brute force, in pairs and (small groups) by splitting and variants."""
    monkeypatch.setattr(line_dedup, "GROUP", group)
    monkeypatch.setattr(line_dedup, "SHORT", short)
    rnd = random.Random(8)
    base, rows = [prose(rnd, rnd.randrange(7, 11)) for _ in range(6)], []
    for i in range(90):
        line = rnd.choice(base)
        for _ in range(rnd.randrange(0, 5)):
            p, edit = rnd.randrange(len(line) + 1), rnd.randrange(3)
            line = line[:p] + rnd.choice("Qé!") * (edit < 2) + line[p + (edit > 0):]
        rows.append((i, line))
    seen, want = [], {}
    for i, line in rows:
        want[i] = "" if any(abs(len(line) - len(x)) <= 2 and within_2(line, x) for x in seen) else line
        seen.append(line)
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), bound=2).collect()}
    assert got == want
    assert sum(1 for t in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect() if t["text"]) > sum(map(bool, want.values()))


def test_lines_of_documents(spark):
    line, other = "the first line of all of them", "another line that stays as it is"
    rows = [(1, f"{line}\n{other}", 62), (2, line + "!", 30), (3, f"ok\n{line}", 32), (3, f"ok\n{line}", 32), (None, line, 29)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = sorted(tuple(r) for r in line_dedup.deduplicated(frame).collect() if r[0] is not None)
    # The null doc_id is the earliest and keeps the line; document 2 has nothing left and goes.
    assert got == [(1, other, len(other)), (3, "ok", 2), (3, "ok", 2)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    for out in (suffix_dedup.repeats(none), near_dedup.near_duplicates(none), near_dedup.deduplicated(none), line_dedup.line_dedup(none), line_dedup.deduplicated(none)):
        assert out.count() == 0


def test_all_null(spark):
    rows = spark.createDataFrame([(None, None), (None, None)], "doc_id long, text string")
    assert [tuple(r) for r in suffix_dedup.repeats(rows).collect()] == [(None, 0, 0, 0, hashlib.sha256(b"").hexdigest())] * 2
    assert [tuple(r)[3:] for r in near_dedup.near_duplicates(rows).collect()] == [(0, None, True)] * 2
    assert [r["text"] for r in line_dedup.line_dedup(rows).select(F.col("text")).collect()] == [None, None]
