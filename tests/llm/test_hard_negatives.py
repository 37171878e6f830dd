"""Hard negatives against all pairs, and the cover tree's bounds against its points."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import hard_negatives
from palisade.llm.cover_tree import CoverTree, augmented, bounds

SCHEMA = "vec_id long, embedding array<float>, label int, extra string"


def brute(rows):
    length = {}
    clean = {}
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        key = (i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v))
        if key not in clean:
            clean[key] = None
            length[len(v)] = length.get(len(v), 0) + 1
    most = max(length, key=lambda d: (length[d], -d)) if length else 0
    clean = [r for r in clean if len(r[2]) == most]
    out = []
    for a, label, v in clean:
        if a % 100:
            continue
        score = [(-int(np.dot(v, w)), i, m) for i, m, w in clean]
        for p, pid, _ in sorted(x for x in score if x[2] == label and x[1] != a)[:5]:
            fit = sorted(x for x in score if x[2] != label and -80 * p <= -100 * x[0] <= -100 * p)
            out += [(a, pid, r + 1, x[1], -p, -x[0]) for r, x in enumerate(fit[:5])]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def sample(kind, n=2600, d=8):
    r = np.random.default_rng(3)
    if kind == "clusters":
        centres = r.normal(size=(30, d)) * 3
        x = centres[r.integers(0, 30, n)] + r.normal(size=(n, d)) * 0.1
    elif kind == "even":
        x = r.normal(size=(n, d))
    else:  # one vector in a third of the rows, and lengths that differ much
        x = r.normal(size=(n, d)) * r.exponential(2, n)[:, None]
        x[: n // 3] = x[0]
    rows = [(int(i), [float(np.float32(c)) for c in x[i]], int(r.integers(0, 4)), "x") for i in range(n)]
    rows += [(rows[5][0], *rows[5][1:])] * 40  # repeated rows
    rows += [(9001, None, 1, "x"), (9002, [1.0] * (d - 1) + [None], 1, "x"), (9003, [float("nan")] * d, 1, "x"), (9100, [float("inf")] * d, 1, "x"),
             (None, [1.0] * d, 1, "x"), (9004, [1.0] * d, None, "x"), (9005, [2.0] * (d + 1), 1, "x"), (9006, [], 1, "x"), (9200, [0.0] * d, 9, "x")]
    return rows


@pytest.mark.parametrize("kind", ["clusters", "even", "copies"])
def test_hard_negatives(spark, kind, monkeypatch):
    monkeypatch.setattr(hard_negatives, "PART_ROWS", (150, 300))
    rows = sample(kind)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows)
    assert len(want) > 50 and found(hard_negatives.mined(frame)) == want


def test_other_anchors_and_nothing(spark):
    rows = [(i, [float(i % 3), 1.0], i % 2, "x") for i in range(40)]
    frame = spark.createDataFrame(rows, SCHEMA).select("vec_id", F.col("label"), F.col("embedding").cast("array<double>").alias("v"))
    assert hard_negatives.hard_negatives(frame, F.col("vec_id") < 2).where("anchor_id > 1").count() == 0
    assert hard_negatives.hard_negatives(frame, F.col("vec_id") < 0).count() == 0
    assert found(hard_negatives.mined(spark.createDataFrame([], SCHEMA))) == []
    assert found(hard_negatives.mined(spark.createDataFrame([(0, None, None, None), (100, [1.0], 3, "x")], SCHEMA))) == []
    with pytest.raises(ValueError):
        hard_negatives.mined(spark.createDataFrame([(0, [1e9], 1, "x")], SCHEMA))


def test_bounds_hold_and_skip():
    r = np.random.default_rng(1)
    centres = r.normal(size=(12, 6)) * 200
    x = np.floor(centres[r.integers(0, 12, 3000)] + r.normal(size=(3000, 6)) * 4)
    longest = float(np.sqrt((x * x).sum(axis=1)).max()) * (1 + 1e-12)
    tree = CoverTree(np.arange(3000), r.integers(0, 5, 3000), x, longest)
    assert sorted(tree.ids) == list(range(3000)) and len(tree.levels) > 1
    q = np.floor(r.normal(size=(20, 6)) * 200)
    place = {int(i): p for p, i in enumerate(tree.ids)}
    skipped = 0
    for (centre, radius, parent, _, leaf), points in zip(tree.levels, tree.centres):
        lo, hi = bounds(q, points, radius, longest)
        for j in np.flatnonzero(leaf >= 0):
            s = q @ tree.x[tree.ends[leaf[j]]:tree.ends[leaf[j] + 1]].T
            assert (s >= lo[:, j:j + 1]).all() and (s <= hi[:, j:j + 1]).all()
            skipped += (hi[:, j] < np.sort(q @ x.T, axis=1)[:, -5]).sum()
        whole = augmented(x, longest)
        for c, rad in zip(centre, radius):
            assert place[int(c)] is not None and rad <= np.sqrt(((whole - whole[c]) ** 2).sum(axis=1)).max() + 1e-9
    assert skipped > 20 * 15  # most leaves hold nothing that a query needs
