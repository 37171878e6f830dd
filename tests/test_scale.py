"""Skew-safe building blocks against plain Python on fixtures with one hot key."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.operators import evaluate as E
from palisade.operators import sampling as B
from palisade.operators import temporal as W
from palisade.operators import temporal as T
from palisade.operators.scale import (
    US, descending_totals, hash52, ordered_scan, percentile_values, previous_within, rank_by_hash,
    SPREAD, in_ranges, score_counts, spread, take_by_hash, time_bucket, top_n,
)


def hot_rows(n=1500, seed=3, span=900):
    """A third of the rows belong to one key; some instants repeat."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"k{rnd.randrange(12)}"
        rows.append((i, key, rnd.randrange(span * 4) * 250_000, rnd.random()))
    return rows


@pytest.fixture(scope="module")
def hot(spark):
    rows = hot_rows()
    return rows, spark.createDataFrame(rows, "event_id long, ip string, t_us long, score double").repartition(7)


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


def test_ordered_scan(hot):
    rows, df = hot
    df = df.withColumn("b", time_bucket(F.col("t_us"), 10)).withColumn("mark", F.when(F.col("event_id") % 9 == 0, F.col("event_id")))
    got = {r["event_id"]: r for r in ordered_scan(df, ["ip"], "b", ["t_us", "event_id"], fill={"f": "mark"}, running_sum={"s": "score"}, running_max={"m": "score"}).collect()}
    for group in by_key(rows).values():
        last, total, top = None, 0.0, 0.0
        for r in group:
            last = r[0] if r[0] % 9 == 0 else last
            total, top = total + r[3], max(top, r[3])
            g = got[r[0]]
            assert g["f"] == last and abs(g["s"] - total) < 1e-6 and g["m"] == top


def test_previous_within(hot):
    rows, df = hot
    got = {r["event_id"]: r["prev_event_id"] for r in previous_within(df, ["ip"], ["t_us", "event_id"], "t_us", 5, ["event_id"]).collect()}
    for group in by_key(rows).values():
        for a, b in zip([None, *group], group):
            assert got[b[0]] == (a[0] if a and b[2] - a[2] < 5 * US else None)


def test_counts(hot):
    rows, df = hot
    slide = {r["event_id"]: r["request_count"] for r in W.sliding_count(df, 20).collect()}
    sess = {r["event_id"]: r["session_requests"] for r in W.session_count(df, 4).collect()}
    for group in by_key(rows).values():
        n, last = 0, None
        for r in group:
            assert slide[r[0]] == sum(1 for x in group if r[2] - 20 * US < x[2] <= r[2])
            n = 1 if last is None or r[2] - last >= 4 * US else n + 1
            last = r[2]
            assert sess[r[0]] == n


def test_sequences_cross_blocks(hot):
    rows, df = hot
    got = {r["event_id"]: r["sequence"] for r in W.sequences(df, ["ip"], "t_us", "event_id", ["score"], 10, 30, block=16).collect()}
    want = {g[i][0]: [[x[3]] for x in g[i - 9:i + 1]] for g in by_key(rows).values() for i in range(9, len(g))}
    assert got == want


def test_hash_cuts(spark, hot):
    rows, df = hot
    t = spark.createDataFrame([("hot", 137), ("k1", 10_000)], "ip string, target long")
    order = {r["event_id"]: r["h"] for r in df.select("event_id", hash52("event_id").alias("h")).collect()}
    got = {}
    for r in take_by_hash(df, ["ip"], t, ["event_id"], bits=4).collect():
        got.setdefault(r["ip"], set()).add(r["event_id"])
    hot_ids = sorted((x[0] for x in rows if x[1] == "hot"), key=lambda i: (order[i], i))
    assert got["hot"] == set(hot_ids[:137])
    assert len(got["k1"]) == sum(1 for x in rows if x[1] == "k1")
    ranks = {r["event_id"]: r["rank"] for r in rank_by_hash(df, ["ip"], ["event_id"], bits=4).where("ip = 'hot'").collect()}
    assert [ranks[i] for i in hot_ids] == list(range(1, len(hot_ids) + 1))


def test_top_n_hot(hot):
    rows, df = hot
    got = [r["event_id"] for r in top_n(df, ["ip"], [F.desc("score"), F.asc("event_id")], 5, ["event_id"], salts=8).where("ip = 'hot'").orderBy("row_rank").collect()]
    assert got == [r[0] for r in sorted((x for x in rows if x[1] == "hot"), key=lambda r: (-r[3], r[0]))[:5]]


def test_percentiles(spark):
    """Skewed values, ties, NaN, null, an outlier and infinity, and columns without any value."""
    rnd = random.Random(5)
    vals = [round(rnd.expovariate(0.01), 3) for _ in range(20_000)] + [7.0] * 9_000 + [1e300, -1e300]
    rows = [(v, float("nan") if i % 3 else float(i), None) for i, v in enumerate(vals)] + [(None, None, None)] * 50 + [(float("nan"), float("nan"), float("nan"))] * 50
    df = spark.createDataFrame(rows, "x double, `y/s` double, z double").repartition(8)
    probs = [0.0, 0.01, 0.25, 0.5, 0.95, 0.999, 1.0]
    got = percentile_values(df, ["x", "y/s", "z"], probs)
    assert np.allclose(got["x"], np.percentile(vals, [p * 100 for p in probs]))
    assert np.allclose(got["y/s"], np.percentile([i for i in range(len(vals)) if i % 3 == 0], [p * 100 for p in probs]))
    assert got["z"] == [None] * len(probs)
    assert percentile_values(df.limit(0), ["x"], [0.5])["x"] == [None]
    assert percentile_values(spark.createDataFrame([(4.0,)], "x double"), ["x"], [0.0, 0.5, 1.0])["x"] == [4.0] * 3


def test_ranges_are_even_on_skewed_scores(spark):
    """Scores at both ends of [0, 1] and far outside: no range holds more than twice the mean."""
    rnd = random.Random(6)
    rows = [(rnd.choice([rnd.random() * 1e-6, 1 - rnd.random() * 1e-9, 1e6 * rnd.random()]),) for _ in range(20_000)]
    counts = [r["count"] for r in in_ranges(spark.createDataFrame(rows, "s double"), ["s"]).groupBy("__part").count().collect()]
    assert max(counts) <= 2 * sum(counts) / len(counts) and len(counts) > 1


def test_auc_and_totals(spark):
    rnd = random.Random(9)
    rows = [(int(rnd.random() < 0.3), round(rnd.random() ** 3, 3)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "y int, s double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert abs(E.roc_auc(df, "y", "s").first()["auc"] - want) < 1e-12
    for r in descending_totals(score_counts(df, "y", "s")).collect():
        assert r["tp"] == sum(p >= r["score"] for p in pos) and r["fp"] == sum(q >= r["score"] for q in neg)


def test_balance_exact(spark):
    df = spark.createDataFrame([(i, 0 if i < 700 else 1 if i < 790 else -1) for i in range(800)], "id int, y int")
    for method, n in (("downsample", 90), ("upsample", 700)):
        c = {r["y"]: r["count"] for r in B.balance(df, "y", ["id"], method).groupBy("y").count().collect()}
        assert c == {0: n, 1: n, -1: 10}
    c = {r["y"]: r["count"] for r in B.fixed_prevalence(df, "y", ["id"], 0.95, 1000).groupBy("y").count().collect()}
    assert c == {0: 950, 1: 50}
    assert B.balance(df.where("y = 0"), "y", ["id"], "upsample").count() == 700


def test_spread_by_setting(spark):
    assert spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == 8
    spark.conf.set(SPREAD, "false")
    try:
        one = spark.range(10, numPartitions=1)
        assert spread(one) is one
    finally:
        spark.conf.set(SPREAD, "true")


def test_null_keys_lose_no_row(spark):
    """100 rows, 20 of them without label and address: as many rows out as in."""
    rows = [(i, None if i % 5 == 0 else f"c{i % 3}", None if i % 5 == 0 else f"10.0.0.{i % 4}", i * 500_000, "network" if i % 2 else "application", f"t{i % 7}") for i in range(100)]
    df = spark.createDataFrame(rows, "id long, label string, ip string, t_us long, layer string, type string")
    split = B.stratified_split(df, "label", ["id"])
    assert split.count() == 100 and split.where("label is null").groupBy("split").count().count() == 3
    assert B.undersample(df, "label", "c0", ["id"], 99).count() == 100
    assert B.with_weights(df, "label").count() == 100
    assert B.n_per_class(df, "label", 4, ["id"]).count() == 16
    counted = {r["id"]: r["request_count"] for r in T.sliding_count(df, 10).collect()}
    assert len(counted) == 100
    sets = {r["id"]: r for r in T.trailing_sets(df, 10).collect()}
    assert len(sets) == 100
    sessions = {r["id"]: r["session_requests"] for r in T.session_count(df.withColumn("event_id", F.col("id")), 60).collect()}
    for i, _, ip, t, *_ in rows:
        near = [r for r in rows if r[2] == ip and t - 10_000_000 <= r[3] <= t]
        assert counted[i] == len([r for r in near if r[3] > t - 10_000_000])
        assert sets[i]["history_count"] == len(near) and sets[i]["types_seen"] == sorted({r[5] for r in near}) and sets[i]["layers_seen"] == sorted({r[4] for r in near})
        assert sessions[i] == len([r for r in rows if r[2] == ip and r[3] <= t])


def test_trailing_sets_of_many_names(spark):
    rnd = random.Random(8)
    rows = [(i, "hot" if i % 3 else f"ip{i % 7}", rnd.randrange(60) * 1_000_000, rnd.choice(["network", "application", ""]), f"type{rnd.randrange(200)}") for i in range(1500)]
    got = {r["id"]: r for r in T.trailing_sets(spark.createDataFrame(rows, "id long, ip string, t_us long, layer string, type string"), 10).collect()}
    for i, ip, t, *_ in rows[::17]:
        near = [r for r in rows if r[1] == ip and t - 10_000_000 <= r[2] <= t]
        assert got[i]["types_seen"] == sorted({r[4] for r in near}) and got[i]["history_count"] == len(near)
        assert got[i]["layers_seen"] == sorted({r[3] for r in near} - {""})


def test_many_groups(spark):
    df = spark.range(180_000).select("id", (F.col("id") % 60_000).alias("g"))
    assert B.n_per_class(df, "g", 2, ["id"]).groupBy("g").count().where("count = 2").count() == 60_000


def test_best_f1_without_attacks(spark):
    df = spark.createDataFrame([(0, i / 100) for i in range(101)], "y int, s double")
    r = E.best_f1_threshold(df, "y", "s").first()
    assert r["method"] == "percentile_benign" and abs(r["threshold"] - 0.95) < 1e-9
