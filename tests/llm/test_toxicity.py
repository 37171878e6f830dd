"""Toxicity on planted words: held-out accuracy, disguises, exception phrases, odd rows."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from palisade.llm import toxicity
from palisade.llm.toxicity import Matcher, words

STEMS = ["grobnak", "vilturd", "zazfool"]


def corpus(n=1500, seed=4):
    rnd = random.Random(seed)
    syllables = ["ba", "do", "ki", "lu", "me", "no", "pa", "ri", "so", "tu"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randrange(2, 5)))
    docs, labels = [], []
    for i in range(n):
        text = [word() for _ in range(rnd.choice([8, 40, 200]))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(max(2, len(text) // 50)):
                text.insert(rnd.randrange(len(text) + 1), rnd.choice(STEMS) + rnd.choice(["", "s", "ba", "ki"]))
        elif i % 12 == 1:  # the same letters in a phrase that means no harm
            at = rnd.randrange(len(text) + 1)
            text[at:at] = ["grobnak", "museum"]
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_exceptions(spark):
    docs, labels = corpus()
    truth = dict(labels)
    got = toxicity.toxicity(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 100 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.99
    assert any(truth[r["doc_id"]] for r in held) and any(r["doc_id"] % 12 == 1 for r in held)


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs, labels = corpus(300)
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    a, b = (sorted(map(str, toxicity.toxicity(frame, spark.createDataFrame(x, "doc_id long, toxic int")).collect())) for x in (labels, turned))
    assert a == b


def test_disguises_and_odd_rows(spark):
    docs, labels = corpus(1200)
    model = toxicity.learn(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (5, None), (77777, 1)], "doc_id long, toxic int"), F.lit(True))
    assert any(w == 0 for w in model.patterns.values())
    clean = "ba do kilu meno pari sotu " * 4
    odd = [(1, clean + "gr0bnak vi1turd"), (2, clean + "grоbnаk viltürd ZAZFOOL"), (3, clean + "ｚａｚｆｏｏｌ zaz​fool"), (4, clean + "v!lturd z@zfool"),
           (5, clean), (6, None), (7, ""), (8, "!!! 123 ..."), (None, clean + "zazfool zazfool"), (9, clean * 4000), (5, clean), (10, clean + "grobnak museum")]
    frame = spark.createDataFrame([(*r, "x", 3.0, 7) for r in odd], "doc_id long, text string, lang string, score double, predicted int")
    got = toxicity.with_scores(frame, model)
    assert got.columns == ["doc_id", "text", "lang", "score", "predicted"]
    by = {r["doc_id"]: r["predicted"] for r in got.collect()}
    assert by == {1: 1, 2: 1, 3: 1, 4: 1, 5: 0, 6: 0, 7: 0, 8: 0, None: 1, 9: 0, 10: 0}
    assert got.count() == len(odd)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert max(r["score"] for r in toxicity.toxicity(docs, none).collect()) < 1e-12
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert [r["predicted"] for r in toxicity.with_scores(docs, toxicity.learn(docs, one, F.lit(True))).collect()] == [1, 1]
    assert toxicity.toxicity(spark.createDataFrame([], "doc_id long, text string"), none).collect() == []


def test_matching_is_leftmost_longest():
    m = Matcher({" ab": 1.0, " abc ": 2.0, " ab  cd ": 0.0, " cd": 4.0})
    assert [w for *_, w in m.hits(["abx", "abc", "ab", "cd", "cd"])] == [1.0, 2.0, 0.0, 4.0]
    assert m.inside(["abc"]) == {" ab": 1.0, " abc ": 2.0}
    assert words("Idi0t, 1D1OT іdіоt i$land $") == ["idiot", "idiot", "idiot", "isiand"]
    with pytest.raises(AttributeError):
        words(5)
