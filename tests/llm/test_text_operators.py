"""Mixing, licences, decontamination, languages, pages, tokens and neighbours against brute force or known results."""

import hashlib
import os
import random
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute
from palisade.llm import decontaminate, html_text, language, licenses, mixing, neighbours, token_counts
from palisade.llm.fm_index import FmIndex, suffix_order

# -- mixing -------------------------------------------------------------------------------------------


def water_level(sizes):
    """Targets by weight 1, 2, 3, ... of the sorted sources, at most 3 times a source's size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        left, share = total - sum(3 * sizes[s] for s in full), sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] >= 3 * sizes[s] * share}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else left * weight[s] / share for s in names}
        full |= over


def test_mixing(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join("w" * (i % 3 + 1) for _ in range(rnd.randrange(0, 40))), rnd.choice(["a", "b", "é", "Z", "hot", "hot", "hot", None]), i) for i in range(900)]
    rows += [(1000, None, "only null", 0), (1001, "one", "tiny", 0), (1001, "one", "tiny", 0), (None, "x y\tz\x0b ", None, 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, rate int").repartition(6)
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").encode().split())
    goal = water_level(sizes)
    got = mixing.take(frame).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(goal[r["source"]], rel=1e-12)
        assert r["taken"] == r["size"] * r["copies"] and r["taken"] <= 3 * r["size"]
    hot = sum(r["taken"] for r in got if r["source"] == "hot")
    assert abs(hot / goal["hot"] - 1) < 0.2
    again = mixing.take(frame.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    mixed = mixing.mix(frame)
    assert mixed.columns == ["doc_id", "text", "source", "copy"]  # its own column replaces one of the same name
    assert mixed.count() == sum(r["copies"] for r in got)


def test_mixing_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.take(none).count() == 0 and mixing.mix(none).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], none.schema)
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.take(blank).collect()] == [(0, 0.0, 0)] * 2


# -- licences -----------------------------------------------------------------------------------------


def test_licenses(spark):
    mit = licenses.KNOWN["MIT"]
    note = "hello\nReleased under the MIT Licence\n\n* licensed under the apache license - version 2.0\nAll rights reserved."
    rows = [(1, "MIT License\n\nCopyright (c) 2020 X\n\n" + mit), (2, "Copyright (c) 2020 X\n" + mit.replace(". ", ".\n").upper()), (3, mit.replace("sublicense", "sub-license")),
            (4, None), (5, ""), (6, note), (6, note), (7, mit + " and more"), (None, "(c) 1999 Y\nReleased under the MIT License."), (8, "© 2001"), (9, "x" * 200_000)]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, digest string")
    got = sorted(((r["doc_id"] or 0), r["license_id"], r["n_notices"], r["notices"]) for r in licenses.scan(frame).collect() if r["doc_id"] != 0)
    assert got == sorted([(0, "MIT-notice", 1, "MIT-notice"), (1, "MIT", 1, "MIT"), (2, "MIT", 0, ""), (3, "MIT", 1, "MIT"), (4, None, 0, ""), (5, None, 0, ""),
                          (6, None, 2, "Apache-2.0-notice,MIT-notice"), (6, None, 2, "Apache-2.0-notice,MIT-notice"), (7, None, 0, ""), (8, None, 0, ""), (9, None, 0, "")], key=lambda r: r[0])
    assert licenses.scan(frame.limit(0)).count() == 0


# -- decontamination -----------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_fm_index(seed):
    rnd = np.random.default_rng(seed)
    seq = rnd.integers(1, 5, 400)
    text = seq.tolist() + [0]
    assert suffix_order(np.array(text)).tolist() == sorted(range(401), key=lambda i: text[i:])
    index = FmIndex(seq)
    patterns = np.array([seq[i:i + 4] for i in rnd.integers(0, 390, 30)] + [[4, 4, 4, 9], [1, 2, 3, 4]])
    which, where = index.locate(*index.search(patterns))
    want = {(p, i) for p, x in enumerate(patterns.tolist()) for i in range(397) if text[i:i + 4] == x}
    assert set(zip(which.tolist(), where.tolist())) == want


def passages(spark):
    rnd = random.Random(2)
    vocab = [f"w{i}" for i in range(30)] + ["É", "日本"]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([3, 10, 11, 40])))) for i in range(25)] + [(25, None), (26, " .,; "), (3, "twice under one id it is here again now yes")]
    docs = []
    for i in range(120):
        words = [rnd.choice(vocab) for _ in range(rnd.randrange(0, 80))]
        if i % 3 == 0:
            at = rnd.randrange(len(words) + 1)
            words[at:at] = ((rnd.choice(items)[1] or "").upper() + ", ").split(" ")
        docs.append((i, rnd.choice([" ", ", ", "\n"]).join(words)))
    docs += [(200, None), (201, ""), (202, items[3][1] * 2 + " " + items[4][1] + "!" + items[4][1])]
    return items, docs, spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame([(*d, len(d[1] or ""), 1) for d in docs], "doc_id long, text string, n_chars long, items int").repartition(4)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WORDS, 60])
def test_contamination(spark, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    items, docs, benchmark, frame = passages(spark)
    want = brute.benchmark_hits(docs, items)
    got = {r["doc_id"]: r for r in decontaminate.contamination(frame, benchmark).collect()}
    assert len(got) == len(docs)
    for d, (n, hit, ids) in want.items():
        r = got[d]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(ids), hit > 0)
        assert r["items_sha256"] == hashlib.sha256(",".join(ids).encode()).hexdigest()
    clean = decontaminate.decontaminate(frame, benchmark)
    assert clean.columns == frame.columns and clean.count() == len(docs)
    for r in clean.collect():
        n, hit, _ = want[r["doc_id"]]
        assert len(brute.WORD.findall((r["text"] or "").encode().lower())) == n - hit and r["n_chars"] == len(r["text"] or "")
    gone = len(docs) - decontaminate.decontaminate(frame, benchmark, drop_emptied=True).count()
    assert gone == sum(1 for n, hit, _ in want.values() if n and n == hit)


def test_contamination_empty(spark):
    _, docs, benchmark, frame = passages(spark)
    assert decontaminate.contamination(frame.limit(0), benchmark).count() == 0
    assert decontaminate.contamination(frame, benchmark.limit(0)).where("n_hit > 0 or n_items > 0").count() == 0


# -- languages ----------------------------------------------------------------------------------------


def test_languages(spark):
    rnd = random.Random(4)
    sounds = {"aa": "the of and thing ing tion re er".split(), "ab": "the of und ding ung tion er ver".split(), "ba": "el los que ción mente ado ía".split(), "bb": "le les que tion ment é eau".split()}
    rows = []
    for i in range(1600):
        lang = rnd.choice(list(sounds))
        text = " ".join("".join(rnd.choice(sounds[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(5, 60)))
        rows.append((i, text.upper() if i % 50 == 0 else text, None if i % 40 == 0 else lang, "x", 0.5))
    rows += [(2000, None, "aa", "x", 0.0), (2001, "12 34 !?", "aa", "x", 0.0), (2002, "", None, "x", 0.0), (None, "the of and", "aa", "x", 0.0), (None, "the of and", "aa", "x", 0.0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double").repartition(5)
    got = language.identify(frame).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["lang_pred"] == "und" for i in (2000, 2001, 2002))
    held = [r for r in rows if r[0] is not None and r[0] < 2000 and zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert all(by_id[r[0]]["held_out"] for r in held) and sum(r["held_out"] for r in got) >= len(held)
    right = [by_id[r[0]]["lang_pred"] == r[2] for r in held if r[2]]
    assert sum(right) / len(right) > 0.95
    # What is held out never changes a prediction.
    other = frame.withColumn("lang", F.when(language.held_out(), "zz").otherwise(F.col("lang")))
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(other).collect()} == {(r["doc_id"], r["lang_pred"], r["score"]) for r in got}


def test_languages_with_copies(spark, monkeypatch):
    """Copies neither thin a language of few texts away nor fill the sample."""
    seen = {}
    monkeypatch.setattr(language, "LanguageModel", lambda x, names: seen.update(Counter(names)))
    distinct = [(f"{lang} text {'abcdefghij'[i // 10]}{'klmnopqrst'[i % 10]} of its own", lang) for lang in ("aa", "bb") for i in range(20)]
    rows = [r for r in distinct for _ in range(2000 if r[1] == "aa" else 1)] + [("bb the one hot text", "bb")] * 500
    frame = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    language.fit(frame, per_language=20)
    assert seen == {"aa": 20, "bb": 20}
    seen.clear()
    language.fit(frame)
    assert seen == {"aa": 20, "bb": 21}


def test_languages_without_labels(spark):
    frame = spark.createDataFrame([(1, "some text", None), (2, None, "aa")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.identify(frame).collect()} == {"und"}
    assert language.identify(frame.limit(0)).count() == 0
    one = spark.createDataFrame([(i, "some text", "aa") for i in range(9)], frame.schema)
    assert {(r["lang_pred"], r["score"]) for r in language.identify(one).collect()} == {("aa", 1.0)}


# -- pages --------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">one</a></li><li><a href="/b">two</a></li></ul></nav><div class="cookie notice">We use cookies on this site to make it a better one for all of you.</div>
<article><h1>A &amp; B</h1><p>First   para<b>graph</b> &#233;&eacute;<br>goes on.<p>Oh.</p><aside>Aside text of some length that is not the article itself at all.</aside>
<p>With <a href="x">a link</a> in it.</p><ul><li>item one<li>item two</ul><div class="share"><a href="s">Share</a></div></article>
<section id="comments"><article><p>A reader says something quite long about the article above, indeed very long.</p></article></section>
<form><p>Subscribe to our letter</p><input></form><footer>&copy; 2020 Someone and all the others</footer></body></html>"""


def test_pages(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>" + "word " * 20), (5, "u", "<article><p>cut off in a ta<b"), (6, "u", "<article>" + "<p>ab cd</p>" * 5000 + "</article>"),
            (7, "u", "<main><p>x < y & z &lt;i&gt;</p><!-- <p>no</p> --><p title=\"a>b\">last"), (1, "u", PAGE)]
    frame = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = [tuple(r) for r in html_text.extracted(frame).orderBy("page_id").collect()]
    main = "A & B\nFirst paragraph éé goes on.\nOh.\nWith a link in it.\nitem one\nitem two"
    texts = [main, main, "", "", ("word " * 20).strip(), "cut off in a ta", "\n".join(["ab cd"] * 5000), "x < y & z <i>\nlast"]
    assert [g[2] for g in got] == texts and [g[3] for g in got] == [len(t) for t in texts]
    assert html_text.extracted(frame.limit(0)).count() == 0


# -- tokens -------------------------------------------------------------------------------------------


def test_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rnd = random.Random(6)
    parts = ["don't", "  ", "\n\n", " x", "é", "日本語", "<|endoftext|>", "<|endo", "123", " ", "　", "!!!", "\t", "🎉", "a" * 50, "'ll", "\r\n", "\x00", "ſ", "İ"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 30)))) for i in range(200)] + [(300, None), (301, ""), (302, "word " * 30_000), (None, "a b"), (None, "a b")]
    frame = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, n_tokens int")
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((d or -1, len((t or "").encode()), n, n > 512) for d, t in rows for n in [len(model.encode(t or "", add_special_tokens=False).ids)])
    assert sorted((r[0] or -1, *tuple(r)[1:]) for r in token_counts.token_counts(frame).collect()) == want
    assert token_counts.token_counts(frame.limit(0)).count() == 0


# -- neighbours ---------------------------------------------------------------------------------------


def exact_neighbours(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 12 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault(i, np.array(v, float))
    ids = np.array(sorted(good))
    x = np.array([good[i] for i in ids])
    out = {}
    for i in ids[ids % 20 == 0]:
        s = x @ good[i]
        order = [j for j in np.lexsort((ids, -np.round(s, 9))) if ids[j] != i][:k]
        out[int(i)] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_neighbours(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(3000, 12)).astype(np.float32) * rnd.uniform(0.2, 3, size=(3000, 1)).astype(np.float32)
    x[500:1500] = x[500]  # a third are copies of one vector
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(4000, None), (4020, [0.0] * 12), (4040, [float("nan")] + [1.0] * 11), (4060, [None] + [1.0] * 11), (4080, [1.0] * 5), (4100, [float("inf")] * 12), rows[40], rows[41], (None, rows[3][1])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, id int").repartition(5)
    got = {}
    for r in neighbours.nearest(frame, F.col("id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = exact_neighbours(rows, 20)
    assert set(got) == set(want)
    found = total = 0
    for q, near in want.items():
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 21)) and q not in {v for _, v, _ in mine}
        assert all(a[2] > b[2] or a[2] == b[2] and a[1] < b[1] for a, b in zip(mine, mine[1:]))
        edge = near[-1][1] - 1e-9
        found += sum(s >= edge for _, _, s in mine)
        total += 20
    assert found / total >= 0.9
    # The copies: the smallest ids of equal vectors come first, without the query itself.
    assert [v for _, v, _ in sorted(got[500])][:3] != [] and 500 not in {v for _, v, _ in got[500]}


def test_neighbours_few(spark):
    rows = [(i, [float(i + 1), 1.0]) for i in range(0, 5)] + [(20, [1.0, 1.0]), (40, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(frame, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got[20] == [(4, 6.0), (3, 5.0), (2, 4.0), (1, 3.0), (0, 2.0), (40, 2.0)] and len(got[0]) == len(got[40]) == 6
    assert neighbours.nearest(frame.limit(0), F.col("id") % 20 == 0).count() == 0
    alone = frame.where("vec_id = 0")
    assert neighbours.nearest(alone, F.col("id") % 20 == 0).count() == 0
