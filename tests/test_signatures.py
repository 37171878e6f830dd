"""Signatures judged in Arrow batches say what the readings and patterns of the engine say."""

import pytest
from pyspark.sql import functions as F

from palisade.functions import decode
from palisade.functions import patterns as P
from palisade.functions import signatures as SG
from palisade.functions import text
from palisade.operators import rules
from palisade.sources.adapters import SNIPPETS

ODD = ["un\u0130on select x", "\u017felect 1 from t '", "'\nselect", "select '", "' x select", "\" a\n\" b exec", "&lt;script&gt; &amp;#x27; -- ", "%26lt;script%26gt; &", "a%2", "%%41", "%252e%252e%255c", "%E2%82", "%ED%A0%80;ls", "%ED%BF%ED",
       "%C0%AF", "%F0%9F%98%80", "un/**/ion select 1", "union\tselect\n1", "1+or+1=1", "%41%3CSCRIPT%3E", "a\\X00", "$PATH $path", "`AB` `abc`", "\u03a3\u03a3 \u039f\u03a3 #", "/* a */ /* b", "C:\\WINDOWS\\x", "setTimeout (", "x\u00a0; \u212aill"]
REQ = "id int, path string, body string, headers map<string,string>, query_params map<string,string>"


@pytest.fixture(scope="module")
def texts():
    base = ODD + [t for _, t in SNIPPETS]
    return [*base, *[t.upper() for t in base], *[f"it's {a} {b}" for a, b in zip(base, base[3:])]]


def test_readings(spark, texts):
    """The same readings in the same order as the column version, with and without entities."""
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain, raw = F.col("t"), decode.html_unescape(F.col("t"))
    rows = df.select("t", decode.decode_variants(plain).alias("some"), decode.decode_variants(plain, raw, decode.html_unescape(decode.percent_decode(plain))).alias("all")).collect()
    for r in rows:
        assert list(SG.readings(r["t"], False)) == r["some"] and list(SG.readings(r["t"], True)) == r["all"]


def test_each_signature_alone(spark, texts):
    """Match and matched text of each signature equal those of the JVM's pattern."""
    book = rules.RuleBook()
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", *[F.when(F.col("t").rlike(P.jvm(r[2])), F.regexp_extract("t", P.jvm(r[2]), 0)).alias(f"m{i}") for i, r in enumerate(book.rules)]).collect()
    hits = 0
    for i, one in enumerate(book.plan()):
        judge = SG.Judge((one,))
        for r in rows:
            got = judge.first(r["t"], 0.0, {})
            assert (got and got[1]) == r[f"m{i}"], (book.rules[i], r["t"])
            hits += got is not None
    assert hits > len(book.rules)


def test_best_hit_is_the_first_of_the_highest(spark):
    headers = {"User-Agent": "x; ls", "Accept": "' union select 1"}
    rows = [(0, "/", "echo <b onx='1'> `abc`", headers, {"a": None, "b": ""}), (1, None, None, None, None), (2, "/a", "plain SECRET7 words", None, {"q": "%3Cscript%3E"}), (3, "/a", "0x12345", {"Referer": "alert("}, None)]
    out = rules.signature_filter(spark.createDataFrame(rows, REQ), rules.RuleBook([("u", r"(?i)secret\d", "leak")]))
    got = {r["id"]: (r["rule_id"], r["pattern"], r["matched_in"], r["matched_text"], r["decoded_input"], r["decision"]) for r in out.collect()}
    assert got == {0: (None, "Command substitution", "body", "`abc`", "echo <b onx='1'> `abc`", "MITIGATE"), 1: (None, None, None, None, None, "ALLOW"), 2: ("u", "adaptive:u", "body", "SECRET7", "plain SECRET7 words", "MITIGATE"),
                   3: (None, "XSS alert/prompt/confirm", "header:Referer", "alert(", "alert(", "FORWARD_TO_ML")}


def test_texts_are_judged_in_batches(spark):
    plan = rules.signature_filter(spark.createDataFrame([], REQ))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and plan.count("ArrowEvalPython") == 1


def test_one_line_in_order():
    order = P.IN_ORDER["Quote with SQL keyword"]
    assert SG.in_order("a ' b\nselect \" x drop", *order) and not SG.in_order("select 'a\ndrop \"", *order) and not SG.in_order("", *order)
    assert text.fold("A\u0130\u212a") == "aik"
