"""Character counts and compact features in Arrow batches equal the column expressions and patterns they stand for."""

import pytest
from pyspark.sql import functions as F

from palisade.functions import lexical, text
from palisade.functions import patterns as P
from palisade.operators import rules
from palisade.sources.adapters import SNIPPETS

ODD = ["", None, "a|b", "a || b", "also cat", "CAT x", "whoamİ x", "unİon", "ſelect", "or 1=1", "or 1=1", "OR  1=1", "x 1=1", "caté", "..\\x", "/ETC/passwd", "²⁵٣ªºǅⅠ", "\U0001f600\U00010400 x", "Kill \x1c\x85", "--", "; --",
       "drop\ttable", "UPDATE a SET", "onload=", "delete  from", "insert x", "a=1 or 1 = 1"]


@pytest.fixture(scope="module")
def df(spark):
    base = [*ODD, *[t for _, t in SNIPPETS]]
    return spark.createDataFrame([(i, t) for i, t in enumerate([*base, *[t.upper() for t in base if t]])], "i int, t string").repartition(3)


def test_classes(df):
    classes = {"digits": text.DIGITS, "letters": r"\p{L}", "alnum": text.ALNUM, "blank": text.BLANK, "upper": text.UPPER, "lower": text.LOWER}
    full = F.coalesce("t", F.lit(""))
    rows = df.select(text.profile(F.col("t"), [], []).alias("p"), F.struct(*[text.count_class(full, c).alias(k) for k, c in classes.items()]).alias("want")).collect()
    assert all(r["p"][k] == r["want"][k] for r in rows for k in classes)


def test_compact_signs(df):
    signs = dict(zip(["has_sql_kw", "has_xss_kw", "has_path_kw", "has_cmd_kw"], [P.COMPACT_SQL, P.COMPACT_XSS, P.COMPACT_PATH, P.COMPACT_CMD]))
    assert [p for p, *_ in P.COMPACT] == list(signs.values())
    rows = lexical.payload_features(df, "t").select("*", *[text.flag(F.col("t").rlike(P.portable(p))).alias(f"want_{k}") for k, p in signs.items()]).collect()
    assert not [(r["t"], k) for r in rows for k in signs if r[k] != r[f"want_{k}"]]
    assert all(0 < sum(r[k] for r in rows) < len(rows) for k in signs)


def test_static_guards_hide_nothing(df):
    low = F.lower("t")
    for p, guard in zip([*P.STATIC_SQLI, *P.STATIC_XSS], P.STATIC_GUARDS, strict=True):
        assert df.where(low.rlike(P.portable(p)) & ~low.contains(guard)).count() == 0
    assert df.where(rules._any(low, P.STATIC_SQLI)).count() > 10


def test_features_are_one_batch_step(df):
    """No class is counted and no sign looked for by a pattern of the engine."""
    for features in (lexical.payload_features, lexical.lexical_features):
        plan = features(df, "t")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and "regexp_replace" not in plan
