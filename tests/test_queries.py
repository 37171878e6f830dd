"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import compare, duck
from palisade.catalog import load

QUERIES, TWINS = load()


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, small, con, name):
    assert compare(spark, small, name, QUERIES[name], TWINS[name], con) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(TWINS) - {"m12_grid_search"}))
def test_rows_only(spark, small, name):
    df = QUERIES[name](spark, small)
    row = df.first()
    assert row is not None and any(v is not None for v in row)


def test_names():
    assert set(TWINS) <= set(QUERIES)
    assert not any(q.startswith("op") or "pipeline" in q for q in QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(TWINS) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).columns == ["ip", "requests", "blocked", "max_score", "last_attack_iso"]
