"""The grid search fits its whole grid."""

from itertools import product
from types import SimpleNamespace

from palisade.catalog import load
from palisade.operators import models


def test_query_fits_every_point(spark, small, monkeypatch):
    class Fits:
        def __init__(self, estimatorParamMaps, numFolds, parallelism, **_):
            assert numFolds == 3 and 1 <= parallelism <= 8
            self.points = estimatorParamMaps

        def fit(self, rows):
            assert rows.count() > 0
            return SimpleNamespace(avgMetrics=[0.5] * len(self.points))

    monkeypatch.setattr(models, "CrossValidator", Fits)
    got = {(r["numTrees"], r["maxDepth"], r["minInstancesPerNode"]) for r in load()[0]["m12_grid_search"](spark, small).collect()}
    assert got == set(product([20, 50, 100], [5, 8, 12], [1, 5, 20]))


def test_a_named_grid_is_scored(spark):
    rows = spark.createDataFrame([(float(i % 7), float(i % 3), "a" if i % 7 < 4 else "b") for i in range(120)], "x double, y double, kind string")
    got = models.grid_search(rows, ["x", "y"], "kind", {"numTrees": [3], "maxDepth": [1, 3], "minInstancesPerNode": [1]}).collect()
    assert [r["maxDepth"] for r in got] == [3, 1] or got[0]["macro_f1"] == got[1]["macro_f1"]
    assert got[0]["macro_f1"] > 0.9
