"""Synthetic minority rows between a row and one of its k nearest neighbours of the same class.

Neighbours are exact. The distinct vectors of a class are cut into cells of bounded size by a tree of quantile cuts,
always along the feature of largest spread. The best found inside the own cell bound how far a better neighbour can
be; each vector then walks down the tree of cell boxes, level by level as an equality join on the cell, into the
cells that its own ball touches and no others. Visitors of a cell are dealt into parts, so no task holds more than
one cell and a bounded number of visitors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.operators.sampling import class_counts, unit
from palisade.operators.scale import hash52, rank_by_hash
from palisade.session import materialize

#: Slices a cell is cut into at a time.
FAN = 8
#: Vectors that meet one cell in one task.
VISITORS = 4096
#: Room for rounding between a distance and the distance to a box.
SLACK = 1e-9
NEAR = "array<struct<d:double,id:long,v:array<double>>>"
ROOT = "0"


def _candidates(x, y, k, room=1 << 21):
    """Pairs (row of ``x``, row of ``y``) that hold the k + 1 nearest of each row with all ties, from blocks of bounded size.

    Squared distances from a matrix product are off by rounding, in proportion to the centred vectors; the cut leaves
    room for it, so what is left out is farther than k + 1 others.
    """
    middle = y.mean(axis=0)
    x, y = x - middle, y - middle
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    slack = 1e-12 * (xx.max() ** 0.5 + yy.max() ** 0.5) ** 2
    step = max(1, room // max(1, len(y)))
    for i in range(0, len(x), step):
        near = yy[None, :] - 2.0 * (x[i:i + step] @ y.T) + xx[i:i + step, None]
        last = np.partition(near, k, axis=1)[:, k] if k < len(y) else np.full(len(near), np.inf)
        rows, cols = np.nonzero(~(near > last[:, None] + slack))  # what overflows is kept
        yield rows + i, cols


def _nearest(x, y, ids, k):
    """Per row of ``x``: the k + 1 nearest ids of ``y`` (which has several ids a row), by distance, then id."""
    out = [[] for _ in range(len(x))]
    for rows, cols in _candidates(x, y, k):
        exact = ((x[rows] - y[cols]) ** 2).sum(axis=1) ** 0.5
        for i, j, d in zip(rows.tolist(), cols.tolist(), exact.tolist()):
            out[i].extend((d, int(one), j) for one in ids[j])
    return [[{"d": d, "id": one, "v": y[j].tolist()} for d, one, j in sorted(found)[:k + 1]] for found in out]


def _dealt(df: DataFrame, on: list[str]) -> DataFrame:
    """``df`` by its keys in enough tasks for the cores: groups are few bytes and much work, which the adaptive planner
    would put into a few tasks."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *on)


def vectors(df: DataFrame, label: str, feats: list[str], key: str) -> DataFrame:
    """(label, id, v) of all rows, stored: they are read for the cells and again for the result."""
    v = F.array(*[F.col(f"`{f}`").cast("double") + F.lit(0.0) for f in feats])  # adding zero makes -0.0 and 0.0 one
    return materialize(df.select(F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{key}`").cast("long").alias("id"), v.alias("v")), "vectors")


def entries(rows: DataFrame, k: int) -> DataFrame:
    """(label, eid, ids, v): the distinct finite vectors of each class with their k + 1 smallest ids; ``eid`` is the smallest."""
    finite = rows.where(F.col("label").isNotNull() & F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    # The limit on the rank is applied before the shuffle as well, so a vector of many copies fills no task.
    first = finite.withColumn("__r", F.row_number().over(Window.partitionBy("label", "v").orderBy("id"))).where(F.col("__r") <= k + 1)
    return first.groupBy("label", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("label", F.col("ids")[0].alias("eid"), "ids", "v")


def cut_cells(rows: DataFrame, dims: int, cell_rows: int) -> DataFrame:
    """``rows`` with ``cell``, the path of a leaf of at most ``cell_rows`` distinct vectors.

    A round cuts every larger cell at the quantiles of its widest feature. A feature whose quantiles all equal its
    maximum is cut at its mean or minimum, so each round leaves at least two parts.
    """
    x = lambda i: F.col("v")[i]
    cells = materialize(rows.withColumn("cell", F.lit(ROOT)), "cells")
    while True:
        large = materialize(cells.groupBy("label", "cell").count().where(F.col("count") > cell_rows).drop("count"), "large")
        if large.isEmpty():
            return cells
        shares = [(i + 1) / FAN for i in range(FAN - 1)]
        stats = cells.join(large, ["label", "cell"], "left_semi").groupBy("label", "cell").agg(
            *[F.struct(F.stddev_pop(x(i)).alias("spread"), F.min(x(i)).alias("lo"), F.max(x(i)).alias("hi"), F.avg(x(i)).alias("mid"),
                       F.percentile_approx(x(i), shares, 1000).alias("q")).alias(f"s{i}") for i in range(dims)])

        def axis(i: int) -> Column:
            s = F.col(f"s{i}")
            inner = F.array_sort(F.array_distinct(F.filter(F.concat(s["q"], F.array(s["mid"])), lambda c: (c >= s["lo"]) & (c < s["hi"]))))
            cuts = F.when(F.size(inner) > 0, inner).otherwise(F.array(s["lo"]))
            return F.when(s["hi"] > s["lo"], F.struct(s["spread"].alias("spread"), F.lit(i).alias("axis"), cuts.alias("cuts")))

        best = F.array_max(F.array_compact(F.array(*[axis(i) for i in range(dims)])))
        cuts = materialize(stats.select("label", "cell", best.alias("c")).select("label", "cell", "c.axis", "c.cuts"), "cuts")
        value = F.get("v", F.col("axis"))
        slot = F.size(F.filter("cuts", lambda c: value > c))
        placed = F.when(F.col("axis").isNull(), F.col("cell")).otherwise(F.concat_ws(".", "cell", slot.cast("string")))
        cells = materialize(cells.join(cuts, ["label", "cell"], "left").select(*rows.columns, placed.alias("cell")), "cells")


def _parent(cell: Column) -> Column:
    return F.regexp_replace(cell, r"\.\d+$", "")


def _reach(cells: DataFrame, k: int) -> DataFrame:
    """(label, eid, cell, far, near): the best of the own cell, ``far`` no nearer than the (k + 1)-th id of the whole class.

    A cell of too few ids takes its bound from a few vectors of the cell that it was cut from, which has enough.
    """
    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.vstack(pdf["v"].to_numpy())
        near = _nearest(x, x, pdf["ids"].tolist(), k)
        far = [n[-1]["d"] if len(n) > k else float("inf") for n in near]
        return pd.DataFrame({"label": pdf["label"], "cell": pdf["cell"], "eid": pdf["eid"], "far": far, "near": near})

    first = materialize(_dealt(cells, ["label", "cell"]).groupBy("label", "cell").applyInPandas(own, f"label string, cell string, eid long, far double, near {NEAR}"), "near")
    short = first.where((F.col("far") == float("inf")) & (F.col("cell") != ROOT)).select("label", "eid", "cell")
    under = short.select("label", _parent(F.col("cell")).alias("parent")).distinct()
    inside = cells.select("label", "eid", "ids", "v", F.col("cell").alias("leaf"))
    # Cells are only cut where they hold more than enough; every prefix of a leaf's path is a cell that held it.
    prefixes = F.transform(F.sequence(F.lit(1), F.size(F.split("leaf", r"\."))), lambda n: F.array_join(F.slice(F.split("leaf", r"\."), 1, n), "."))
    held = inside.withColumn("parent", F.explode(prefixes)).join(under, ["label", "parent"], "left_semi")
    few = held.withColumn("__r", F.row_number().over(Window.partitionBy("label", "parent").orderBy("eid"))).where(F.col("__r") <= k + 2)
    near_by = few.groupBy("label", "parent").agg(F.collect_list("v").alias("vs"))
    lone = short.join(cells.select("label", "eid", "v"), ["label", "eid"]).withColumn("parent", _parent(F.col("cell"))).join(near_by, ["label", "parent"])
    away = lambda w: F.sqrt(F.aggregate(F.zip_with("v", w, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, t: s + t))
    bound = lone.select("label", "eid", F.array_max(F.transform("vs", away)).alias("bound"))
    return first.join(bound, ["label", "eid"], "left").withColumn("far", F.least("far", F.coalesce("bound", F.lit(float("inf"))))).drop("bound")


def visits(cells: DataFrame, reach: DataFrame, dims: int) -> DataFrame:
    """(label, eid, v, cell): the cells other than its own that the ball of a vector touches, by descent through the boxes."""
    box = cells.groupBy("label", "cell").agg(*[f(F.col("v")[i]).alias(f"{n}{i}") for i in range(dims) for n, f in (("lo", F.min), ("hi", F.max))])
    box = materialize(box, "boxes")
    depth = box.agg(F.max(F.size(F.split("cell", r"\.")))).first()[0] or 1
    ends = [f"{n}{i}" for i in range(dims) for n in ("lo", "hi")]
    at = reach.where(F.col("far") > 0).select("label", "eid", "far", F.col("cell").alias("home"))
    at = at.join(cells.select("label", "eid", "v"), ["label", "eid"]).withColumn("cell", F.lit(ROOT))
    for level in range(2, depth + 1):
        node = F.substring_index("cell", ".", level)
        level_box = box.withColumn("node", node).groupBy("label", "node").agg(*[(F.min if e[0] == "l" else F.max)(e).alias(e) for e in ends])
        # A leaf above this level is its own and only part here.
        parts = level_box.withColumn("cell", F.substring_index("node", ".", level - 1))
        gap = sum((F.pow(F.greatest(F.col(f"lo{i}") - F.col("v")[i], F.col("v")[i] - F.col(f"hi{i}"), F.lit(0.0)), 2) for i in range(dims)), F.lit(0.0))
        at = at.join(parts, ["label", "cell"]).where(F.sqrt(gap) <= F.col("far") * (1 + SLACK)).select("label", "eid", "far", "home", "v", F.col("node").alias("cell"))
    return at.where(F.col("cell") != F.col("home")).select("label", "eid", "far", "v", "cell")


def k_nearest(df: DataFrame, label: str, feats: list[str], key: str, k: int = 5, cell_rows: int = 512) -> DataFrame:
    """(label, id, v, near): the k nearest rows of the same class, nearest first, ties to the smaller id.

    ``key`` is an integer, different in each row. Rows of a null label, or with a null, NaN or infinite feature, are not
    in the result and nobody's neighbour. A class of fewer rows gives all it has. Empty input gives no rows.
    """
    dims = len(feats)
    # A cell that is cut must hold the k + 1 ids and itself.
    rows = vectors(df, label, feats, key)
    cells = cut_cells(entries(rows, k), dims, max(cell_rows, k + 2))
    reach = materialize(_reach(cells, k), "reach")
    met = materialize(visits(cells, reach, dims), "visits")
    deals = met.groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("parts"))
    left = met.join(deals, ["label", "cell"]).withColumn("part", F.pmod(F.xxhash64("eid"), F.col("parts")).cast("int"))
    right = cells.join(deals, ["label", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # its own column identities for the cogroup

    def across(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if l.empty or r.empty:
            return pd.DataFrame({"label": [], "eid": [], "d": [], "id": [], "v": []})
        near = _nearest(np.vstack(l["v"].to_numpy()), np.vstack(r["v"].to_numpy()), r["ids"].tolist(), k)
        rows = [(lab, e, n["d"], n["id"], n["v"]) for lab, e, far, found in zip(l["label"], l["eid"], l["far"], near) for n in found if n["d"] <= far * (1 + SLACK)]
        return pd.DataFrame(rows, columns=["label", "eid", "d", "id", "v"])

    on = ["label", "cell", "part"]
    more = _dealt(left, on).groupBy(*on).cogroup(_dealt(right, on).groupBy(*on)).applyInPandas(across, "label string, eid long, d double, id long, v array<double>")
    found = reach.select("label", "eid", F.explode("near").alias("n")).select("label", "eid", "n.d", "n.id", "n.v").unionByName(more)
    best = Window.partitionBy("label", "eid").orderBy("d", "id")
    kept = found.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= k + 1)
    near = kept.groupBy("label", "eid").agg(F.array_sort(F.collect_list(F.struct("d", "id", "v"))).alias("near"))
    found = rows.join(cells.select("label", "v", "eid"), ["label", "v"]).join(near, ["label", "eid"])
    return found.select("label", "id", "v", F.slice(F.filter("near", lambda n: n["id"] != F.col("id")), 1, k).alias("near"))


def smote(df: DataFrame, label: str, feats: list[str], key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """The given rows plus synthetic ones until every class is as large as the largest.

    Appends ``synthetic`` and ``source_id``. A class of one row has no neighbour and stays as it is, and so do rows of a
    null label or with a feature that isn't finite; they count towards the size of their class.
    """
    counts = class_counts(df.where(F.col(f"`{label}`").isNotNull()), label).select(F.col(f"`{label}`").cast("string").alias("label"), "n")
    top = counts.agg(F.max("n").alias("top"))
    need = counts.crossJoin(F.broadcast(top)).where(F.col("n") < F.col("top")).select("label", (F.col("top") - F.col("n")).alias("need"))
    small = df.join(need.select(F.col("label").alias("__label")), F.col(f"`{label}`").cast("string") == F.col("__label"), "left_semi")
    near = materialize(k_nearest(small, label, feats, key, k).where(F.size("near") > 0), "neighbours")
    usable = near.groupBy("label").agg(F.count(F.lit(1)).alias("m")).join(need, "label")
    ranked = rank_by_hash(near.select("label", "id"), ["label"], ["id"], seed, name="r").join(usable, "label")
    times = (F.floor(F.col("need") / F.col("m")) + (F.col("r") <= F.pmod("need", "m")).cast("long")).cast("int")
    drawn = ranked.withColumn("times", times).where(F.col("times") > 0).select("label", "id", "times")
    # Dealt before a row becomes its copies: the joined rows are few bytes, the copies are the work.
    j = _dealt(near.join(drawn, ["label", "id"]), ["label", "id"]).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("times"))))
    other = F.get("near", F.pmod(hash52("id", "i", seed=seed), F.size("near")).cast("int"))["v"]
    gap = unit(["id", "i"], "gap", seed)
    made = j.select("label", "id", F.zip_with("v", other, lambda x, y: x + (y - x) * gap).alias("v"))
    cols = [F.col("v")[i].alias(f) for i, f in enumerate(feats)]
    new = made.select(F.col("label").cast(df.schema[label].dataType).alias(label), *cols, F.lit(True).alias("synthetic"), F.col("id").alias("source_id"))
    old = df.select(f"`{label}`", *[F.col(f"`{f}`").cast("double").alias(f) for f in feats], F.lit(False).alias("synthetic"), F.col(f"`{key}`").cast("long").alias("source_id"))
    return old.unionByName(new)
