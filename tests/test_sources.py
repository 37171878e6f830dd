"""Scans against the plain readers of the same files."""

import json

import pytest
from pyspark.sql import functions as F

from palisade.sources import readers


def hits(n):
    odd = ["a\n  }", "}\n  },\n  {", "\u2028 \"quoted\" \\\\", "", None, "[", "é" * 50]
    return [{"ip": f"10.0.0.{i % 250}", "method": "POST", "path": f"/p/{i}", "query_params": {"a": "}", "b": ""}, "headers": {}, "raw_body": odd[i % len(odd)],
             "tags": ["XSS:0.5", "SQLi:1.0"][: i % 3], "threat_intel": {"ti_source": "x", "ti_found": i % 2 == 0, "ti_raw": None}} for i in range(n)]


def write(path, rows, **layout):
    path.write_text(json.dumps(rows, ensure_ascii=False, **layout), encoding="utf-8")
    return str(path)


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("n", [0, 1, 2, 400])
def test_array_equals_the_plain_reader(spark, tmp_path, n):
    path = write(tmp_path / "log.json", hits(n), indent=2)
    assert rows_of(readers.read_honeypot_array(spark, path)) == rows_of(readers.read_honeypot_json(spark, path))
    assert readers.read_honeypot_array(spark, path).count() == n


@pytest.mark.parametrize("size", [997, 4096, 65537])
def test_one_file_is_read_by_several_tasks(spark, tmp_path, size):
    path = write(tmp_path / "log.json", hits(1000), indent=2)
    before, cost = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        df = readers.read_honeypot_array(spark, path)
        assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 2
        assert sorted(r["path"] for r in df.collect()) == sorted(f"/p/{i}" for i in range(1000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


@pytest.mark.parametrize("layout", [{}, {"indent": 4}, {"indent": 1}])
def test_another_layout_is_an_error(spark, tmp_path, layout):
    path = write(tmp_path / "log.json", hits(5), **layout)
    with pytest.raises(Exception, match="not a JSON array with an indent of 2"):
        readers.read_honeypot_array(spark, path).collect()
    if layout.get("indent"):
        assert readers.read_honeypot_array(spark, path, layout["indent"]).count() == 5


def test_empty_elements_are_an_error(spark, tmp_path):
    for rows in ([{}], [*hits(2), {}], [hits(1)[0], {}, hits(1)[0]], [1, 2]):
        with pytest.raises(Exception, match="not a JSON array"):
            readers.read_honeypot_array(spark, write(tmp_path / "log.json", rows, indent=2)).collect()
