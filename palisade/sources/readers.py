"""Scans: flow CSV folders, connection records, honeypot logs, packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade import constants as K


def normalize_name(name: str, mode: str = "strip") -> str:
    s = name.strip()
    if mode == "lower":
        return s.lower()
    if mode == "snake":
        return s.replace(" ", "_").replace("-", "_").lower()
    return s


def normalize_columns(df: DataFrame, mode: str = "strip") -> DataFrame:
    """Header clean-up: ``strip``, ``lower`` or ``snake``; a repeated name gets a numeric suffix."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        n = normalize_name(c, mode)
        seen[n] = seen.get(n, -1) + 1
        names.append(n if seen[n] == 0 else f"{n}.{seen[n]}")
    return df.toDF(*names)


def list_files(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """Sorted files of a folder on any file system Spark can read; names only, no data."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in fs.listStatus(path) if s.getPath().getName().endswith(suffix))


def first_line(spark: SparkSession, file: str) -> str:
    """Header of one file; only its first block is opened."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
    try:
        return reader.readLine() or ""
    finally:
        reader.close()


def read_flows_csv(spark: SparkSession, folder: str, mode: str = "strip") -> DataFrame:
    """All CSV files of a folder as text columns, with the file each row came from.

    Files that share a header are scanned together; each different header is one more scan, and the
    scans are united by name. Types are settled later with ``try_cast``, so no sampling pass is needed.
    """
    files = list_files(spark, folder, ".csv")
    if not files:
        raise FileNotFoundError(f"no CSV files in {folder}")
    groups: dict[str, list[str]] = {}
    for f in files:
        groups.setdefault(first_line(spark, f), []).append(f)
    out = None
    for head in sorted(groups):
        part = spark.read.option("header", True).csv(groups[head])
        part = normalize_columns(part, mode).withColumn("source_file", file_name())
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_headerless(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """CSV without header under an explicit schema; connection records by default."""
    names = columns or K.CONNECTION_COLUMNS
    text = set(K.CONNECTION_CATEGORICALS) | {"label"}
    schema = T.StructType([T.StructField(c, T.StringType() if c in text else T.DoubleType()) for c in names])
    return spark.read.schema(schema).csv(path)


HONEYPOT_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()), T.StructField("ip", T.StringType()),
    T.StructField("method", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("query_params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("form_data", T.MapType(T.StringType(), T.StringType())),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
    T.StructField("raw_body", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("threat_intel", T.StructType([
        T.StructField("ti_source", T.StringType()), T.StructField("ti_found", T.BooleanType()),
        T.StructField("ti_raw", T.StringType())])),
])


def read_honeypot_json(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Honeypot log: a JSON array, or one object per line (which Spark can split) with ``multiline=False``."""
    return spark.read.schema(HONEYPOT_SCHEMA).option("multiLine", multiline).json(path)


def read_honeypot_array(spark: SparkSession, path: str, indent: int = 2) -> DataFrame:
    """Honeypot log kept as one indented JSON array, split inside the file like any line format.

    JSON text holds no bare line break inside a string, so a line break, ``indent`` spaces and a closing brace end an
    element and nothing else does. They serve as the separator of the scan, which cuts files at any of them. An array
    of another layout (on one line, another indent, elements that are empty or no objects) is an error and not a loss:
    ``read_honeypot_json`` reads those.
    Empty files and empty arrays give no rows; a broken element gives nulls, as in the other readers.
    """
    end = "\n" + " " * indent + "}"
    piece = F.col("value")
    closing, opening = piece.rlike(r"\A\s*(\[\s*\])?\s*\z|\A\s*\]\s*\z"), piece.rlike(r"\A\s*[\[,]\s*\n" + " " * indent + r"\{\s*\n")
    body = F.when(opening, F.concat(F.regexp_replace(piece, r"\A\s*[\[,]\s*", ""), F.lit(end)))
    checked = F.coalesce(body, F.raise_error(F.lit(f"not a JSON array with an indent of {indent}")))
    pieces = spark.read.option("lineSep", end).schema("value string").text(path).where(~closing)
    return pieces.select(F.from_json(checked, HONEYPOT_SCHEMA).alias("r")).select("r.*")


PACKET_SCHEMA = T.StructType([
    T.StructField("packet_id", T.LongType()), T.StructField("t_us", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("flags", T.IntegerType()),
    T.StructField("src_ip", T.StringType()), T.StructField("dst_ip", T.StringType()),
])


def packets(df: DataFrame, local_ip: str) -> DataFrame:
    """Captured packets to flow input: remote address and direction; packets without an address go."""
    back = F.col("src_ip") == local_ip
    return (df.where(F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull())
              .select("packet_id", F.when(back, F.col("dst_ip")).otherwise(F.col("src_ip")).alias("remote_ip"), "t_us",
                      "length", F.coalesce("flags", F.lit(0)).alias("flags"),
                      F.when(back, "bwd").otherwise("fwd").alias("direction")))


def file_name():
    return F.element_at(F.split(F.input_file_name(), "/"), -1)


def per_file_counts(df: DataFrame, label: str) -> DataFrame:
    """Rows per source file and label, straight from the scan."""
    return df.groupBy(file_name().alias("source_file"), label).agg(F.count(F.lit(1)).alias("cnt"))


def audit_columns(df: DataFrame, required: list[str], mode: str = "lower") -> DataFrame:
    """Which required columns are present, missing or extra after header clean-up."""
    have = {normalize_name(c, mode) for c in df.columns}
    want = {normalize_name(c, mode) for c in required}
    rows = [(c, "present" if c in have else "missing") for c in sorted(want)] + [(c, "extra") for c in sorted(have - want)]
    return df.sparkSession.createDataFrame(rows, "column string, status string")


def diff_columns(a: DataFrame, b: DataFrame) -> tuple[list[str], list[str]]:
    """Columns only in ``a`` and only in ``b``."""
    return sorted(set(a.columns) - set(b.columns)), sorted(set(b.columns) - set(a.columns))
