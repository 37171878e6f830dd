"""Writers: event rows, idempotent appends, upserts, exports, dataset outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade import constants as K
from palisade.operators.dashboards import LAYER_JSON
from palisade.operators.projections import best_label, dedupe_exact

EVENT_JSON = f"""request_id string, ip string, method string, path string, timestamp double, final_score double, action string, block_reason string,
short_circuited boolean, network_score double, latency_ms double, best_label string,
scores struct<regex_conf:double,app_lgbm_score:double,net_lgbm_score:double,deep_anomaly:double>, layer_scores {LAYER_JSON}, _corrupt_record string"""


def parse_events(raw: DataFrame, col: str = "value") -> DataFrame:
    """Queue messages (JSON text) to events; messages that do not parse are dropped."""
    parsed = raw.select(F.from_json(col, EVENT_JSON, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("e")).select("e.*")
    return parsed.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def to_event_rows(events: DataFrame, now_us: int | None = None, widths: dict[str, int] | None = None) -> DataFrame:
    """Column types and defaults of the event table. Texts stay whole unless ``widths`` bounds a column."""
    widths = widths or {}
    bounded = lambda c, value: (F.substring(value, 1, widths[c]) if c in widths else value).alias(c)
    text = lambda c, default: bounded(c, F.coalesce(F.col(c), F.lit(default)))
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    now = F.lit(now_us / 1e6) if now_us is not None else F.unix_micros(F.current_timestamp()) / F.lit(1e6)
    empty = F.array().cast(LAYER_JSON)
    e = events.withColumn("layer_scores", F.coalesce("layer_scores", empty)).withColumn("action", F.coalesce("action", F.lit("ALLOW")))
    stamp = F.coalesce(F.nullif(F.col("timestamp"), F.lit(0.0)), now)
    return e.select(
        text("request_id", ""), text("ip", "0.0.0.0"), text("method", "GET"), text("path", "/"), stamp.alias("timestamp"),
        F.timestamp_micros(F.round(stamp * 1_000_000).cast("bigint")).alias("event_time"),
        zero("final_score").alias("final_score"), text("action", "ALLOW"), text("block_reason", ""), F.coalesce("short_circuited", F.lit(False)).alias("short_circuited"),
        zero("network_score").alias("network_score"), F.col("latency_ms").cast("double").alias("latency_ms"),
        bounded("best_label", F.coalesce(F.nullif("best_label", F.lit("")), best_label(), F.lit("unknown"))),
        *[zero(f"scores.{c}").alias(c) for c in ("regex_conf", "app_lgbm_score", "net_lgbm_score", "deep_anomaly")],
        F.to_json("layer_scores").alias("layer_scores"))


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_paths(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it is not there."""
    at, fs = _at(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []


def remove_path(spark: SparkSession, path: str) -> None:
    at, fs = _at(spark, path)
    fs.delete(at, True)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None where nothing is written yet; a table that can't be read is an error."""
    return spark.read.parquet(path) if read_paths(spark, path) else None


def new_rows(df: DataFrame, existing: DataFrame | None, key: str, order: str) -> DataFrame:
    """First row per key among rows whose key is not stored yet."""
    first = dedupe_exact(df, [key], [order])
    return first if existing is None else first.join(existing.select(key), key, "left_anti")


def append_dedup(df: DataFrame, path: str, key: str = "request_id", order: str = "timestamp", partition_by: str | None = None) -> None:
    """Append rows whose key is new; a repeated delivery changes nothing.

    In a table partitioned by day, say, a repeated delivery has the day of the first: with ``partition_by`` only the
    partitions that the new rows belong to are read for their keys. First and last partition of the batch are a filter
    on the scan, so the other folders are not even listed as tasks.
    """
    existing = read_table(df.sparkSession, path)
    if existing is not None and partition_by:
        existing = existing.withColumn(partition_by, F.col(partition_by).cast(df.schema[partition_by].dataType))  # folder names may read as dates
        first, last = df.agg(F.min(partition_by), F.max(partition_by)).first()
        existing = existing.where(F.col(partition_by).between(F.lit(first), F.lit(last)))
        existing = existing.join(F.broadcast(df.select(partition_by).distinct()), partition_by, "left_semi")  # partitions of one batch
    rows = new_rows(df, existing, key, order)
    writer = rows.write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def upsert_latest(target: DataFrame, updates: DataFrame, key: str = "ip", order: str = "blocked_us") -> DataFrame:
    """Last write wins per key; a partial aggregate, so a hot key shuffles one row per task."""
    both = target.withColumn("__new", F.lit(0)).unionByName(updates.withColumn("__new", F.lit(1)))
    rest = [c for c in target.columns if c != key]
    latest = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, "__new", F.to_json(F.struct(*rest)))).alias("r"))
    return latest.select(key, "r.*").select(*target.columns)


def flatten_honeypot(df: DataFrame) -> DataFrame:
    """Honeypot hits as flat text rows: maps as JSON, tags joined by a pipe."""
    ti = F.col("threat_intel")
    found = F.coalesce(ti["ti_found"], F.lit(False))
    js = lambda c: F.to_json(F.coalesce(F.col(c), F.create_map().cast("map<string,string>"))).alias(c)
    return df.select(
        "timestamp", "ip", "method", "path", js("query_params"), js("form_data"), F.coalesce("raw_body", F.lit("")).alias("raw_body"),
        F.array_join(F.coalesce("tags", F.array().cast("array<string>")), "|").alias("tags"), F.initcap(found.cast("string")).alias("ti_found"),
        F.coalesce(ti["ti_source"], F.lit("")).alias("ti_source"), F.when(found, ti["ti_raw"]).otherwise("").alias("ti_raw"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_partitions(routed: DataFrame, path: str, manifest: dict | None = None) -> None:
    """Benign, known and novel rows in one pass, one folder each, and a feature manifest beside them."""
    routed.write.mode("overwrite").partitionBy("route").parquet(f"{path}/data")
    facts = manifest or {"unified_features": list(K.UNIFIED_FEATURES), "feature_count": len(K.UNIFIED_FEATURES),
                         "targets": ["benign", "ddos", "dos", "portscan", "botnet"], "novel_sources": K.NOVEL_LABELS, "label_map": K.KNOWN_LABELS}
    cols = []
    for k, v in facts.items():
        if isinstance(v, dict):
            cols.append(F.create_map(*[F.lit(x) for kv in v.items() for x in kv]).alias(k))
        elif isinstance(v, list):
            cols.append(F.array(*[F.lit(x) for x in v]).alias(k))
        else:
            cols.append(F.lit(v).alias(k))
    routed.sparkSession.range(1).select(*cols).write.mode("overwrite").json(f"{path}/manifest")


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Metric tables are small: one file."""
    w = df.coalesce(1).write.mode("overwrite")
    w.option("header", True).csv(path) if fmt == "csv" else w.json(path)
