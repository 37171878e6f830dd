"""Streaming jobs: watermarks, windows, de-duplication, sinks, rule reload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from palisade import constants as K
from palisade.operators.rules import RuleBook, signature_filter
from palisade.operators.temporal import newest_buffer
from palisade.session import ROCKSDB, fresh_dir
from palisade.sources.sinks import append_dedup, read_paths, remove_path

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def with_event_time(df: DataFrame, ts_us: str = "t_us", delay: str = "60 seconds") -> DataFrame:
    """Event time from an epoch column, with a watermark: later rows are dropped and counted by Spark."""
    return df.withColumn("event_time", F.timestamp_micros(F.col(ts_us))).withWatermark("event_time", delay)


def late_rows(query: StreamingQuery) -> int:
    """Rows dropped behind the watermark so far."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p["stateOperators"])


def rpm_stream(events: DataFrame) -> DataFrame:
    """Requests per minute; ``events`` carry ``event_time`` with a watermark."""
    w = F.window("event_time", "1 minute")
    return (events.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("action") == "BLOCK", 1)).alias("blocked"))
                  .select(F.col("w.start").alias("minute"), "total", "blocked"))


def dedupe_stream(events: DataFrame, key: str = "request_id") -> DataFrame:
    return events.dropDuplicatesWithinWatermark([key])


def file_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """Parquet files as a stream; ``max_files`` is the rate limit that bounds a trigger."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def run_to_table(df: DataFrame, name: str) -> DataFrame:
    """Run a stream over everything available, into a table of the shared folder, and read it back."""
    spark = df.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKSDB:
        spark.conf.set(PROVIDER, ROCKSDB)
    out = fresh_dir(spark, name)
    query = (df.writeStream.format("parquet").outputMode("append").option("path", out)
               .option("checkpointLocation", fresh_dir(spark, name + "-progress")).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def event_sink(events: DataFrame, table: str, progress: str, available_now: bool = False) -> StreamingQuery:
    """Events to the event table, at most every five seconds; a batch that is delivered again adds nothing.

    The table has one folder per day of the event's ``timestamp`` (epoch seconds; column ``day``, "none" where it is
    null), and a batch reads the keys of its own days only. A row delivered again has the timestamp it had before.
    """
    dated = events.withColumn("day", F.coalesce(F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd"), F.lit("none")))
    writer = dated.writeStream.foreachBatch(lambda batch, _: append_dedup(batch, table, partition_by="day")).option("checkpointLocation", progress)
    timed = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{K.FLUSH_SECONDS} seconds")
    return timed.start()


def newest_stream(events: DataFrame, table: str, progress: str, n: int = K.NEWEST_EVENTS_CAP, ts_us: str = "ts_us", tie: str = "event_id", available_now: bool = False) -> StreamingQuery:
    """Keep the newest ``n`` rows of a stream, as the bounded event list does.

    A trigger merges its batch with the ``n`` rows of the trigger before and writes them as a version of their own, so
    its work follows the batch and never the history, and a trigger that is run again replaces itself. The version
    before stays for readers; older ones are removed.
    """
    stored = T.StructType([*events.schema.fields, T.StructField("batch_id", T.LongType())])

    def keep(batch: DataFrame, batch_id: int) -> None:
        spark, rows, last = batch.sparkSession, batch, None
        if read_paths(spark, table):
            past = spark.read.schema(stored).parquet(table).where(F.col("batch_id") < batch_id)
            last = past.agg(F.max("batch_id")).first()[0]
            rows = batch if last is None else batch.unionByName(past.where(F.col("batch_id") == last).drop("batch_id"))
        newest_buffer(rows, n, ts_us, tie).write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")
        for name in read_paths(spark, table):
            number = name.removeprefix("batch_id=")
            if last is not None and number.isdigit() and int(number) < last:
                remove_path(spark, f"{table}/{name}")

    writer = events.writeStream.foreachBatch(keep).option("checkpointLocation", progress)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{K.FLUSH_SECONDS} seconds")).start()


def newest_of(spark: SparkSession, table: str) -> DataFrame:
    """The rows ``newest_stream`` keeps at the moment."""
    rows = spark.read.parquet(table)
    return rows.where(F.col("batch_id") == F.lit(rows.agg(F.max("batch_id")).first()[0])).drop("batch_id")


def score_stream(requests: DataFrame, rules_path: str, table: str, progress: str, available_now: bool = False) -> StreamingQuery:
    """Signature verdicts of a request stream; the rule table is read anew for every trigger.

    Every batch has a folder of its own (column ``batch_id`` when read), so a batch that is run again replaces itself.
    ``rules_version`` says which rules a row was judged by. The few files of a trigger are dealt to all cores by rows, as
    the patterns take far longer than the scan.
    """

    def score(batch: DataFrame, batch_id: int) -> None:
        book = RuleBook.from_table(batch.sparkSession.read.parquet(rules_path))
        dealt = batch.repartition(2 * batch.sparkSession.sparkContext.defaultParallelism)
        signature_filter(dealt, book).withColumn("rules_version", F.lit(book.version)).write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    writer = requests.writeStream.foreachBatch(score).option("checkpointLocation", progress)
    timed = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{K.RULE_RELOAD_SECONDS} seconds")
    return timed.start()
