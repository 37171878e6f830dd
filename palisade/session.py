"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

SPREAD = "spark.palisade.spreadSmallScans"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(cpus: int = 8, app: str = "palisade", partitions: int | None = None, checkpoint_dir: str | None = None) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own, and its own checkpoint folder."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        .config("spark.checkpoint.dir", checkpoint_dir or tempfile.mkdtemp(prefix="palisade-"))
        .config(SPREAD, "true")
        .getOrCreate()
    )


def pin_utc(spark: SparkSession) -> None:
    """Epoch arithmetic on zone-free timestamps needs a fixed session zone."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Without the setting a session of one machine, as in tests, gets a folder of its own once; on a cluster such a
    folder would not survive the loss of the machine, so an unset folder is an error there.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="palisade-"))
    return spark.conf.get("spark.checkpoint.dir")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and continue from the stored table.

    Used where a result feeds several later steps of an iterative job: it is computed once, later
    steps read only the columns they need, and a lost executor costs no recomputation.
    """
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, as ``--py-files`` would; once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(), "palisade.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("palisade", os.path.relpath(full, root)))
    sc.addPyFile(archive)  # Spark serves the file to every executor
    _shipped.add(sc.applicationId)
