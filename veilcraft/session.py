"""Session settings the library relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context

from pyspark.sql import DataFrame, SparkSession

# Binary literals print as 0x… or X'…'; key material must not reach plans or event logs.
KEY_LITERAL_PATTERN = "(?:0x|X')[0-9A-Fa-f]{16,}'?"


def build_session(app_name: str = "veilcraft", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.redaction.string.regex": KEY_LITERAL_PATTERN,
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({name.replace("__", "."): value for name, value in conf.items()})
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app_name)
    for name, value in settings.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def redact_keys(spark: SparkSession) -> None:
    """Hide key literals in ``explain`` output unless the session already redacts something."""
    if not spark.conf.get("spark.sql.redaction.string.regex", None):
        spark.conf.set("spark.sql.redaction.string.regex", KEY_LITERAL_PATTERN)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``; without that setting a folder of the driver's own would be
    read by no executor, so it is an error. Only a local session (a test) gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    fallback = tempfile.mkdtemp(prefix="veilcraft-")
    spark.sparkContext.setCheckpointDir(fallback)
    return fallback


_run: ContextVar[str | None] = ContextVar("run_folder", default=None)


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """A folder of its own for the intermediate tables of a run; it is removed at the end, plain text and all.

    Publish results inside: they may still read from it.
    """
    path = os.path.join(shared_dir(spark), f"run-{uuid.uuid4().hex}")
    before = _run.set(path)
    try:
        yield path
    finally:
        _run.reset(before)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the folder of the run, or else below the shared folder."""
    return os.path.join(_run.get() or shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def widen(df: DataFrame) -> DataFrame:
    """Spread a table that is read in fewer tasks than there are cores, ahead of heavy work per row.

    A file with one row group is one task, however many cores wait. Inputs with
    enough splits are returned as they are; others split at most eight ways.
    """
    splits = max(df.rdd.getNumPartitions(), 1)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if splits >= cores else df.repartition(min(cores, splits * 8))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    A written table survives lost executors and carries file statistics, which
    lets the planner size the joins that follow.
    """
    path = work_path(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_all(**tables: DataFrame) -> dict[str, DataFrame]:
    """:func:`materialize` several tables at once, as concurrent jobs."""
    with ThreadPoolExecutor(len(tables)) as pool:
        written = {label: pool.submit(copy_context().run, materialize, df, label) for label, df in tables.items()}
    return {label: future.result() for label, future in written.items()}
