"""Table sink with the guarantees of an atomic, non-overwriting file write."""

from __future__ import annotations

import posixpath
import uuid
from urllib.parse import urlparse

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

# fixed values
SAME_PATH = "Input and output paths must be different"
OUTPUT_EXISTS = "Output already exists"


def _canonical(path: str) -> tuple[str, str]:
    parsed = urlparse(path)
    return (parsed.scheme or "file") + parsed.netloc, posixpath.normpath(parsed.path)


def write_table(
    df: DataFrame, path: str, force: bool = False, partition_by: tuple[str, ...] = ()
) -> None:
    """Write Parquet and publish it in one step. Refuses to overwrite unless ``force``, and always refuses its own input.

    The files are written to a hidden folder beside ``path``, which is renamed when all of them are there: a reader sees
    the whole table or none of it, and a run that fails leaves what was there and nothing of its own. With ``force`` the old
    table moves aside first and is removed at the end, or comes back if the new one cannot take its place. Where a
    file system's rename is a copy, as in object stores, publishing takes as long as that.
    """
    target = _canonical(path)
    for source in df.inputFiles():
        scheme, location = _canonical(source)
        if scheme == target[0] and (location + "/").startswith(target[1] + "/"):
            raise ValueError(SAME_PATH)
    spark, run = df.sparkSession, uuid.uuid4().hex
    goal = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = goal.getFileSystem(spark._jsc.hadoopConfiguration())
    goal = files.makeQualified(goal)
    beside = {kind: spark._jvm.org.apache.hadoop.fs.Path(goal.getParent(), f".{goal.getName()}.{kind}-{run}") for kind in ("new", "old")}

    def refuse() -> None:
        raise PySparkException(message=f"{OUTPUT_EXISTS}: {path}")

    if files.exists(goal) and not force:
        refuse()
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    try:
        writer.parquet(beside["new"].toString())
        replaced = files.exists(goal)
        if replaced and not force:  # somebody else was faster
            refuse()
        if replaced and not files.rename(goal, beside["old"]):
            raise PySparkException(message=f"The table at {path} cannot be moved aside")
        if not files.rename(beside["new"], goal):
            if replaced:
                files.rename(beside["old"], goal)
            raise PySparkException(message=f"The table cannot be published at {path}")
        if replaced:
            files.delete(beside["old"], True)
    finally:
        files.delete(beside["new"], True)
