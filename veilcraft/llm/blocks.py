"""Comparing the members of a key with one another in bounded blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilcraft.session import materialize


def dealt(members: DataFrame, id_column: str, size: int) -> DataFrame:
    """Rows (key, ...) dealt into blocks of about ``size`` per key, with ``low`` and ``high``: a row goes to every pair of blocks
    that its own is in, so that any two members of a key meet in one place.

    The counts are written before they are joined: adaptive execution splits a hot key only between two shuffles.
    """
    counts = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / size).cast("int").alias("blocks"))
    own = members.join(materialize(counts, "block-counts"), "key").withColumn("block", F.pmod(F.xxhash64(id_column, "key"), F.col("blocks")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("blocks", "other")


def in_order(rows: DataFrame) -> DataFrame:
    """The rows of two blocks one after the other."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, "key", "low", "high").sortWithinPartitions("key", "low", "high")


def groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...] = ("key", "low", "high")) -> Iterator[pa.Table]:
    """Tables of consecutive rows that are equal in ``names``; memory is that of one group and one batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        rows = pa.Table.from_batches([*held, batch]).combine_chunks()
        marks = np.column_stack([rows[name].to_numpy() for name in names])
        cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist()]
        for begin, end in zip(cuts, cuts[1:]):
            yield rows.slice(begin, end - begin)
        held = rows.slice(cuts[-1]).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
