"""Joins that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 * 1024 * 1024


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` is small enough to copy to every executor.

    Takes the sizes of at most ``rows`` + 1 rows, partition by partition, so a large
    table is left after its first few.
    """
    text_bytes = sum(
        (
            F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
            if f.dataType.typeName() in ("string", "binary")
            else F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))), F.lit(0))
            if f.dataType.typeName() in ("array", "map", "struct")
            else F.lit(8)
            for f in df.schema.fields
        ),
        F.lit(0),
    )
    sizes = df.select(text_bytes.cast("bigint").alias("bytes")).take(rows + 1)
    return len(sizes) <= rows and sum(row["bytes"] for row in sizes) <= size


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    small: bool | None = None,
) -> DataFrame:
    """Left join of a large table with a lookup whose keys are unique.

    A lookup known to be small is broadcast. Otherwise Spark sizes it when it has been
    shuffled: a small one is broadcast after all, and where a key, or NULL, owns a large share of the
    facts, adaptive execution splits its partition, as lookup keys are unique.
    """
    return facts.join(F.broadcast(lookup) if small else lookup, list(on), "left")
