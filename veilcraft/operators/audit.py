"""What a run changed: counts per namespace, encrypted columns, replacements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from veilcraft.functions.text import column_order


def namespace_counts(
    cells: DataFrame, items: DataFrame | None = None, records: DataFrame | None = None, mode: str = "encrypt"
) -> DataFrame:
    """Values per namespace. Pivot values count apart, under prefixed names.

    Each source is counted before the union, so only counters are shuffled.
    """
    sources = [(cells, "")]
    if items is not None:
        sources.append((items, "pivot-"))
    if records is not None:
        sources.append((records, "pivot-record-" if mode == "encrypt" else "pivot-"))
    counted = [
        df.where(F.col("namespace").isNotNull())
        .groupBy(F.concat(F.lit(prefix), F.col("namespace")).alias("namespace"))
        .agg(F.count(F.lit(1)).alias("n"))
        for df, prefix in sources
    ]
    if len(counted) == 1:
        return counted[0]
    return reduce(DataFrame.unionByName, counted).groupBy("namespace").agg(F.sum("n").alias("n"))


def total_values(counts: DataFrame) -> DataFrame:
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def replacement_total(*replaced: DataFrame) -> DataFrame:
    """Sum of the ``replacements`` columns of all layouts."""
    sums = [df.agg(F.sum("replacements").alias("n")) for df in replaced]
    return reduce(DataFrame.unionByName, sums).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("replacements"))


def encrypted_columns(cells: DataFrame) -> DataFrame:
    """Encrypted columns, one row each, with the position at which each was first met."""
    touched = cells.where(F.col("namespace").isNotNull())
    return touched.groupBy("file_path", "sheet_index", "sheet_name", "col", "header").agg(
        F.min("ordinal").alias("first_ordinal"), F.min("row").alias("first_row"), F.count(F.lit(1)).alias("n")
    )


def headers_by_sheet(columns: DataFrame) -> DataFrame:
    """Encrypted headers per sheet in the order they were first met."""
    met = F.struct("first_ordinal", column_order(F.col("col")).alias("position"), "header")
    return columns.groupBy("file_path", "sheet_index", "sheet_name").agg(
        F.transform(F.array_sort(F.collect_list(met)), lambda c: c["header"]).alias("headers")
    )
