"""Which row of a sheet is its header, and which columns it has.

One pass over the cells: per column, its first row and the values of its first ten
rows. It aggregates before it shuffles, so a sheet that owns most of the corpus costs
no more per task than the others; scores, header row and titles follow from the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veilcraft.functions import text as tx
from veilcraft.operators.joins import lookup_join
from veilcraft.session import materialize

HEADER_ROWS = 10  # fixed value
SHEET = ["file_path", "sheet_index", "sheet_name"]


def _head_cells(cells: DataFrame) -> DataFrame:
    """Non-empty cells of the first rows, one per reference."""
    return (
        cells.where((F.col("row") <= HEADER_ROWS) & (F.col("value") != ""))
        .groupBy(*SHEET, "row", "col")
        .agg(F.max_by("value", "ordinal").alias("value"))
    )


def _scored(head: DataFrame) -> DataFrame:
    return head.groupBy(*SHEET, "row").agg(
        F.count(F.lit(1)).alias("n_cells"),
        (F.sum(tx.header_score(F.col("value"))) + F.count(F.lit(1))).alias("score"),
    )


def header_scores(cells: DataFrame) -> DataFrame:
    """Score of every candidate row: words and spaces count for it, numbers and stubs against."""
    return _scored(_head_cells(cells))


def _picked(scores: DataFrame) -> DataFrame:
    best = F.struct(F.col("score"), F.col("n_cells"), -F.col("row"))
    return scores.where("n_cells > 1").groupBy(*SHEET).agg(F.max_by("row", best).alias("picked"))


def column_extents(cells: DataFrame) -> DataFrame:
    """Every column with a non-empty cell anywhere, and its first row."""
    return (
        cells.where(F.col("value") != "").groupBy(*SHEET, "col").agg(F.min("row").alias("first_row"))
    )


def header_pick(cells: DataFrame) -> DataFrame:
    """Header row per sheet: the best scored row with several cells, else the first row."""
    first = cells.where(F.col("value") != "").groupBy(*SHEET).agg(F.min("row").alias("first_row"))
    return (
        first.join(_picked(header_scores(cells)), SHEET, "left")
        .withColumn("header_row", F.coalesce("picked", "first_row"))
        .drop("picked", "first_row")
    )


def _outline(cells: DataFrame) -> DataFrame:
    """Per column a row for each value of the first rows and one for all below, with first row and last ordinal.

    Values are keys and the aggregates numbers, so that Spark hashes and never sorts the cells.
    """
    within = F.col("row") <= HEADER_ROWS
    return (
        cells.where(F.col("value") != "")
        .groupBy(*SHEET, "col", F.when(within, F.col("row")).alias("head_row"), F.when(within, F.col("value")).alias("value"))
        .agg(F.min("row").alias("first_row"), F.max("ordinal").alias("ordinal"))
    )


def discover_columns(cells: DataFrame) -> DataFrame:
    """Descriptors of all columns: file_path, sheet_index, sheet_name, col, header, start_row, key.

    The outline, a few rows per column, is written to the shared folder, so the big
    table is read once; a second time only for sheets that begin below row 10.
    """
    outline = materialize(_outline(cells), "outline")
    extents = outline.groupBy(*SHEET, "col").agg(F.min("first_row").alias("first_row"))
    head = (
        outline.where("head_row IS NOT NULL")
        .groupBy(*SHEET, F.col("head_row").alias("row"), "col")
        .agg(F.max_by("value", "ordinal").alias("value"))
    )
    first = extents.groupBy(*SHEET).agg(F.min("first_row").alias("first_row"))
    rows = first.join(_picked(_scored(head)), SHEET, "left").select(
        *SHEET, F.coalesce("picked", "first_row").alias("header_row")
    )
    titles = head.withColumnRenamed("row", "header_row")
    late = F.col("first_row") > HEADER_ROWS
    if not first.where(late).isEmpty():
        begin = first.where(late).withColumnRenamed("first_row", "header_row")
        titles = titles.unionByName(_late_titles(cells, begin))
    named = extents.join(rows, SHEET).join(titles, [*SHEET, "col", "header_row"], "left")
    return named.select(
        *SHEET,
        "col",
        F.coalesce("value", F.concat(F.lit("Column "), F.col("col"))).alias("header"),
        (F.col("header_row") + 1).alias("start_row"),
        F.concat_ws("|", F.col("sheet_index").cast("string"), "col").alias("key"),
    )


def _late_titles(cells: DataFrame, late: DataFrame) -> DataFrame:
    below = cells.where((F.col("row") > HEADER_ROWS) & (F.col("value") != ""))
    marked = lookup_join(below.select(*SHEET, "row", "col", "ordinal", "value"), late, SHEET)
    return (
        marked.where(F.col("row") == F.col("header_row"))
        .groupBy(*SHEET, "header_row", "col")
        .agg(F.max_by("value", "ordinal").alias("value"))
    )


def describe_sheets(descriptors: DataFrame) -> DataFrame:
    """One row per sheet with its ordered columns. A sheet has at most 18,278 three-letter columns."""
    namespace = tx.namespace_slug(F.col("header"), F.col("col"))
    column = F.struct(
        tx.column_order(F.col("col")).alias("position"),
        F.col("col"),
        F.col("header"),
        namespace.alias("namespace"),
        F.concat(F.col("sheet_name"), F.lit(": "), F.col("header")).alias("ns_label"),
        F.col("key"),
        F.col("start_row"),
    )
    gathered = descriptors.groupBy(*SHEET).agg(F.array_sort(F.collect_list(column)).alias("columns"))
    return gathered.withColumn("columns", F.transform("columns", lambda c: c.dropFields("position")))
