"""Find-and-replace over documents made of paragraphs and runs.

``paragraphs``: doc, part, para_index, runs (array of text), and optionally
spans (slices of nested paragraphs).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from veilcraft.functions.replace import replaced_runs

PARAGRAPH = ["doc", "part", "para_index"]


def gather_paragraphs(runs: DataFrame) -> DataFrame:
    """Paragraphs from one row per run (doc, part, para_index, run_index, text): the runs of one paragraph come together.

    Documents of any size pass; the size of a package is judged where it is unzipped.
    """
    ordered = F.array_sort(F.collect_list(F.struct("run_index", "text")))
    return (
        runs.groupBy(*PARAGRAPH)
        .agg(ordered.alias("_r"))
        .select(*PARAGRAPH, F.transform("_r", lambda r: r["text"]).alias("runs"))
    )


def replace_paragraphs(paragraphs: DataFrame, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """Both replacement passes on every paragraph; adds ``replacements``."""
    spans = F.col("spans") if "spans" in paragraphs.columns else None
    done = paragraphs.withColumn("_r", replaced_runs(F.col("runs"), rules, spans))
    return (
        done.withColumn("runs", F.col("_r.runs")).withColumn("replacements", F.col("_r.n")).drop("_r")
    )


def document_totals(replaced: DataFrame, what: str = "document", files: DataFrame | None = None) -> DataFrame:
    """Replacements per document, and the error a document without any match gets.

    ``files`` lists the documents (doc): one without any paragraph has a total too.
    """
    totals = replaced.groupBy("doc").agg(F.sum("replacements").alias("replacements"))
    if files is not None:
        totals = files.select("doc").distinct().join(totals, "doc", "left").withColumn("replacements", F.coalesce("replacements", F.lit(0).cast("bigint")))
    return totals.withColumn("error", F.when(F.col("replacements") == 0, f"No replacement values were found in the {what}"))
