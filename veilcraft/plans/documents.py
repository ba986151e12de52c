"""Replacement over documents and page spans."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from veilcraft.operators.gates import require
from veilcraft.operators.overlay import find_hits, overlay_styles
from veilcraft.operators.paragraphs import document_totals, replace_paragraphs
from veilcraft.session import materialize
from veilcraft.sources import packages

# fixed value
UNREADABLE_XML = "DOCX document XML could not be read"


@dataclass(frozen=True)
class Documents:
    """Tables of a corpus of documents: ``files`` (doc) lists those that could be read, ``errors`` (doc, error) the others."""

    files: DataFrame
    paragraphs: DataFrame
    errors: DataFrame


def load_documents(parts: DataFrame, strict: bool = True) -> Documents:
    """Tables of the packages in ``parts`` (read with ``kind="docx"``).

    Any fault of a file rejects the whole file: an error if ``strict``, else it is listed in ``errors`` and in no other table.
    """
    parts = materialize(parts, "document-parts")
    found = materialize(packages.paragraphs(parts), "document-paragraphs")
    faults = parts.where("error IS NOT NULL").select(F.col("file_path").alias("doc"), F.lit(0).alias("rank"), "error")
    faults = faults.unionByName(found.where("error IS NOT NULL").select("doc", F.lit(1).alias("rank"), F.lit(UNREADABLE_XML).alias("error")))
    errors = materialize(faults.groupBy("doc").agg(F.min(F.struct("rank", "error"))["error"].alias("error")), "document-errors")
    if strict:
        require(errors)
    files = parts.select(F.col("file_path").alias("doc")).distinct().join(errors, "doc", "left_anti")
    return Documents(files, found.drop("error").join(errors, "doc", "left_anti"), errors)


def replace_documents(
    paragraphs: DataFrame, rules: Iterable[tuple[str, str]], files: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Updated paragraphs, and totals per document with the error of those without a match; ``files`` lists all documents."""
    updated = replace_paragraphs(paragraphs, rules)
    return updated, document_totals(updated, files=files)


def plan_overlays(
    spans: DataFrame, rules: Iterable[tuple[str, str]], files: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """What to draw over every hit, and totals per document; ``files`` (doc) lists the documents, spans or not."""
    found = find_hits(spans, rules)
    hits = found.withColumn(
        "hit_id", F.concat_ws(":", "line", "rule_id", "hit_no", "part")
    ).withColumnRenamed("span_id", "found_in")
    counted = found.where("part = 0").groupBy("doc").agg(F.count(F.lit(1)).alias("replacements"))
    return overlay_styles(hits, spans), document_totals(counted, "PDF", spans if files is None else files)
