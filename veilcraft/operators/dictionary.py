"""Operators over shared-string dictionaries.

``shared_strings``: file_path, ss_index, runs, value; ``value`` is the joined runs.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window, functions as F

from veilcraft.functions import text as tx
from veilcraft.functions.cipher import TokenCipher
from veilcraft.functions.replace import replaced_by, rules_literal
from veilcraft.operators.joins import lookup_join
from veilcraft.session import materialize

# fixed value
OUT_OF_RANGE = "Shared-string cell index is out of range"
# Entries ranked by one task; offsets of the ranges come from their counts.
RANGE_ENTRIES = 1 << 16


def with_value(shared_strings: DataFrame) -> DataFrame:
    return shared_strings.withColumn("value", F.array_join("runs", ""))


def replace_dictionary(shared_strings: DataFrame, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """Apply rules to every run; ``replacements`` counts once per entry, however often it is used."""
    table = rules_literal(rules)
    done = shared_strings.withColumn("_r", F.transform("runs", lambda run: replaced_by(run, table)))
    return (
        done.withColumn("runs", F.transform("_r", lambda r: r["text"]))
        .withColumn("value", F.array_join("runs", ""))
        .withColumn("replacements", F.aggregate("_r", F.lit(0).cast("bigint"), lambda n, r: n + r["n"]))
        .drop("_r")
    )


def decrypt_dictionary(
    shared_strings: DataFrame, cipher: TokenCipher, strict: bool = True, namespace: str | None = None, state: str | None = None
) -> DataFrame:
    """Restore every run that is a token; ``namespaces`` lists their namespaces.

    ``state`` is a column with the state of a ``namespace`` of the entry; runs of other namespaces compute theirs.

    With ``strict=False`` a run that fails keeps its text and is counted in ``failed``.
    """
    opened = cipher.decrypt_each("runs", strict, namespace, state)
    kept = F.zip_with(opened, F.col("runs"), lambda new, old: F.coalesce(new, old))
    held = F.transform("runs", lambda run: tx.token_parts(run)["namespace"])
    names = F.filter(held, lambda name: name.isNotNull())
    result = shared_strings.withColumn("namespaces", names)
    if not strict:
        lost = F.zip_with(opened, F.col("runs"), lambda new, old: new.isNull() & old.isNotNull())
        result = result.withColumn("failed", F.size(F.filter(lost, lambda x: x)).cast("bigint"))
    return result.withColumn("runs", kept).withColumn("value", F.array_join("runs", ""))


def dangling_references(cells: DataFrame, shared_strings: DataFrame) -> DataFrame:
    """Distinct (file_path, ss_index) that cells refer to and the dictionary lacks."""
    return _references(cells).join(
        shared_strings.select("file_path", "ss_index"), ["file_path", "ss_index"], "left_anti"
    ).select("file_path", "ss_index", F.lit(OUT_OF_RANGE).alias("error"))


def _references(cells: DataFrame) -> DataFrame:
    used = cells.where((F.col("cell_type") == "s") & F.col("ss_index").isNotNull())
    return used.groupBy("file_path", "ss_index").agg(F.count(F.lit(1)).alias("uses"))


def rebuild_dictionary(cells: DataFrame, shared_strings: DataFrame) -> DataFrame:
    """Keep referenced entries only and renumber them densely in their old order.

    Returns the new dictionary with ``old_index`` and ``uses``. The references are
    counted once and kept in the shared folder, so the cells are read once. Ranks
    are taken over index and count alone, inside fixed index ranges, and shifted by
    the entries of earlier ranges: a huge dictionary is not ranked by a single task.
    """
    keys = shared_strings.select("file_path", "ss_index")
    used = materialize(_references(cells).join(keys, ["file_path", "ss_index"]), "references")
    used = used.withColumn("_range", F.expr(f"ss_index DIV {RANGE_ENTRIES}"))
    within = Window.partitionBy("file_path", "_range").orderBy("ss_index")
    earlier = (
        Window.partitionBy("file_path").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        used.groupBy("file_path", "_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("file_path", "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    ranked = (
        used.withColumn("_rank", F.row_number().over(within) - 1)
        .join(offsets, ["file_path", "_range"])
        .select("file_path", "ss_index", (F.col("_offset") + F.col("_rank")).alias("_new"), "uses")
    )
    return shared_strings.join(ranked, ["file_path", "ss_index"]).select(
        "file_path",
        F.col("_new").cast("bigint").alias("ss_index"),
        *[c for c in shared_strings.columns if c not in ("file_path", "ss_index")],
        F.col("ss_index").alias("old_index"),
        "uses",
    )


def remap_cells(cells: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Point dictionary-typed cells at the renumbered entries; a missing entry is an error."""
    lookup = rebuilt.select(
        "file_path", F.col("old_index").alias("ss_index"), F.col("ss_index").alias("_new")
    )
    joined = lookup_join(cells, lookup, ["file_path", "ss_index"])
    shared = F.coalesce(F.col("cell_type") == "s", F.lit(False)) & F.col("ss_index").isNotNull()
    checked = F.coalesce("_new", F.raise_error(F.lit(OUT_OF_RANGE)).cast("bigint"))
    others = [c for c in cells.columns if c != "ss_index"]
    return joined.select(*others, F.when(shared, checked).alias("ss_index"))


def dictionary_counts(rebuilt: DataFrame) -> DataFrame:
    """Per file: references (``count``) and entries (``unique_count``)."""
    return rebuilt.groupBy("file_path").agg(
        F.sum("uses").alias("count"), F.count(F.lit(1)).alias("unique_count")
    )
