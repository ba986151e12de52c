"""Operators over a table of spreadsheet cells.

``cells``: file_path, sheet_index, sheet_name, row, col, ordinal, cell_type,
ss_index, value, formula. A cell of type ``s`` takes its value from the
shared-string dictionary of its file. ``ordinal`` is the cell's position in its
sheet; the last of two cells with one reference wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veilcraft.functions import text as tx
from veilcraft.functions.cipher import TokenCipher
from veilcraft.functions.replace import replaced
from veilcraft.operators.joins import fits_broadcast, lookup_join

CELLS_SCHEMA = (
    "file_path string, sheet_index int, sheet_name string, row bigint, col string, ordinal bigint, "
    "cell_type string, ss_index bigint, value string, formula string"
)
# fixed value
BAD_INDEX = "Invalid shared-string index in cell"


def decode_cells(cells: DataFrame, shared_strings: DataFrame, strict: bool = True) -> DataFrame:
    """Fill in dictionary-typed values. A dangling index is an error, or a row error if not ``strict``."""
    lookup = shared_strings.select("file_path", "ss_index", F.col("value").alias("_shared"))
    joined = lookup_join(cells, lookup, ["file_path", "ss_index"])
    shared = F.col("cell_type") == "s"
    dangling = F.coalesce(shared & F.col("ss_index").isNotNull() & F.col("_shared").isNull(), F.lit(False))
    message = F.concat(F.lit(f"{BAD_INDEX} "), F.col("col"), F.col("row").cast("string"))
    value = F.when(shared, F.coalesce("_shared", F.lit(""))).otherwise(F.col("value"))
    if strict:
        value = F.when(dangling, F.raise_error(message).cast("string")).otherwise(value)
        return joined.select(*_but(cells, "value"), value.alias("value"))
    return joined.select(
        *_but(cells, "value"), value.alias("value"), F.when(dangling, message).alias("error")
    )


def _but(df: DataFrame, *names: str) -> list[str]:
    return [name for name in df.columns if name not in names]


def _plain_keys(keys: Iterable[str]) -> list[str]:
    """Well-formed keys without leading zeros."""
    matches = [re.match(r"(\d+)\|([A-Z]+)$", key) for key in keys]
    return sorted({f"{int(m[1])}|{m[2]}" for m in matches if m})


def requested_keys(spark: SparkSession, keys: Iterable[str]) -> DataFrame:
    """Column keys of one request as a table; malformed keys are dropped."""
    listed = F.array(*[F.lit(key) for key in dict.fromkeys(keys)])
    table = spark.range(0, 1, 1, 1).select(F.explode(listed).alias("key"))
    parts = tx.column_key_parts(F.col("key"))
    return table.select(parts.alias("p")).where("p IS NOT NULL").select("p.*").distinct()


def select_columns(descriptors: DataFrame, requested: DataFrame | Iterable[str] | None) -> DataFrame:
    """Discovered columns that were asked for; all of them when nothing is asked.

    One request lists its keys. A table of requests (see :func:`requested_keys`) may
    also name the file.
    """
    if requested is None:
        return descriptors
    if not isinstance(requested, DataFrame):
        return descriptors.where(F.col("key").isin(_plain_keys(requested)))
    keys = [k for k in ("file_path", "sheet_index", "col") if k in requested.columns]
    wanted = requested.select(*keys).distinct()
    if fits_broadcast(wanted):
        wanted = F.broadcast(wanted)
    return descriptors.join(wanted, keys, "left_semi")


def data_rows(cells: DataFrame, selected: DataFrame, small: bool | None = None) -> DataFrame:
    """Every cell with ``namespace`` set where it is a value to encrypt, else NULL."""
    lookup = selected.select(
        "file_path", "sheet_index", "col", "header", "start_row",
        *(["state"] if "state" in selected.columns else []),
        tx.namespace_slug(F.col("header"), F.col("col")).alias("_slug"),
    )
    joined = lookup_join(cells, lookup, ["file_path", "sheet_index", "col"], small)
    wanted = (
        (F.col("row") >= F.col("start_row")) & ~tx.is_blank(F.col("value")) & ~tx.is_skip_value(F.col("value"))
    )
    return joined.withColumn("namespace", F.when(wanted, F.col("_slug"))).drop("_slug", "start_row")


def _written_type(formula: Column) -> Column:
    """A changed value on a formula cell is cached text; otherwise an inline string."""
    return F.when(formula.isNotNull(), "str").otherwise("inlineStr")


def encrypt_cells(
    cells: DataFrame, selected: DataFrame, cipher: TokenCipher, small: bool | None = None
) -> DataFrame:
    """Encrypt the data rows of the selected columns of decoded cells.

    Adds ``namespace`` (NULL on cells left alone) and ``header`` for the audit.
    The cipher state is computed once per column, not per cell.
    """
    slug = tx.namespace_slug(F.col("header"), F.col("col"))
    with_state = selected.withColumn("_slug", slug).withColumn("state", cipher.state("_slug"))
    marked = data_rows(cells, with_state, small)
    touched = F.col("namespace").isNotNull()
    token = cipher.encrypt_by("namespace", "value", "state")
    return marked.select(
        *_but(cells, "cell_type", "ss_index", "value"),
        F.when(touched, _written_type(F.col("formula"))).otherwise(F.col("cell_type")).alias("cell_type"),
        F.when(~touched, F.col("ss_index")).alias("ss_index"),
        F.when(touched, token).otherwise(F.col("value")).alias("value"),
        "namespace",
        F.when(touched, F.col("header")).alias("header"),
    )


def restored_type(value: Column) -> Column:
    """Type of a restored value: number-like text becomes a number cell, its text kept."""
    return F.when(tx.looks_float(value), "n").otherwise("inlineStr")


def decrypt_cells(cells: DataFrame, cipher: TokenCipher, strict: bool = True, state: str | None = None) -> DataFrame:
    """Restore every token outside the dictionary. ``namespace`` tells which cells held one.

    ``state`` is a column with the state of the cell's namespace (see :mod:`veilcraft.operators.states`).

    With ``strict=False`` a token that fails keeps its text and gets ``failed`` = true.
    """
    direct = F.coalesce(F.col("cell_type") != "s", F.lit(True))
    held = direct & tx.is_token(F.col("value"))
    text = cipher.decrypt("value", state) if strict else cipher.try_decrypt("value", state)
    opened = cells.withColumn("_plain", F.when(held, text))
    restored = F.col("_plain").isNotNull()
    retyped = F.when(F.col("formula").isNotNull(), "str").otherwise(restored_type(F.col("_plain")))
    return opened.select(
        *_but(cells, "cell_type", "value"),
        F.when(restored, retyped).otherwise(F.col("cell_type")).alias("cell_type"),
        F.coalesce("_plain", "value").alias("value"),
        F.when(held, tx.token_parts(F.col("value"))["namespace"]).alias("namespace"),
        *([] if strict else [(held & ~restored).alias("failed")]),
    )


def replace_cells(cells: DataFrame, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """Apply rules to formulas, and to values outside the dictionary; adds ``replacements``."""
    rules = list(rules)
    direct = F.coalesce(F.col("cell_type") != "s", F.lit(True))
    value = F.when(direct, F.col("value"))
    done = cells.withColumn("_f", replaced(F.col("formula"), rules)).withColumn("_v", replaced(value, rules))
    changed = F.col("_v.n") > 0
    return done.select(
        *_but(cells, "cell_type", "value", "formula"),
        F.when(changed, _written_type(F.col("formula"))).otherwise(F.col("cell_type")).alias("cell_type"),
        F.when(changed, F.col("_v.text")).otherwise(F.col("value")).alias("value"),
        F.col("_f.text").alias("formula"),
        (F.col("_f.n") + F.col("_v.n")).alias("replacements"),
    )
