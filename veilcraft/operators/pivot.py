"""Operators over pivot caches.

``fields``: file_path, cache, field_index, name and the shared-item flags;
``items``: file_path, cache, field_index, item_index, tag, v;
``records``: file_path, cache, row, field_index, tag, v, where tag ``x`` refers
to an item and every other tag carries its value inline.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from veilcraft.functions import text as tx
from veilcraft.functions.cipher import TokenCipher
from veilcraft.functions.replace import replaced
from veilcraft.operators.joins import lookup_join

FIELD = ["file_path", "cache", "field_index"]
# fixed values: flags that describe numbers, dropped once a field holds tokens
NUMBER_FLAGS = [
    "contains_number",
    "contains_integer",
    "contains_mixed_types",
    "contains_semi_mixed_types",
    "min_value",
    "max_value",
]


def header_namespaces(selected: DataFrame) -> DataFrame:
    """Namespace per normalised header. The last column wins when two headers agree."""
    slug = tx.namespace_slug(F.col("header"), F.col("col"))
    last = F.struct(F.col("sheet_index"), tx.column_order(F.col("col")))
    return (
        selected.withColumn("label", tx.normalize_label(F.col("header")))
        .groupBy("file_path", "label")
        .agg(F.max_by(slug, last).alias("namespace"))
    )


def match_fields(fields: DataFrame, selected: DataFrame) -> DataFrame:
    """Pivot fields whose normalised name is a selected header, with their namespace."""
    named = fields.withColumn("label", tx.normalize_label(F.coalesce("name", F.lit(""))))
    return named.join(header_namespaces(selected), ["file_path", "label"]).drop("label")


def flag_encrypted_fields(fields: DataFrame, matched: DataFrame) -> DataFrame:
    """Fields of the matched list hold text from now on: number flags go, the text flag comes."""
    marked = lookup_join(fields, matched.select(*FIELD, F.lit(True).alias("_hit")), FIELD)
    hit = F.col("_hit").isNotNull()
    flags = [f for f in ("contains_string", *NUMBER_FLAGS) if f in fields.columns]
    changed = [
        F.when(hit, F.lit("1") if f == "contains_string" else F.lit(None)).otherwise(F.col(f)).alias(f)
        for f in flags
    ]
    return marked.select(*[c for c in fields.columns if c not in flags], *changed)


def _encrypt(values: DataFrame, matched: DataFrame, cipher: TokenCipher) -> DataFrame:
    lookup = matched.select(*FIELD, F.col("namespace").alias("_ns")).withColumn(
        "state", cipher.state("_ns")
    )
    joined = lookup_join(values, lookup, FIELD)
    wanted = (
        F.col("_ns").isNotNull()
        & (F.col("tag") != "x")
        & ~tx.is_blank(F.col("v"))
        & ~tx.is_skip_value(F.col("v"))
    )
    token = cipher.encrypt_by("_ns", "v", "state")
    return joined.select(
        *[c for c in values.columns if c not in ("tag", "v")],
        F.when(wanted, "s").otherwise(F.col("tag")).alias("tag"),
        F.when(wanted, token).otherwise(F.col("v")).alias("v"),
        F.when(wanted, F.col("_ns")).alias("namespace"),
    )


def encrypt_items(items: DataFrame, matched: DataFrame, cipher: TokenCipher) -> DataFrame:
    """Encrypt the shared items of matched fields; an encrypted item becomes a string item."""
    return _encrypt(items, matched, cipher)


def encrypt_records(records: DataFrame, matched: DataFrame, cipher: TokenCipher) -> DataFrame:
    """Encrypt inline record values of matched fields; references to items stay."""
    return _encrypt(records, matched, cipher)


def decrypt_values(values: DataFrame, cipher: TokenCipher, strict: bool = True, state: str | None = None) -> DataFrame:
    """Restore any token in ``v``. The tag stays: pivot values do not turn back into numbers."""
    held = tx.is_token(F.col("v"))
    text = cipher.decrypt("v", state) if strict else cipher.try_decrypt("v", state)
    opened = values.withColumn("_plain", F.when(held, text))
    return opened.select(
        *[c for c in values.columns if c != "v"],
        F.coalesce("_plain", "v").alias("v"),
        F.when(held, tx.token_parts(F.col("v"))["namespace"]).alias("namespace"),
        *([] if strict else [(held & F.col("_plain").isNull()).alias("failed")]),
    )


def replace_values(values: DataFrame, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """Apply rules to ``v``; adds ``replacements``."""
    done = values.withColumn("_r", replaced(F.col("v"), rules))
    return done.withColumn("v", F.col("_r.text")).withColumn("replacements", F.col("_r.n")).drop("_r")
