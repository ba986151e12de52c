"""The same capabilities for ordinary tables, where column names are the headers."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from veilcraft.functions import text as tx
from veilcraft.functions.cipher import TokenCipher
from veilcraft.functions.replace import replaced
from veilcraft.operators.joins import lookup_join


def column_namespaces(df: DataFrame, columns: Iterable[str]) -> dict[str, str]:
    """Namespace of each column, from its name (a constant expression, no job)."""
    names = list(columns)
    row = df.sparkSession.sql("SELECT 1").select(
        *[tx.namespace_slug(F.lit(c), F.lit(c)).alias(f"n{i}") for i, c in enumerate(names)]
    ).first()
    return dict(zip(names, row, strict=True))


def _sealed(column: str, namespace: str, cipher: TokenCipher) -> Column:
    text = F.col(f"`{column}`")
    return F.when(tx.is_skip_value(text), text).otherwise(cipher.encrypt(namespace, f"`{column}`"))


def encrypt_columns(
    df: DataFrame,
    columns: Sequence[str],
    cipher: TokenCipher,
    namespaces: Mapping[str, str] | None = None,
    repeated: Sequence[str] = (),
) -> DataFrame:
    """Replace string columns by tokens; no shuffle.

    Columns named in ``repeated`` hold few distinct values: each value is
    encrypted once and joined back. A stream encrypts them row by row.
    """
    repeated = () if df.isStreaming else repeated
    spaces = {**column_namespaces(df, columns), **(namespaces or {})}
    direct = {c: _sealed(c, spaces[c], cipher) for c in columns if c not in repeated}
    result = df.withColumns(direct) if direct else df
    for c in repeated:
        values = df.select(F.col(f"`{c}`").alias("_value")).where("_value <> ''").distinct()
        tokens = values.withColumn("_token", _sealed("_value", spaces[c], cipher))
        joined = lookup_join(result.withColumnRenamed(c, "_value"), tokens, ["_value"])
        result = joined.withColumn(c, F.coalesce("_token", "_value")).select(*df.columns)
    return result


def decrypt_columns(
    df: DataFrame, columns: Sequence[str], cipher: TokenCipher, strict: bool = True
) -> DataFrame:
    """Restore tokens; other text stays. Without ``strict`` a token that fails becomes NULL."""
    opened = cipher.decrypt if strict else cipher.try_decrypt
    return df.withColumns({c: opened(f"`{c}`") for c in columns})


def replace_in_columns(
    df: DataFrame, columns: Sequence[str], rules: Iterable[tuple[str, str]], count: str = "replacements"
) -> DataFrame:
    """Apply rules to string columns; adds the number of matches in the row."""
    rules = list(rules)
    done = df.withColumns({f"_r_{c}": replaced(F.col(f"`{c}`"), rules) for c in columns})
    total = sum((F.col(f"`_r_{c}`.n") for c in columns), F.lit(0).cast("bigint"))
    return (
        done.withColumn(count, total)
        .withColumns({c: F.col(f"`_r_{c}`.text") for c in columns})
        .drop(*[f"_r_{c}" for c in columns])
    )


def repeated_columns(df: DataFrame, columns: Sequence[str], share: float = 0.05) -> list[str]:
    """Columns whose distinct values are at most ``share`` of the rows, by an approximate count."""
    row = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.approx_count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(columns)],
    ).first()
    return [c for i, c in enumerate(columns) if row[f"d{i}"] <= share * row["_rows"]]
