"""Whole-workbook runs over the tables of a corpus: encrypt, decrypt, replace."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace as with_fields
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from veilcraft.functions import text as tx
from veilcraft.functions.cipher import ENCRYPTED_INPUT, TokenCipher
from veilcraft.operators import audit, cells as cell_ops, dictionary, pivot
from veilcraft.operators.discover import describe_sheets, discover_columns
from veilcraft.operators.gates import require, require_changes
from veilcraft.operators.joins import fits_broadcast
from veilcraft.operators.states import NAMESPACE, STATE, with_states
from veilcraft.session import materialize, materialize_all
from veilcraft.sources import packages

# Namespaces found in tokens become literals of the plan up to this many.
KNOWN_NAMESPACES = 64


@dataclass(frozen=True)
class Workbooks:
    """Tables of a corpus of workbooks. ``cells`` are raw: dictionary cells hold an index."""

    cells: DataFrame
    shared_strings: DataFrame | None = None
    pivot_fields: DataFrame | None = None
    pivot_items: DataFrame | None = None
    pivot_records: DataFrame | None = None
    errors: DataFrame | None = None
    pivot_other: DataFrame | None = None


def load_workbooks(parts: DataFrame, strict: bool = True) -> Workbooks:
    """Tables of the packages in ``parts`` (see :mod:`veilcraft.sources.packages`).

    Files are unzipped and their XML is parsed once, into tables in the shared
    folder. Any fault of a file rejects the whole file: an error if ``strict``,
    else it is left out of all tables and listed in ``errors``.
    """
    parts = materialize(parts, "parts")
    sheets = materialize(packages.workbook_sheets(parts), "sheets")
    parsed = {"sheets": sheets} | materialize_all(
        cells=packages.cells(parts, sheets),
        strings=packages.shared_strings(parts),
        fields=packages.pivot_fields(parts),
        records=packages.pivot_records(parts),
        other=packages.pivot_other(parts),
    )
    found = [
        parts,  # limits, then unreadable members: in the order in which a file is read
        *[parsed[name] for name in ("strings", "sheets", "cells", "fields", "records", "other")],
    ]
    ranked = [
        df.where("error IS NOT NULL").select("file_path", F.lit(i).alias("rank"), "error")
        for i, df in enumerate(found)
    ]
    errors = materialize(
        reduce(DataFrame.unionByName, ranked)
        .groupBy("file_path")
        .agg(F.min(F.struct("rank", "error"))["error"].alias("error")),
        "errors",
    )
    if strict:
        require(errors)
    else:
        faulty = errors.select("file_path")
        faulty = F.broadcast(faulty) if fits_broadcast(faulty) else faulty
        parsed = {name: df.join(faulty, "file_path", "left_anti") for name, df in parsed.items()}
    return Workbooks(
        parsed["cells"].drop("error"),
        parsed["strings"].drop("error"),
        parsed["fields"].drop("items", "error"),
        packages.pivot_items(parsed["fields"]),
        parsed["records"].drop("error"),
        errors,
        parsed["other"].drop("error"),
    )


def decoded(book: Workbooks) -> DataFrame:
    if book.shared_strings is None:
        return book.cells
    return cell_ops.decode_cells(book.cells, book.shared_strings)


def peek(book: Workbooks) -> DataFrame:
    """Columns per sheet, as a client would choose from."""
    return describe_sheets(discover_columns(decoded(book)))


def replace_values(book: Workbooks, rules: Iterable[tuple[str, str]]) -> tuple[Workbooks, list[DataFrame]]:
    """Apply rules to every layout. Also returns the layouts with their ``replacements`` column."""
    rules = list(rules)
    if not rules:
        raise ValueError("At least one replacement rule is required")
    done = {"cells": cell_ops.replace_cells(book.cells, rules)}
    if book.shared_strings is not None:
        done["shared_strings"] = dictionary.replace_dictionary(book.shared_strings, rules)
    for name in ("pivot_items", "pivot_records", "pivot_other"):
        if getattr(book, name) is not None:
            done[name] = pivot.replace_values(getattr(book, name), rules)
    updated = with_fields(book, **{name: df.drop("replacements") for name, df in done.items()})
    return updated, list(done.values())


@dataclass(frozen=True)
class ScrubResult:
    book: Workbooks
    counts: DataFrame
    columns: DataFrame | None
    replacements: DataFrame | None

    def require_changes(self, mode: str) -> None:
        """The gate on an empty result, to run before the output is published."""
        if mode == "replace":
            total = self.replacements.first()["replacements"]
        else:
            total = audit.total_values(self.counts).first()["total"]
        require_changes(total, mode)


def scrub(
    book: Workbooks,
    cipher: TokenCipher,
    columns: DataFrame | Iterable[str] | None = None,
    rules: Iterable[tuple[str, str]] = (),
    strict: bool = True,
) -> ScrubResult:
    """Replace, discover, select, encrypt and rebuild the dictionaries.

    Rules run before discovery, so they may change headers. ``columns`` lists the
    requested keys, or is a table of them (sheet_index, col and optionally file_path);
    None takes all.
    Replaced and decoded cells are written once to the shared folder, and discovery, counts, references and tokens
    read the columns they need from there. Counts need no cipher, so auditing does not encrypt.

    A file that holds a token already or a reference outside its dictionary stops the run if ``strict``; else
    it is left out of every table and listed in the result's ``book.errors``, and the others are scrubbed.
    """
    rules = list(rules)
    replaced: DataFrame | None = None
    if rules:
        book, layouts = replace_values(book, rules)
        replaced = audit.replacement_total(*layouts)
    if not strict:
        book = without_faulty(book, columns)
    plain = decoded(book)
    if rules or book.shared_strings is not None:
        plain = materialize(plain, "plain-cells")
    selected = materialize(
        cell_ops.select_columns(discover_columns(plain), columns), "descriptors"
    )
    sealed = cell_ops.encrypt_cells(plain, selected, cipher, fits_broadcast(selected))
    result = with_fields(book, cells=sealed)
    marked_items = marked_records = None
    if book.pivot_fields is not None:
        matched = pivot.match_fields(book.pivot_fields, selected)
        marked_items = pivot.encrypt_items(book.pivot_items, matched, cipher)
        marked_records = pivot.encrypt_records(book.pivot_records, matched, cipher)
        result = with_fields(
            result,
            pivot_fields=pivot.flag_encrypted_fields(book.pivot_fields, matched),
            pivot_items=marked_items.drop("namespace"),
            pivot_records=marked_records.drop("namespace"),
        )
    counts = audit.namespace_counts(sealed, marked_items, marked_records)
    listed = audit.encrypted_columns(sealed)
    kept = sealed.drop("namespace", "header")
    if book.shared_strings is not None:
        rebuilt = materialize(dictionary.rebuild_dictionary(kept, book.shared_strings), "rebuilt-dictionary")
        result = with_fields(
            result,
            cells=dictionary.remap_cells(kept, rebuilt),
            shared_strings=rebuilt.drop("old_index", "uses"),
        )
    else:
        result = with_fields(result, cells=kept)
    return ScrubResult(result, counts, listed, replaced)


def without_faulty(book: Workbooks, columns: DataFrame | Iterable[str] | None) -> Workbooks:
    """The books that can be encrypted; the others are added to ``errors`` with the first reason. Nothing is encrypted here."""
    found, cells = [], book.cells
    if book.shared_strings is not None:
        read = cell_ops.decode_cells(book.cells, book.shared_strings, strict=False)
        found.append(read.where("error IS NOT NULL").select("file_path", F.lit(0).alias("rank"), "error"))
        cells = read.drop("error")
    selected = materialize(cell_ops.select_columns(discover_columns(cells), columns), "descriptors")
    held = cell_ops.data_rows(cells, selected).where("namespace IS NOT NULL").where(tx.is_token(F.col("value")))
    refused = [held.select("file_path")]
    if book.pivot_fields is not None:
        matched = pivot.match_fields(book.pivot_fields, selected).select(*pivot.FIELD)
        for values in (book.pivot_items, book.pivot_records):
            refused.append(values.where(F.col("tag") != "x").where(tx.is_token(F.col("v"))).join(matched, pivot.FIELD, "left_semi").select("file_path"))
    found += [df.select("file_path", F.lit(1).alias("rank"), F.lit(ENCRYPTED_INPUT).alias("error")) for df in refused]
    faults = reduce(DataFrame.unionByName, found).groupBy("file_path").agg(F.min(F.struct("rank", "error"))["error"].alias("error"))
    faults = materialize(faults, "faulty-books")
    kept = {
        name: getattr(book, name).join(faults, "file_path", "left_anti")
        for name in ("cells", "shared_strings", "pivot_fields", "pivot_items", "pivot_records", "pivot_other")
        if getattr(book, name) is not None
    }
    return with_fields(book, **kept, errors=faults if book.errors is None else book.errors.select("file_path", "error").unionByName(faults))


def token_namespaces(values: DataFrame, column: str, limit: int = KNOWN_NAMESPACES) -> list[str]:
    """Namespaces of the tokens in a stored column, or none when there are more than ``limit``.

    Give them to :class:`TokenCipher` before decrypting: states of known namespaces
    are literals, others are computed token by token.
    """
    found = (
        values.where(tx.is_token(F.col(column)))
        .select(tx.token_parts(F.col(column))["namespace"].alias("namespace"))
        .distinct()
        .limit(limit + 1)
        .collect()
    )
    return [row["namespace"] for row in found] if len(found) <= limit else []


def unscrub(book: Workbooks, cipher: TokenCipher, strict: bool = True) -> ScrubResult:
    """Decrypt dictionary runs, cells and pivot values. Replacements are not undone.

    With ``strict=False`` tokens that fail stay as they are and are flagged ``failed``.
    Unless the cipher was told its namespaces, they are found first, and the state of each is computed once and joined in.
    """

    def prepared(values: DataFrame, text: str) -> tuple[DataFrame, str | None]:
        if cipher.knows_namespaces:
            return values, None
        return with_states(values, tx.token_parts(F.expr(text))["namespace"], cipher), STATE

    stored, state = prepared(book.cells, "CASE WHEN coalesce(cell_type <> 's', true) THEN value END")
    cells = cell_ops.decrypt_cells(stored, cipher, strict, state).drop(NAMESPACE, STATE)
    result = with_fields(book, cells=cells.drop("namespace"))
    sources: list[DataFrame | None] = [cells, None, None, None]
    if book.shared_strings is not None:
        first_token = f"try_element_at(filter(runs, run -> rlike(run, r'{tx.TOKEN_PATTERN}')), 1)"
        stored, state = prepared(book.shared_strings, first_token)
        opened = dictionary.decrypt_dictionary(stored, cipher, strict, state and NAMESPACE, state).drop(NAMESPACE, STATE)
        result = with_fields(result, shared_strings=opened.drop("namespaces"))
        runs = opened.select(F.explode("namespaces").alias("namespace"))
        sources[0] = cells.select("namespace").unionByName(runs)
    for i, name in enumerate(("pivot_items", "pivot_records", "pivot_other"), start=1):
        values = getattr(book, name)
        if values is not None:
            stored, state = prepared(values, "v")
            sources[i] = pivot.decrypt_values(stored, cipher, strict, state).drop(NAMESPACE, STATE)
            result = with_fields(result, **{name: sources[i].drop("namespace")})
    records, other = sources[2:]
    if other is not None:
        sources[2] = other.select("namespace") if records is None else records.select("namespace").unionByName(other.select("namespace"))
    counts = audit.namespace_counts(*sources[:3], mode="decrypt")
    return ScrubResult(result, counts, None, None)


def replace_only(book: Workbooks, rules: Iterable[tuple[str, str]]) -> ScrubResult:
    """Rules alone; needs no key and leaves the dictionaries' order as it is."""
    updated, layouts = replace_values(book, rules)
    total = audit.replacement_total(*layouts)
    empty = audit.namespace_counts(updated.cells.withColumn("namespace", F.lit(None).cast("string")))
    return ScrubResult(updated, empty, None, total)
