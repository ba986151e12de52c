"""Text predicates and normalisers as Spark columns.

NULL and the empty string pass through every function unchanged; predicates
answer False for NULL.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import Column, functions as F

# --- fixed values -----------------------------------------------------------
MAX_NAMESPACE_CHARS = 64
SKIP_VALUES = ["", "(blank)", "grand total", "total"]
COLUMN_KEY_PATTERN = r"^(\p{Nd}+)\|([A-Z]+)\n?\z"
CELL_REFERENCE_PATTERN = r"^([A-Z]+)(\p{Nd}+)\n?\z"
TOKEN_PATTERN = r"^[a-z0-9](?:[a-z0-9-]{0,62}[a-z0-9])?:[A-Za-z0-9_-]{22,}\z"
NAMESPACE_PATTERN = r"^[a-z0-9](?:[a-z0-9-]{0,62}[a-z0-9])?\z"
# ----------------------------------------------------------------------------

# Java's Unicode \s lacks the four ASCII separators that Python strips.
_SPACE = r"[\s\x1c-\x1f]"
_STRIP_PATTERN = rf"(?U)^{_SPACE}+|{_SPACE}+\z"


def _ascii_casefolds() -> dict[str, str]:
    """Characters whose case folding yields ASCII letters but lower() does not."""
    table = {}
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        folded = char.casefold()
        if folded != char.lower() and any("a" <= c <= "z" for c in folded):
            table[char] = folded
    return table


def _char_class(member: Callable[[str], bool]) -> str:
    """Regex class of the characters with a property, in Python's Unicode version (Java's may be older)."""
    codes = [code for code in range(sys.maxunicode + 1) if member(chr(code))]
    starts = [code for code in codes if not member(chr(code - 1))]
    ends = [code for code in codes if not member(chr(code + 1))]
    return "[" + "".join(rf"\x{{{low:x}}}-\x{{{high:x}}}" for low, high in zip(starts, ends)) + "]"


_CASEFOLDS = _ascii_casefolds()
_CASEFOLD_TRIGGER = "[" + "".join(_CASEFOLDS) + "]"
_DIGIT_RUN = _char_class(str.isdigit) + "+"
_DECIMAL = _char_class(str.isdecimal)


def py_strip(text: Column) -> Column:
    """Strip the whitespace Python's ``str.strip`` strips (Spark ``trim`` knows only U+0020)."""
    return F.regexp_replace(text, _STRIP_PATTERN, "")


def casefold(text: Column) -> Column:
    """Case folding, exact for every character that folds to ASCII."""
    special = text
    for char, folded in _CASEFOLDS.items():
        special = F.replace(special, F.lit(char), F.lit(folded))
    return F.lower(F.when(text.rlike(_CASEFOLD_TRIGGER), special).otherwise(text))


def is_blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def normalize_label(text: Column) -> Column:
    return F.btrim(F.regexp_replace(casefold(text), "[^a-z0-9]+", " "))


def namespace_slug(header: Column, column: Column) -> Column:
    """Token namespace of a header; the column letters name an unusable one."""
    fallback = F.concat(F.lit("column-"), F.lower(column))
    dash = F.lit("-")
    slug = F.btrim(F.regexp_replace(casefold(F.coalesce(header, F.lit(""))), "[^a-z0-9]+", "-"), dash)
    named = F.coalesce(F.nullif(slug, F.lit("")), fallback)
    cut = F.btrim(F.left(named, F.lit(MAX_NAMESPACE_CHARS)), dash)
    return F.coalesce(F.nullif(cut, F.lit("")), fallback)


def is_skip_value(text: Column) -> Column:
    """Blank and total labels, which are never encrypted."""
    return F.coalesce(py_strip(casefold(text)).isin(SKIP_VALUES), F.lit(False))


def looks_numeric(text: Column) -> Column:
    """Digits with separators, signs and one accounting-style pair of brackets."""
    stripped = py_strip(text)
    bare = F.regexp_replace(stripped, r"(?s)^\((.*)\)\z", "$1")
    squeezed = F.translate(bare, ",. ", "")
    return F.coalesce(squeezed.rlike(rf"^[+-]*{_DIGIT_RUN}\z"), F.lit(False))


_DIGITS = rf"{_DECIMAL}+(?:_{_DECIMAL}+)*"
_FLOAT = (
    rf"[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
    r"|(?i:inf(?:inity)?|nan))"
)


def looks_float(text: Column) -> Column:
    """Whether Python's ``float`` would accept the text.

    Python trims the ASCII separators here only from text that is not pure ASCII.
    """
    accepted = F.when(
        text.rlike(r"[^\x00-\x7f]"), text.rlike(rf"(?U)^{_SPACE}*{_FLOAT}{_SPACE}*\z")
    ).otherwise(text.rlike(rf"^\s*{_FLOAT}\s*\z"))
    return F.coalesce(accepted, F.lit(False))


def header_score(text: Column) -> Column:
    """One cell's share of its row's header score, without the per-cell point."""
    stripped = py_strip(text)
    wordy = (
        F.when(F.length(stripped) <= 2, -1).otherwise(0)
        + F.when(stripped.rlike("[A-Za-z]{3,}"), 4).otherwise(0)
        + F.when(stripped.contains(" "), 1).otherwise(0)
    )
    return F.when(stripped == "", 0).when(looks_numeric(stripped), -4).otherwise(wordy)


def cell_position(reference: Column) -> Column:
    """``struct(col, row)`` of a reference such as ``AB12``; NULL when it is none."""
    col = F.regexp_extract(reference, CELL_REFERENCE_PATTERN, 1)
    row = F.regexp_extract(reference, CELL_REFERENCE_PATTERN, 2).try_cast("bigint")
    return F.when(
        reference.rlike(CELL_REFERENCE_PATTERN) & row.isNotNull(),
        F.struct(col.alias("col"), row.alias("row")),
    )


def column_key_parts(key: Column) -> Column:
    """``struct(sheet_index, col)`` of a key such as ``0|A``; NULL when it is none."""
    sheet = F.regexp_extract(key, COLUMN_KEY_PATTERN, 1).try_cast("int")
    col = F.regexp_extract(key, COLUMN_KEY_PATTERN, 2)
    return F.when(
        key.rlike(COLUMN_KEY_PATTERN) & sheet.isNotNull(),
        F.struct(sheet.alias("sheet_index"), col.alias("col")),
    )


def column_ordinal(col: Column) -> Column:
    """Base-26 position of column letters (A = 1); NULL beyond 13 letters, where it outgrows 64 bits."""
    letters = F.split(col, "")
    value = F.aggregate(
        letters, F.lit(0).cast("bigint"), lambda total, letter: total * 26 + F.ascii(letter) - 64
    )
    return F.when(F.length(col) <= 13, value)


def column_order(col: Column) -> Column:
    """Sort key with base-26 order for any length: shorter first, then alphabetical."""
    return F.struct(F.length(col).alias("letters"), col.alias("col"))


def b64url_encode(data: Column) -> Column:
    """Unpadded URL-safe Base64; also drops the line breaks Spark's ``base64`` inserts."""
    plain = F.replace(F.rtrim(F.base64(data), F.lit("=")), F.lit("\r\n"), F.lit(""))
    return F.replace(F.replace(plain, F.lit("+"), F.lit("-")), F.lit("/"), F.lit("_"))


def b64url_decode(text: Column) -> Column:
    return F.unbase64(F.replace(F.replace(text, F.lit("-"), F.lit("+")), F.lit("_"), F.lit("/")))


def is_token(text: Column) -> Column:
    """Whether the text has the shape ``namespace:ciphertext`` of an encrypted value."""
    cipher_chars = F.length(text) - F.locate(":", text)
    return F.coalesce(text.rlike(TOKEN_PATTERN) & (cipher_chars % 4 != 1), F.lit(False))


def token_parts(text: Column) -> Column:
    """``struct(namespace, ciphertext)`` of a token; NULL for other text."""
    at = F.locate(":", text)
    return F.when(
        is_token(text),
        F.struct(
            text.substr(F.lit(1), at - 1).alias("namespace"),
            text.substr(at + 1, F.length(text)).alias("ciphertext"),
        ),
    )


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def part_suffix(path: Column) -> Column:
    """Lower-cased extension with its dot; empty when there is none."""
    return casefold(F.regexp_extract(basename(path), r"(?s)^.+(\.[^.]+)\z", 1))


def resolve_target(source_part: Column, target: Column) -> Column:
    """Package path of a relationship target, relative to the part that names it."""
    slashed = F.replace(target, F.lit("\\"), F.lit("/"))
    folder = F.regexp_replace(source_part, "[^/]*$", "")
    segments = F.filter(
        F.split(F.concat(folder, slashed), "/"), lambda s: (s != "") & (s != ".")
    )
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, s: F.when(
            (s == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != ".."),
            F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))),
        ).otherwise(F.concat(done, F.array(s))),
    )
    joined = F.coalesce(F.nullif(F.array_join(kept, "/"), F.lit("")), F.lit("."))
    return F.when(slashed.startswith("/"), F.ltrim(slashed, F.lit("/"))).otherwise(joined)


def relationship_part(source_part: Column) -> Column:
    """Path of the relationship part that belongs to a part."""
    folder = F.regexp_replace(source_part, "[^/]*$", "")
    return F.concat(folder, F.lit("_rels/"), basename(source_part), F.lit(".rels"))
