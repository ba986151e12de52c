"""Checks of the JSON a client sends: column selections and replacement rules."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

from veilcraft.functions.text import column_key_parts, py_strip

# --- fixed values -----------------------------------------------------------
MAX_RULES = 100
MAX_RULE_CHARS = 500
SELECT_ONE = "Select at least one column to encrypt"
BAD_SELECTION = "Selected columns could not be read"
RULE_REQUIRED = "At least one replacement rule is required"
BAD_RULES = "Find and replace rules could not be read"
BAD_RULE = "Each replacement needs a sensitive value and a safe label"
BAD_CLIENT_RULE = "Each replacement row needs both a sensitive value and a safe label."
# ----------------------------------------------------------------------------

_RULES_TYPE = "array<struct<find:string,replace:string>>"


def last_key_wins(spark: SparkSession) -> None:
    """Let the session read JSON objects that repeat a key: the last one counts."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def _variant_array(raw: Column) -> Column:
    """The JSON array's elements as VARIANTs; NULL for malformed text or another shape.

    Of repeated keys the last counts. Spark decides that by a setting that it reads when the query runs, so the
    session keeps it.
    """
    last_key_wins(SparkSession.active())
    return F.try_variant_get(F.try_parse_json(raw), "$", "array<variant>")


def _is_text(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def parse_selected_columns(raw: Column, mode: Column) -> Column:
    """``struct(keys, error)``: distinct column keys, or the message that rejects them."""
    items = _variant_array(raw)
    texts = F.transform(items, lambda v: F.try_variant_get(v, "$", "string"))
    sound = F.forall(items, _is_text) & F.forall(texts, lambda t: column_key_parts(t).isNotNull())
    error = (
        F.when(F.coalesce(raw, F.lit("")) == "", SELECT_ONE)
        .when(items.isNull() | ~sound, BAD_SELECTION)
        .when(F.size(items) == 0, SELECT_ONE)
    )
    keys = F.when(error.isNull(), F.array_sort(F.array_distinct(texts)))
    encrypting = F.coalesce(mode == "encrypt", F.lit(False))
    return F.struct(
        F.when(encrypting, keys).alias("keys"), F.when(encrypting, error).alias("error")
    )


def parse_replacement_rules(raw: Column, mode: Column, allow_empty_replacement: bool = True) -> Column:
    """``struct(rules, error)``. A missing side counts as empty text.

    ``allow_empty_replacement=False`` is the browser's stricter check.
    """
    items = _variant_array(raw)

    def side(item: Column, name: str) -> Column:
        field = F.try_variant_get(item, f"$.{name}", "variant")
        return F.when(field.isNull(), F.lit("")).when(
            _is_text(field), F.try_variant_get(field, "$", "string")
        )

    sides = F.transform(
        items,
        lambda item: F.struct(
            F.schema_of_variant(item).startswith("OBJECT").alias("is_object"),
            side(item, "find").alias("raw_find"),
            side(item, "replace").alias("raw_replace"),
        ),
    )
    stripped = F.transform(
        sides,
        lambda s: F.struct(
            py_strip(s["raw_find"]).alias("find"), py_strip(s["raw_replace"]).alias("replace")
        ),
    )
    filled = F.filter(stripped, lambda r: (r["find"] != "") | (r["replace"] != ""))
    kept = F.filter(filled, lambda r: r["find"] != r["replace"])
    absent = F.coalesce(raw, F.lit("")) == ""

    def unreadable(s: Column) -> Column:
        return ~(s["is_object"] & s["raw_find"].isNotNull() & s["raw_replace"].isNotNull())

    def lacking(r: Column) -> Column:
        one_sided = (r["find"] == "") | ((r["replace"] == "") & F.lit(not allow_empty_replacement))
        too_long = (F.length(r["find"]) > MAX_RULE_CHARS) | (F.length(r["replace"]) > MAX_RULE_CHARS)
        blank = (r["find"] == "") & (r["replace"] == "")
        return F.coalesce(~blank & (one_sided | too_long), F.lit(False))

    first_unreadable = F.array_position(F.transform(sides, unreadable), True)
    first_lacking = F.array_position(F.transform(stripped, lacking), True)
    # Items are checked in order, so the first faulty one names the error.
    faulty = F.when(
        (first_unreadable > 0) & ((first_lacking == 0) | (first_unreadable < first_lacking)), BAD_RULES
    ).when(first_lacking > 0, BAD_RULE if allow_empty_replacement else BAD_CLIENT_RULE)
    error = (
        F.when(absent, F.when(mode == "replace", RULE_REQUIRED))
        .when(items.isNull() | (F.size(items) > MAX_RULES), BAD_RULES)
        .when(faulty.isNotNull(), faulty)
        .when((mode == "replace") & (F.size(kept) == 0), RULE_REQUIRED)
    )
    none = F.array().cast(_RULES_TYPE)
    rules = F.when(error.isNull(), F.when(absent, none).otherwise(kept))
    active = F.coalesce(mode.isin("encrypt", "replace"), F.lit(False))
    return F.struct(
        F.when(active, rules).otherwise(none).alias("rules"), F.when(active, error).alias("error")
    )
