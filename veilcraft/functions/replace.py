"""Ordered literal find-and-replace with match counts.

Rules run in order on the already updated text: matches are counted left to
right without overlap, then all of them are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, functions as F

# Longer rule lists run as one aggregate over the list, to keep the plan small.
_UNROLLED_RULES = 8


class Rule(NamedTuple):
    find: str
    replace: str


def active_rules(rules: Iterable[tuple[str, str]]) -> list[Rule]:
    return [Rule(*rule) for rule in rules if rule[0]]


def rules_literal(rules: Iterable[tuple[str, str]]) -> Column:
    """The rules as an ``array<struct<find, replace>>`` literal."""
    structs = [
        F.struct(F.lit(find).alias("find"), F.lit(replace).alias("replace"))
        for find, replace in active_rules(rules)
    ]
    return F.array(*structs) if structs else F.array().cast("array<struct<find:string,replace:string>>")


def _matches(before: Column, after: Column, find: Column, grown: Column) -> Column:
    """Number of replacements, from the change of size where the rule changes size."""
    by_growth = F.try_divide(F.octet_length(after) - F.octet_length(before), grown)
    by_removal = (
        F.octet_length(before) - F.octet_length(F.replace(before, find, F.lit("")))
    ) / F.octet_length(find)
    return F.coalesce(by_growth, by_removal).cast("bigint")


def _unrolled(text: Column, rules: list[Rule]) -> tuple[Column, Column]:
    total = F.lit(0).cast("bigint")
    for find, replace in rules:
        after = F.replace(text, F.lit(find), F.lit(replace))
        grown = len(replace.encode()) - len(find.encode())
        if grown:
            change = F.octet_length(after) - F.octet_length(text)
        else:
            grown = len(find.encode())
            change = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(find), F.lit("")))
        total = total + (change / F.lit(grown)).cast("bigint")
        text = after
    return text, F.coalesce(total, F.lit(0).cast("bigint"))


def replaced_by(text: Column, rules: Column) -> Column:
    """``struct(text, n)`` after applying a column of rules (``array<struct<find, replace>>``)."""

    def step(state: Column, rule: Column) -> Column:
        before, find, replace = state["text"], rule["find"], rule["replace"]
        after = F.replace(before, find, replace)
        grown = F.octet_length(replace) - F.octet_length(find)
        n = state["n"] + _matches(before, after, find, grown)
        return F.when(
            (F.coalesce(find, F.lit("")) == "") | ~F.coalesce(before.contains(find), F.lit(False)), state
        ).otherwise(F.struct(after.alias("text"), n.alias("n")))

    start = F.struct(text.alias("text"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(rules, start, step)


def replaced(text: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """``struct(text, n)``: the updated text and its number of matches (0 for NULL)."""
    listed = active_rules(rules)
    if len(listed) > _UNROLLED_RULES:
        return replaced_by(text, rules_literal(listed))
    after, total = _unrolled(text, listed)
    return F.struct(after.alias("text"), total.alias("n"))


def replaced_runs(
    runs: Column, rules: Iterable[tuple[str, str]], spans: Column | None = None
) -> Column:
    """``struct(runs, n)`` of a paragraph, in the two passes of a document.

    Pass 1 replaces inside every run. Pass 2 looks at the concatenated runs and,
    when a rule changes them, puts the whole text into the first run and empties
    the others. Pass 2 sees the output of pass 1. ``spans`` lists (start, length)
    slices for paragraphs that contain paragraphs, outermost first; the default
    is one slice of all runs.
    """
    table = rules_literal(rules)
    first = F.transform(runs, lambda run: replaced_by(run, table))
    passed = F.struct(
        F.transform(first, lambda r: r["text"]).alias("runs"),
        F.aggregate(first, F.lit(0).cast("bigint"), lambda n, r: n + r["n"]).alias("n"),
    )
    if spans is None:
        spans = F.array(F.struct(F.lit(0).alias("start"), F.size(runs).alias("length")))

    def second(state: Column, span: Column) -> Column:
        texts, start, length = state["runs"], span["start"], span["length"]
        whole = F.array_join(F.transform(F.slice(texts, start + 1, length), lambda t: F.coalesce(t, F.lit(""))), "")

        def merged(bound: Column) -> Column:
            before, hit = bound["before"], bound["hit"]
            after = F.concat(
                F.slice(texts, F.lit(1), start),
                F.array(hit["text"]),
                F.array_repeat(F.lit(""), length - 1),
                F.slice(texts, start + length + 1, F.size(texts)),
            )
            return F.when(
                (hit["n"] > 0) & (hit["text"] != before),
                F.struct(after.alias("runs"), (state["n"] + hit["n"]).alias("n")),
            ).otherwise(state)

        bound = F.struct(whole.alias("before"), replaced_by(whole, table).alias("hit"))
        return F.when(length > 0, F.element_at(F.transform(F.array(bound), merged), 1)).otherwise(state)

    return F.aggregate(spans, passed, second)
