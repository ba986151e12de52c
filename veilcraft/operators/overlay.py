"""Replacement text drawn over page hits.

``spans``: doc, page, span_id, x0, y0, x1, y1, size, color, font, origin_y, text;
``hits``: doc, page, hit_id, rule_id, x0, y0, x1, y1.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from veilcraft.functions import geometry as geo
from veilcraft.functions.replace import Rule

# Edge of the finest grid squares that pair hits with spans, in page units; each level doubles it.
GRID = 256.0
BOX = ["doc", "page", "x0", "y0", "x1", "y1"]
LINE = ["doc", "page", "origin_y"]
# Columns of a span besides its text, in the order in which spans of a line are compared.
PLACE = ["x0", "span_id", "y0", "x1", "y1"]
# Types whose values are packed by their bits; others go as lists.
PACKED = {T.ByteType(): "i1", T.ShortType(): "i2", T.IntegerType(): "i4", T.LongType(): "i8", T.FloatType(): "f4", T.DoubleType(): "f8"}
# Spans that a task assembles at once; the spans of one line are not cut.
SPANS = 1 << 18


def _line_codes(columns: list[pa.Array]) -> np.ndarray:
    """One number a row, equal for rows of one line."""
    codes = [column.dictionary_encode("encode").indices.to_numpy().astype(np.int64) for column in columns]
    line = codes[0]
    for code in codes[1:]:
        line = line * (int(code.max()) + 1) + code
    return line


def _starts(line: np.ndarray) -> np.ndarray:
    return np.append(0, np.flatnonzero(line[1:] != line[:-1]) + 1)


def _edges(rows: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Where each of n values ends if only some rows have a length."""
    all_lengths = np.zeros(n + 1, np.int64)
    all_lengths[rows + 1] = lengths
    return np.cumsum(all_lengths)


def _blobs(values: np.ndarray, edges: np.ndarray, kind: pa.DataType = pa.binary()) -> pa.Array:
    """The bytes of the values between each two edges."""
    offsets = (edges * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(kind, len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _bytes(column: pa.Array, kind: str = "u1") -> tuple[np.ndarray, np.ndarray]:
    """The values of all blobs (or texts) behind each other, and the edges of each."""
    column = column.cast(pa.binary())
    edges = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    held = column.buffers()[2]
    values = np.frombuffer(held if held is not None else b"", np.uint8)[edges[0] : edges[-1]].view(kind)
    return values, (edges - edges[0]) // values.itemsize


def _steps(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences of neighbours as whole numbers of their bits, the bits themselves at the starts: even steps become equal numbers."""
    bits = values.view(f"i{values.itemsize}").astype(np.int64)
    steps = bits.copy()
    steps[1:] -= bits[:-1]
    steps[starts] = bits[starts]
    return steps


def _values(steps: np.ndarray, edges: np.ndarray, kind: str) -> np.ndarray:
    """What ``_steps`` was given; sums may wrap around, as the differences did."""
    bits, starts = np.cumsum(steps), edges[:-1]
    bits -= np.repeat(bits[starts] - steps[starts], np.diff(edges))
    return bits.astype(f"i{kind[1:]}").view(kind)


def _pieces(spans: DataFrame) -> DataFrame:
    """The spans of each line that come in one batch, as one row: what a page has together is shuffled together.

    A row for every span would repeat the names of its line, and sort and spill before the shuffle. Numbers go as steps of
    their bits, exact for any value; ``nulls`` has a bit for each of ``PLACE``. Neighbours equal in all of these are stored once and
    counted by ``runs``; where hardly any are, all are stored and there are no ``runs``.
    A function of columns gives the first span of a piece all of it and the others null: ``mapInArrow`` would sum up the size of the batch at every row.
    """
    kinds = {field.name: field.dataType for field in spans.schema.fields}
    packed = {name: kinds[name] in PACKED for name in PLACE}
    held = {name: T.BinaryType() if packed[name] else T.ArrayType(kinds[name]) for name in PLACE}
    schema = T.StructType([T.StructField(name, kind) for name, kind in (held | dict.fromkeys(["sizes", "nulls", "runs"], T.BinaryType()) | {"text": T.StringType()}).items()])

    def piece(*columns: pa.Array) -> pa.Array:
        n = len(columns[0])
        line = _line_codes(columns[: len(LINE)]) if n else np.zeros(0, np.int64)
        *place, text = columns[len(LINE) :]
        rows = starts = _starts(line)[:n]
        if len(np.unique(line[starts])) < len(starts):
            _, first, of = np.unique(line, return_index=True, return_inverse=True)
            order = np.argsort(first[of], kind="stable")
            place, text = [column.take(pa.array(order)) for column in place], text.take(pa.array(order))
            starts = _starts(line[order])
            rows = order[starts]
        text = text.cast(pa.string())
        letters, ends = _bytes(text)
        numbers, nulls = {}, np.zeros(n, np.uint8)
        for bit, (name, column) in enumerate(zip(PLACE, place)):
            if packed[name]:
                if column.null_count:
                    nulls |= column.is_null().to_numpy(zero_copy_only=False).astype(np.uint8) << bit
                    column = column.fill_null(0)
                numbers[name] = _steps(column.to_numpy(), starts)
        numbers |= {"sizes": pc.utf8_length(text).to_numpy().astype(np.int32), "nulls": nulls}
        fresh = np.zeros(n, bool)
        fresh[starts] = True
        for values in numbers.values():
            fresh[1:] |= values[1:] != values[:-1]
        runs = np.flatnonzero(fresh)
        stored = runs if 2 * len(runs) < n else np.arange(n)
        edges = _edges(rows, np.diff(np.append(starts, n)), n)
        held_edges = np.searchsorted(stored, edges)
        none = np.zeros(n + 1, np.int64)
        columns = {name: _blobs(values[stored], held_edges) for name, values in numbers.items() if name != "nulls" or nulls.any()}
        columns["runs"] = _blobs(np.diff(np.append(stored, n)).astype(np.int32), held_edges if len(stored) < n else none)
        columns["text"] = _blobs(letters, ends[edges], pa.string())
        columns |= {name: pa.ListArray.from_arrays(pa.array(edges, pa.int32()), column) for name, column in zip(PLACE, place) if not packed[name]}
        parts = [columns[name] if name in columns else _blobs(nulls, none) for name in schema.names]
        others = np.ones(n, bool)
        others[rows] = False
        return pa.StructArray.from_arrays(parts, schema.names, mask=pa.array(others))

    def key(name: str) -> Column:
        """As groups compare it: one zero and one NaN."""
        if kinds[name] not in (T.FloatType(), T.DoubleType()):
            return F.col(name)
        value = F.when(F.isnan(name), F.lit(float("nan"))).when(F.col(name) == 0, F.lit(0.0)).otherwise(F.col(name))
        return value.cast(kinds[name]).alias(name)

    # else a filter on its result would be evaluated before it, by calling it twice
    made = F.arrow_udf(piece, schema).asNondeterministic()
    pieces = spans.select(*LINE, made(*LINE, *PLACE, F.coalesce("text", F.lit(""))).alias("piece")).where("piece IS NOT NULL")
    return pieces.select(*map(key, LINE), "piece.*")


@dataclass(frozen=True)
class _Column:
    """Values of one of ``PLACE``, one for each span."""

    values: np.ndarray | pa.Array
    null: np.ndarray | None = None

    def take(self, index: np.ndarray) -> pa.Array:
        if isinstance(self.values, pa.Array):
            return self.values.take(pa.array(index))
        return pa.array(self.values[index], mask=None if self.null is None else self.null[index])

    def keys(self, index: np.ndarray | slice = slice(None)) -> list[np.ndarray]:
        """Whole numbers in the order of the values: nulls first, NaN last, one zero."""
        if isinstance(self.values, pa.Array):
            return [pc.rank(self.values, "ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)[index]]
        values = self.values[index]
        if values.dtype.kind == "f":
            values = values.astype(np.float64) + 0.0
            values[np.isnan(values)] = np.nan
            bits = values.view(np.int64)
            values = bits ^ ((bits >> 63) & np.int64(2**63 - 1))
        values = values.astype(np.int64)
        return [values] if self.null is None else [~self.null[index], np.where(self.null[index], 0, values)]


@dataclass(frozen=True)
class _Lines:
    """Whole lines: for every span, from left to right, its line, length and ``PLACE``; the letters of all behind each other."""

    doc: pa.Array
    page: pa.Array
    line: np.ndarray
    size: np.ndarray
    place: dict[str, _Column]
    order: np.ndarray
    letters: np.ndarray

    def take(self, name: str, spans: np.ndarray) -> pa.Array:
        return self.place[name].take(self.order[spans])


def _joined(rows: pa.Table, name: str) -> pa.Array:
    chunks = rows.column(name).chunks
    return chunks[0] if len(chunks) == 1 else pa.concat_arrays(chunks)


def _counts(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """How many spans each stored value stands for, and where the values of each piece begin and end."""
    stored = _bytes(_joined(rows, "sizes"), "i4")[1]
    runs, ends = _bytes(_joined(rows, "runs"), "i4")
    counts = np.ones(stored[-1], np.int64)
    counts[np.repeat(np.diff(ends) > 0, np.diff(stored))] = runs
    return counts, stored


def _assemble(rows: pa.Table, starts: np.ndarray, kinds: dict[str, str | None]) -> _Lines:
    """The lines of which pieces are given, each from one of the starts to the next."""
    part = partial(_joined, rows)
    counts, stored = _counts(rows)
    edges = np.append(0, np.cumsum(counts))[stored]
    line = np.repeat(np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows.num_rows))), np.diff(edges))
    size = np.repeat(_bytes(part("sizes"), "i4")[0], counts)
    flags, ends = _bytes(part("nulls"))
    nulls = np.zeros(len(counts), np.uint8)
    if len(flags):
        nulls[np.repeat(np.diff(ends) > 0, np.diff(stored))] = flags
        nulls = np.repeat(nulls, counts)
    place = {}
    for bit, (name, kind) in enumerate(kinds.items()):
        null = (nulls >> bit & 1).astype(bool)
        values = _values(np.repeat(_bytes(part(name), "i8")[0], counts), edges, kind) if kind else part(name).flatten()
        place[name] = _Column(values, null if kind and null.any() else None)
    letters = np.frombuffer(_bytes(part("text"))[0].tobytes().decode().encode("utf-32-le"), np.uint32)

    keys = place["x0"].keys()
    same = line[1:] == line[:-1]
    order = np.arange(len(line))
    if len(keys) > 1 or not np.all(keys[0][1:][same] > keys[0][:-1][same]):
        order = np.lexsort((*reversed(keys), line))
        tied = np.append(False, same & np.all([key[order][1:] == key[order][:-1] for key in keys], axis=0))
        if tied.any():
            at = np.flatnonzero(tied | np.append(tied[1:], False))
            among, group = order[at], np.cumsum(~tied)[at]
            first = np.cumsum(size, dtype=np.int64) - size
            texts = [letters[i : i + n].tobytes().decode("utf-32-le").encode() for i, n in zip(first[among].tolist(), size[among].tolist())]
            ranks = {text: rank for rank, text in enumerate(sorted(set(texts)))}
            finer = [key for name in PLACE[1:] for key in place[name].keys(among)] + [np.array([ranks[text] for text in texts])]
            order[at] = among[np.lexsort((*reversed(finer), group))]
        first = np.cumsum(size, dtype=np.int64) - size
        size = size[order]
        letters = letters[np.repeat(first[order] - (np.cumsum(size, dtype=np.int64) - size), size) + np.arange(len(letters))]
    return _Lines(part("doc").take(pa.array(starts)), part("page").take(pa.array(starts)), line, size, place, order, letters)


def _whole_lines(batches: Iterator[pa.RecordBatch], kinds: dict[str, str | None]) -> Iterator[_Lines]:
    """Lines of which all pieces have come, about ``SPANS`` spans at a time; the pieces come sorted by line."""

    def emit(rows: list[pa.RecordBatch]) -> Iterator[_Lines]:
        table = pa.Table.from_batches(rows)
        starts = _starts(_line_codes([_joined(table, name) for name in LINE]))
        counts, stored = _counts(table)
        spans = np.add.reduceat(counts, stored[starts])
        cuts = np.append(_starts(np.cumsum(spans) // SPANS), len(starts))
        edges = np.append(starts, table.num_rows)
        for low, high in zip(cuts[:-1], cuts[1:]):
            yield _assemble(table.slice(edges[low], edges[high] - edges[low]), starts[low:high] - edges[low], kinds)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(name) for name in LINE]
        if held:
            keys = [pa.concat_arrays([held[-1].column(name).slice(held[-1].num_rows - 1), key]) for name, key in zip(LINE, keys)]
        line = _line_codes(keys)
        last = int(_starts(line)[-1]) - bool(held)
        if last < 0:  # all of it goes on with the line that is held
            held.append(batch)
            continue
        ended = held + ([batch.slice(0, last)] if last else [])
        held = [batch.slice(last)]
        if ended:
            yield from emit(ended)
    if held:
        yield from emit(held)


def _gathered(spans: DataFrame) -> tuple[DataFrame, dict[str, str | None]]:
    """The pieces of all lines, those of a line behind each other, and how their numbers are packed."""
    kinds = {name: PACKED.get(spans.schema[name].dataType) for name in PLACE}
    return _pieces(spans.where("origin_y IS NOT NULL")).repartition(*LINE).sortWithinPartitions(*LINE), kinds


def _lone(spans: DataFrame) -> DataFrame:
    parts = F.struct("x0", "span_id", "y0", "x1", "y1", F.coalesce("text", F.lit("")).alias("text"))
    return spans.where("origin_y IS NULL").select("doc", "page", F.col("span_id").alias("line"), F.coalesce("text", F.lit("")).alias("text"), F.array(parts).alias("spans"))


def _with_baseline(spans: DataFrame) -> DataFrame:
    return spans if "origin_y" in spans.columns else spans.withColumn("origin_y", F.lit(None).cast("double"))


def text_lines(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of one span and lines that may have several, each (doc, page, line, text, spans): the spans of one baseline from
    left to right, and their text in one piece.

    A line is named after its first span. A span without a baseline is a line of its own and is not shuffled. What comes
    together is one line of one page. Spans that arrive together are shuffled as one piece of their line.
    """
    spans = _with_baseline(spans)
    lone = _lone(spans)
    pieces, kinds = _gathered(spans)
    names = lone.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines in _whole_lines(batches, kinds):
            first, every = _starts(lines.line), np.arange(len(lines.line))
            ends, letters = np.append(0, np.cumsum(lines.size, dtype=np.int64)).tolist(), lines.letters.tobytes().decode("utf-32-le")
            texts = pa.array([letters[i:j] for i, j in zip(ends[:-1], ends[1:])], pa.string())
            edges = np.append(first, len(every))
            whole = pa.array([letters[ends[i] : ends[j]] for i, j in zip(edges[:-1].tolist(), edges[1:].tolist())], pa.string())
            listed = pa.StructArray.from_arrays([*(lines.take(name, every) for name in PLACE), texts], [*PLACE, "text"])
            columns = [lines.doc, lines.page, lines.take("span_id", first), whole, pa.ListArray.from_arrays(pa.array(edges, pa.int32()), listed)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return lone, pieces.mapInArrow(run, lone.schema)


# What characters of rules match, as the regular expressions of the JVM have it; asked once for each.
_alike: dict[tuple[str, bool], frozenset[int]] = {}


def _letters_alike(spark: SparkSession, rules: list[Rule]) -> list[list[frozenset[int]]]:
    """For every character of every rule the characters that match it when case is ignored.

    A character alone and one among others are not compiled alike (a sharp s matches its capital only among others), so each is tried as it stands.
    """
    wanted = [[(letter, len(rule.find) == 1) for letter in rule.find] for rule in rules]
    asked = sorted({pair for pairs in wanted for pair in pairs} - _alike.keys())
    if asked:
        patterns = [re.escape(letter) + ("" if alone else "\0") for letter, alone in asked]
        every = spark.range(0x110000).where("id NOT BETWEEN 55296 AND 57343").selectExpr("id", "decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') AS letter")
        every = every.where(F.concat("letter", F.lit("\0")).rlike("(?iu)(?:" + "|".join(patterns) + ")"))
        tests = [(F.col("letter") if alone else F.concat("letter", F.lit("\0"))).rlike("(?iu)" + pattern) for (_, alone), pattern in zip(asked, patterns)]
        found = every.select("id", F.array(*tests).alias("alike")).collect()
        _alike.update({pair: frozenset({ord(pair[0])} | {row["id"] for row in found if row["alike"][i]}) for i, pair in enumerate(asked)})
    return [[_alike[pair] for pair in pairs] for pairs in wanted]


class _Finder:
    """Finds rules in letters; ``alike`` has for each rule the sets of letters that match its characters."""

    def __init__(self, alike: list[list[frozenset[int]]]) -> None:
        sets = sorted({letters for rule in alike for letters in rule}, key=sorted)
        members: dict[int, list[int]] = {}
        for i, letters in enumerate(sets):
            for letter in letters:
                members.setdefault(letter, []).append(i)
        # letters that are in the same sets are of one kind; all others are kind 0
        kinds = {of: kind for kind, of in enumerate(sorted({tuple(of) for of in members.values()}), 1)}
        self.table = np.zeros(0x110000, np.uint8 if len(kinds) < 256 else np.uint32)
        for letter, of in members.items():
            self.table[letter] = kinds[tuple(of)]
        where = {letters: [kind for of, kind in kinds.items() if i in of] for i, letters in enumerate(sets)}
        self.rules = [[where[letters] for letters in rule] for rule in alike]

    def find(self, letters: np.ndarray, line_ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each rule where its hits begin, in which lines, and their numbers within the line; hits of one rule do not overlap."""
        kinds = self.table[letters]
        for rule in self.rules:
            size = len(rule)
            at = np.flatnonzero(_is_one_of(kinds[: max(len(kinds) - size + 1, 0)], rule[0]))
            for i, wanted in enumerate(rule[1:], 1):
                at = at[_is_one_of(kinds[at + i], wanted)]
            line = np.searchsorted(line_ends, at, "right")
            inside = at + size <= line_ends[line]
            at, line = at[inside], line[inside]
            if np.any(np.diff(at) < size):
                kept, free = [], 0
                for i, place in enumerate(at.tolist()):
                    if place >= free:
                        kept.append(i)
                        free = place + size
                at, line = at[kept], line[kept]
            yield at, line, np.arange(len(at)) - np.searchsorted(line, line, "left")


def _is_one_of(kinds: np.ndarray, wanted: list[int]) -> np.ndarray:
    return reduce(np.logical_or, [kinds == kind for kind in wanted])


def _parts(spans: DataFrame, rules: dict[int, Rule]) -> DataFrame:
    """A row for every span that a hit touches, in lines of several spans: the span, its length, and the hit's share of it."""
    pieces, packing = _gathered(spans)
    kinds = {field.name: field.dataType for field in spans.schema.fields}
    numbers = ["rule_id", "hit_no", "part", "size", "start", "end"]
    schema = T.StructType([
        T.StructField("doc", kinds["doc"]), T.StructField("page", kinds["page"]), T.StructField("line", kinds["span_id"]),
        *(T.StructField(name, kinds[name]) for name in PLACE), *(T.StructField(name, T.IntegerType(), False) for name in numbers),
    ])
    names, sizes = list(rules), [len(rule.find) for rule in rules.values()]
    alike = _letters_alike(spans.sparkSession, list(rules.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Finder(alike)
        for lines in _whole_lines(batches, packing):
            first = _starts(lines.line)
            full = np.flatnonzero(lines.size)  # spans without text are not touched
            if not len(full):
                continue
            ends = np.cumsum(lines.size[full], dtype=np.int64)
            begins = ends - lines.size[full]
            line_ends = np.cumsum(lines.size, dtype=np.int64)[np.append(first[1:], len(lines.line)) - 1]
            for name, size, (at, line, hit_no) in zip(names, sizes, finder.find(lines.letters, line_ends)):
                if not len(at):
                    continue
                low = np.searchsorted(ends, at, "right")
                touched = np.searchsorted(ends, at + size - 1, "right") - low + 1
                hit = np.repeat(np.arange(len(at)), touched)
                part = np.arange(len(hit)) - np.repeat(np.cumsum(touched) - touched, touched)
                span = low[hit] + part
                start = np.maximum(at[hit] - begins[span], 0)
                end = np.minimum(at[hit] + size, ends[span]) - begins[span]
                of, span_rows = pa.array(line[hit]), full[span]
                columns = [lines.doc.take(of), lines.page.take(of), lines.take("span_id", first[line[hit]]), *(lines.take(n, span_rows) for n in PLACE)]
                counts = (np.full(len(hit), name), hit_no[hit], part, lines.size[span_rows], start, end)
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(n.astype(np.int32)) for n in counts)], schema.names)

    return pieces.mapInArrow(run, schema)


def find_hits(spans: DataFrame, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """Every occurrence of every rule in the original text of every line, ignoring case; a row for each span that it touches.

    All rules see the original text, so they do not cascade, and offsets are in it, whatever letters change their length in
    lower case. A hit may run over several spans: ``part`` counts them, ``start`` is where it begins in that span, the box
    is its share of the span's width, and the first part carries the replacement, the others an empty text, as with the
    runs of a paragraph. ``hit_no`` counts within line and rule. Rules without a match leave before lines are copied.
    """
    spans = _with_baseline(spans)
    listed = {i: rule for i, rule in enumerate(Rule(*rule) for rule in rules) if rule.find}
    table = F.array(
        *[
            F.struct(
                F.lit(i).alias("rule_id"),
                F.lit(r.replace).alias("replace"),
                F.lit(len(r.find)).alias("size"),
                F.split("text", "(?iu)" + re.escape(r.find)).alias("pieces"),
            )
            for i, r in listed.items()
        ]
    )
    matching = F.filter(table, lambda rule: F.size(rule["pieces"]) > 1)
    alone = _lone(spans).withColumn("_rule", F.explode(matching))
    starts = F.aggregate(
        F.slice("_rule.pieces", 1, F.size("_rule.pieces") - 1),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda state, piece: F.struct(
            (state["at"] + F.length(piece) + F.col("_rule.size")).alias("at"),
            F.concat(state["starts"], F.array(state["at"] + F.length(piece))).alias("starts"),
        ),
    )["starts"]

    def box(span: Callable[[str], Column], size: Column, start: Column, end: Column) -> list[Column]:
        unit = (span("x1") - span("x0")) / size
        return [
            start.alias("start"), F.col("replace"), (span("x0") + unit * start).alias("x0"), span("y0").alias("y0"),
            (span("x0") + unit * end).alias("x1"), span("y1").alias("y1"),
        ]

    named = ["doc", "page", "line", "span_id", "rule_id", "hit_no", "part"]
    single = alone.select("doc", "page", "line", "_rule.rule_id", "_rule.replace", "_rule.size", F.col("spans")[0].alias("span"), F.posexplode(starts).alias("hit_no", "at"))
    single = single.withColumns({"span_id": F.col("span.span_id"), "part": F.lit(0)})
    within = single.select(*named, *box(lambda name: F.col("span")[name], F.length("span.text"), F.col("at"), F.col("at") + F.col("size")))
    texts = F.element_at(F.array(*[F.lit(listed[i].replace if i in listed else "") for i in range(max(listed) + 1)]), F.col("rule_id") + 1)
    parts = _parts(spans, listed).withColumn("replace", F.when(F.col("part") == 0, texts).otherwise(""))
    return within.unionByName(parts.select(*named, *box(F.col, F.col("size"), F.col("start"), F.col("end"))))


def _level(x0: str, y0: str, x1: str, y1: str) -> Column:
    """The level whose squares are as long as the box at least, so that it covers at most four of them."""
    side = F.greatest(F.col(x1) - F.col(x0), F.col(y1) - F.col(y0))
    return F.ceil(F.log2(F.greatest(side, F.lit(GRID)) / GRID)).cast("int")


def _square(place: Column) -> Column:
    return F.floor(place / (GRID * F.pow(F.lit(2.0), F.col("_level")))).cast("bigint")


def _squares(low: str, high: str) -> Column:
    first = _square(F.col(low))
    return F.explode(F.sequence(first, F.greatest(first, _square(F.col(high)))))


def _corner(low: str, square: str) -> Column:
    """Whether a square holds the upper or left edge of the overlap: of several shared squares one does."""
    return F.col(square) == _square(F.greatest(F.col(low), F.col(f"s_{low}")))


def _levels(boxes: DataFrame) -> list[int]:
    """The levels that occur: one number for each doubling of the largest box."""
    return sorted(row[0] for row in boxes.select("own").where("own IS NOT NULL").distinct().collect())


def best_spans(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """For each distinct hit box the span that shares the largest area; the first span wins a tie.

    Copies of one box count once on both sides: the first of equal spans would win
    anyway. A box lies in the level of squares that fits its size. The smaller of two boxes looks for the larger one in that
    one's level, so every box is in at most four squares for each level that occurs, whatever its size; a page that holds
    most of the corpus is split by position and only neighbours pair up, each pair once.
    """
    placed = hits.select(*BOX).distinct().withColumn("own", _level(*BOX[2:]))
    style = F.struct("span_id", "size", "color", "font", "origin_y")
    boxes = spans.groupBy(*BOX).agg(F.min_by(style, "span_id").alias("span")).select(
        "doc", "page", "span", *[F.col(c).alias(f"s_{c}") for c in BOX[2:]]
    )
    boxes = boxes.withColumn("own", _level("s_x0", "s_y0", "s_x1", "s_y1"))
    touching = (
        (F.col("x0") < F.col("s_x1")) & (F.col("s_x0") < F.col("x1"))
        & (F.col("y0") < F.col("s_y1")) & (F.col("s_y0") < F.col("y1"))
    )
    hit_levels = _levels(hits.select(_level(*BOX[2:]).alias("own")))
    span_levels = _levels(spans.select(_level(*BOX[2:]).alias("own")))

    def home(side: DataFrame, prefix: str) -> DataFrame:
        return side.withColumnRenamed("own", "_level").withColumn("_gx", _squares(f"{prefix}x0", f"{prefix}x1")).withColumn("_gy", _squares(f"{prefix}y0", f"{prefix}y1"))

    def looking(side: DataFrame, prefix: str, levels: list[int], same: bool) -> DataFrame:
        above = F.filter(F.array(*map(F.lit, levels)), lambda level: level >= F.col("own") if same else level > F.col("own"))
        return home(side.withColumn("own", F.explode(above)), prefix)

    keys = ["doc", "page", "_level", "_gx", "_gy"]
    pairs = looking(placed, "", span_levels, True).join(home(boxes, "s_"), keys)
    if hit_levels and span_levels and hit_levels[-1] > span_levels[0]:
        pairs = pairs.unionByName(looking(boxes, "s_", hit_levels, False).join(home(placed, ""), keys))
    paired = pairs.where(touching & _corner("x0", "_gx") & _corner("y0", "_gy"))
    rank = F.struct(geo.overlap_area("", "s_").alias("area"), (-F.col("span.span_id")).alias("order"))
    return paired.groupBy(*BOX).agg(F.max_by("span", rank).alias("span"))


def overlay_styles(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """Font size, colour, font and baseline for every hit, from its best span or its own height."""
    # About one lookup row per hit, so copying the lookup to salts would cost more than it
    # spreads; adaptive execution splits the partition of a box with very many copies.
    styled = hits.join(best_spans(hits, spans), BOX, "left")
    height = F.col("y1") - F.col("y0")
    fallback = geo.clamp_size(height * geo.HEIGHT_TO_SIZE)
    own_size = geo.clamp_size(F.coalesce(F.nullif(F.col("span.size"), F.lit(0.0)), fallback))
    size = F.when(F.col("span").isNull(), fallback).otherwise(own_size)
    shade = geo.color_parts(F.col("span.color"))
    return styled.select(
        *hits.columns,
        F.col("span.span_id").alias("span_id"),
        size.alias("font_size"),
        shade["red"].alias("red"),
        shade["green"].alias("green"),
        shade["blue"].alias("blue"),
        geo.font_family(F.col("span.font")).alias("font"),
        F.coalesce("span.origin_y", geo.centred_baseline(F.col("y1"), height, size)).alias("baseline"),
    )
