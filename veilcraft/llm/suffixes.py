"""Removing repeated byte strings by a depth-limited radix sort of suffixes.

Every suffix matters only through its first ``length`` bytes, and suffixes that agree so far are exactly the repeated
windows. They are sorted by passes over digits, most significant first, and a group of one leaves after each pass:

1. The first digit is a run of ``DIGIT`` bytes inside the window: the one of least hash (so equal windows choose the same
   one, and about one start in a hundred is an anchor for all windows around it). Anchors that occur once leave.
2. The second digit is all that windows with this anchor can read, up to ``length - DIGIT`` bytes before it and ``length``
   bytes from it on. Where that is equal, all those windows are, so such places are done; one of them stands for them.
3. While an anchor or digit still has more than ``GROUP`` different surroundings, its places take another digit: windows are
   told apart by how far they reach to the left, in two halves of what is possible, and the digit is all that the windows of a half
   share, on both sides of the anchor. Places alone with theirs leave, and equal ones are done, as before. Halves of one window are
   that window, so eight such passes at most leave no large group, and of a passage that many texts share only the halves
   that hold one of its ends stay.
4. The last digit orders the single windows: their hashes are sorted in groups of bounded size.

Windows are compared by 128 bits (the anchor's and their own). Counts combine before every shuffle; what moves are anchors of
24 bytes, the surroundings of undecided places, and compressed texts twice. Nothing is gathered but the places of one document
and groups of at most ``GROUP`` places on average.

Defined results: a null text is empty; texts shorter than ``length`` bytes stay; strings are judged on the input; of equal rows
every one is a copy of the other; ids may be null or repeated; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilcraft.llm.common import RollingHash, flat, mix, slices, squeezed, unsqueezed
from veilcraft.session import materialize

LENGTH, DIGIT = 400, 200
GROUP = 2048
PIECE_BYTES = 1 << 20
#: Bits that number the places of a slice or piece while anchors are chosen; the others are the hash's.
_PLACE_BITS = 24


def anchors(data: np.ndarray, starts: np.ndarray, length: int, digit: int) -> tuple[np.ndarray, ...]:
    """Anchors of texts laid end to end: hash, hash of surroundings, text, place in it, bytes before and from it on that are read."""
    window = length - digit + 1
    rolling = RollingHash(data)
    grams = rolling.windows(digit)
    count = len(data) - length + 1
    if count <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    low = np.uint64((1 << _PLACE_BITS) - 1)
    ranked = np.full(-(-len(grams) // window) * window, ~np.uint64(0))
    ranked[: len(grams)] = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    blocks = ranked.reshape(-1, window)  # least of every window of grams, from running minima to both sides of each block
    onward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(backward[:count], onward[window - 1 : window - 1 + count])
    text = np.searchsorted(starts, np.arange(count), "right") - 1
    place = (least & low)[np.arange(count) + length <= starts[text + 1]].astype(np.int64)
    place = place[np.concatenate(([True], place[1:] != place[:-1]))] if len(place) else place
    text = np.searchsorted(starts, place, "right") - 1
    begin, end = np.maximum(starts[text], place - (length - digit)), np.minimum(starts[text + 1], place + length)
    around = mix(rolling.of(begin, end) + ((place - begin) * (2 * length) + end - place).astype(np.uint64))
    return grams[place].view(np.int64), around.view(np.int64), text, place - starts[text], place - begin, end - place


def anchors_of(column: pa.Array, length: int, digit: int) -> tuple[np.ndarray, ...]:
    """The anchors of a column's texts; a long text is read in overlapping pieces."""
    data, starts = flat(column)
    if len(column) > 1 or len(data) <= PIECE_BYTES:
        return anchors(data, starts, length, digit)
    found = []
    for begin in range(0, len(data), PIECE_BYTES):
        # what stands around an anchor may reach beyond the windows of a piece
        first, last = max(0, begin - length), min(len(data), begin + PIECE_BYTES + 2 * length)
        part = anchors(data[first:last], np.array([0, last - first]), length, digit)
        place = part[3] + first
        inside = (place >= begin) & (place < begin + PIECE_BYTES)
        found.append(tuple(column[inside] for column in (*part[:3], place, *part[4:])))
    return tuple(np.concatenate(columns) for columns in zip(*found))


def anchor_table(docs: DataFrame, length: int, digit: int) -> DataFrame:
    """(doc_id, text_hash, anchor, around, place, before, onward), a row per anchor."""
    wanted = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    names = ("anchor", "around", "place", "before", "onward")
    id_type = wanted.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = anchors_of(part.column("text"), length, digit)
                edges = pa.array(np.searchsorted(found[2], np.arange(part.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(edges, pa.array(values.astype(kind))) for values, kind in zip((found[0], found[1], *found[3:]), (np.int64, np.int64, np.int32, np.int16, np.int16))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), *lists], ["doc_id", "text_hash", *names])

    schema = f"doc_id {id_type}, text_hash long, anchor array<long>, around array<long>, place array<int>, before array<short>, onward array<short>"
    packed = materialize(wanted.mapInArrow(run, schema).where("size(anchor) > 0"), "suffix-anchors")
    return packed.select("doc_id", "text_hash", F.explode(F.arrays_zip(*names)).alias("a")).select("doc_id", "text_hash", "a.*")


def halves(around: bytes, before: int, low: int, high: int, length: int) -> Iterator[tuple[int, int, int, bytes, int]]:
    """Least and most bytes that windows reach to the left of the anchor, in two halves, with bytes before it, bytes to read and digit.

    Halves that no window of this place is in are left out.
    """
    middle = (low + high + 1) // 2
    for least, most in ((middle, high), (low, middle - 1)):
        kept, onward = min(before, most), min(len(around) - before, length - least)
        if least <= kept and kept + onward >= length:
            piece = around[before - kept : before + onward]
            yield least, most, kept, piece, _digest(piece[kept - least : kept + length - most] + least.to_bytes(4, "little") + most.to_bytes(4, "little"))


def _digest(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


#: A place with what its windows read: between ``low`` and ``high`` bytes before the anchor, ``before`` at most here.
_PLACE = "doc_id {id}, text_hash long, anchor long, place int, many boolean, low int, high int, before int, second long, around long, bytes binary"


def _told(rows: pa.RecordBatch, owner: list[int], many: pa.Array, found: list[tuple]) -> pa.RecordBatch:
    """Rows of ``_PLACE``: what was ``found`` of the rows that own it."""
    take = pa.array(owner, pa.int64())
    low, high, before, pieces, second = zip(*found) if found else ([],) * 5
    around = [_digest(x + b.to_bytes(4, "little")) for x, b in zip(pieces, before)]
    columns = [rows.column(name).take(take) for name in ("doc_id", "text_hash", "anchor", "place")]
    columns += [many.take(take)] + [pa.array(x, pa.int32()) for x in (low, high, before)]
    columns += [pa.array(second, pa.int64()), pa.array(around, pa.int64()), pa.array(pieces, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "anchor", "place", "many", "low", "high", "before", "second", "around", "bytes"])


def surroundings(docs: DataFrame, open_places: DataFrame, length: int, digit: int) -> DataFrame:
    """The undecided places with the bytes that their windows read: in halves for anchors of many; ``around`` tells all bytes."""
    item = F.struct("anchor", "place", "before", "onward", "many")
    by_doc = open_places.groupBy("doc_id", "text_hash").agg(F.collect_list(item).alias("items"))
    joined = with_texts(docs, by_doc, "inner")
    id_type = joined.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                lists = part.column("items")
                text = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                items = lists.flatten()
                texts = [unsqueezed(z) for z in part.column("squeezed").to_pylist()]
                owner, found = [], []
                reach = zip(text.tolist(), *(items.field(name).to_pylist() for name in ("place", "before", "onward", "many")))
                for row, (t, place, before, onward, many) in enumerate(reach):
                    around = texts[t][place - before : place + onward]
                    pieces = list(halves(around, before, 0, length - digit, length)) if many else [(0, length - digit, before, around, 0)]
                    owner += [row] * len(pieces)
                    found += pieces
                of_text = pa.array(text)
                rows = pa.RecordBatch.from_arrays([part.column("doc_id").take(of_text), part.column("text_hash").take(of_text), items.field("anchor"), items.field("place")], ["doc_id", "text_hash", "anchor", "place"])
                yield _told(rows, owner, items.field("many"), found)

    return joined.mapInArrow(run, _PLACE.format(id=id_type))


def halved(places: DataFrame, length: int) -> DataFrame:
    """The places once more, in the halves of what their windows reach to the left."""
    id_type = places.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, found = [], []
            for row, (around, before, low, high) in enumerate(zip(*(batch.column(name).to_pylist() for name in ("bytes", "before", "low", "high")))):
                pieces = list(halves(around, before, low, high, length))
                owner += [row] * len(pieces)
                found += pieces
            yield _told(batch, owner, batch.column("many"), found)

    return places.mapInArrow(run, _PLACE.format(id=id_type))


def with_texts(docs: DataFrame, by_doc: DataFrame, how: str) -> DataFrame:
    """The documents' texts, compressed ahead of the shuffle, beside what ``by_doc`` says of (doc_id, text_hash)."""
    keyed = squeezed(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")))
    told = by_doc.withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    match = (F.col("text_hash") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    return keyed.join(told, match, how).drop("__id", "__hash")


def sorted_windows(group: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of a group's places, each once: place's row, start within its bytes, hash; ordered by hash.

    In a stretch of short period one anchor stands at several places of a text, and a window that holds two of them is
    in reach of both; it counts for the first of them only, or it would find itself.
    """
    sizes = np.array([len(x) for x in group["bytes"].to_pylist()], np.int64)
    data = np.frombuffer(b"".join(group["bytes"].to_pylist()), np.uint8)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    counts = np.maximum(np.minimum(group["before"].to_numpy().astype(np.int64) + 1, sizes - length + 1), 0)
    rows = np.repeat(np.arange(len(sizes)), counts)
    offsets = np.arange(len(rows)) - np.repeat(np.concatenate(([0], np.cumsum(counts)))[:-1], counts)
    starts = (group["place"].to_numpy().astype(np.int64) - group["before"].to_numpy())[rows] + offsets
    once = np.unique(np.column_stack((texts_of(group)[rows], starts)), axis=0, return_index=True)[1]
    rows, offsets = rows[once], offsets[once]
    hashes = RollingHash(data).of(begin[rows] + offsets, begin[rows] + offsets + length)
    order = np.argsort(hashes, kind="stable")
    return rows[order], offsets[order], hashes[order]


def texts_of(group: pa.Table) -> np.ndarray:
    """A number for the text (id and hash) that each place of a group is in."""
    ids = group["doc_id"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
    return np.unique(np.column_stack((ids.astype(np.int64), group["text_hash"].to_numpy())), axis=0, return_inverse=True)[1].ravel()


def decided(places: DataFrame, length: int) -> DataFrame:
    """Sort the windows of groups that come one after the other: intervals to remove."""
    id_type = places.schema["doc_id"].dataType.simpleString()

    def solve(group: pa.Table) -> Iterator[pa.RecordBatch]:
        rows, offsets, hashes = sorted_windows(group, length)
        equal = hashes[1:] == hashes[:-1]
        repeated = np.zeros(len(hashes), bool)
        repeated[1:] |= equal
        repeated[:-1] |= equal
        starts = (group["place"].to_numpy()[rows] - group["before"].to_numpy()[rows] + offsets).astype(np.int64)
        at = np.flatnonzero(repeated)
        if not len(at):
            return
        at = at[np.lexsort((starts[at], rows[at]))]  # windows that follow each other become one interval
        fresh = np.concatenate(([True], (rows[at][1:] != rows[at][:-1]) | (starts[at][1:] != starts[at][:-1] + 1)))
        last = np.concatenate((np.flatnonzero(fresh)[1:], [len(at)])) - 1
        take = pa.array(rows[at[fresh]])
        ids = [group[name].take(take).combine_chunks() for name in ("doc_id", "text_hash")]
        yield pa.RecordBatch.from_arrays([*ids, pa.array(starts[at[fresh]]), pa.array(starts[at[last]] + length)], ["doc_id", "text_hash", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            rows = pa.Table.from_batches([*held, batch]).combine_chunks()
            marks = np.column_stack([rows[name].to_numpy() for name in ("anchor", "second")])
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist()]
            for begin, end in zip(cuts, cuts[1:]):
                yield from solve(rows.slice(begin, end - begin))
            held = rows.slice(cuts[-1]).to_batches()
        if held:
            yield from solve(pa.Table.from_batches(held).combine_chunks())

    return places.mapInArrow(run, f"doc_id {id_type}, text_hash long, start long, end long")


def repeated_intervals(docs: DataFrame, length: int, digit: int) -> DataFrame:
    """(doc_id, text_hash, start, end): stretches of bytes covered by strings of ``length`` bytes that also start elsewhere."""
    rows = anchor_table(docs, length, digit)
    # counts are written before they are joined: adaptive execution splits a hot key only between two shuffles
    twice = materialize(rows.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "suffix-twice")
    places = materialize(rows.join(twice, "anchor"), "suffix-places")
    at = F.struct("doc_id", "text_hash", "place", "before", "onward")
    kinds = places.groupBy("anchor", "around").agg(F.count("*").alias("n"), F.first(at).alias("at"))
    kinds = materialize(kinds, "suffix-kinds")
    equal = kinds.where("n > 1").select("anchor", "around")
    done = places.where(F.col("before") + F.col("onward") >= length).join(equal, ["anchor", "around"])
    done = done.select("doc_id", "text_hash", (F.col("place") - F.col("before")).cast("long").alias("start"), (F.col("place") + F.col("onward")).cast("long").alias("end"))
    several = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    open_places = kinds.join(several, "anchor").select("anchor", "at.*", (F.col("kinds") > GROUP).alias("many"))
    near = materialize(surroundings(docs, open_places, length, digit), "suffix-surroundings")
    # further digits for anchors with many places: alone, equal, few enough to be sorted, or halved again
    settled, left, digits = [near.where("not many")], near.where("many"), ["anchor", "second"]
    while not left.isEmpty():
        alike = materialize(left.groupBy(*digits, "around").agg(F.count("*").alias("n")), "suffix-kinds")
        same = left.join(alike.where("n > 1").drop("n"), [*digits, "around"])
        start = (F.col("place") - F.col("before")).cast("long")
        done = done.unionByName(same.select("doc_id", "text_hash", start.alias("start"), (start + F.octet_length("bytes")).alias("end")))
        kinds = materialize(alike.groupBy(*digits).agg(F.count("*").alias("kinds")).where("kinds > 1"), "suffix-digits")
        rest = materialize(left.dropDuplicates([*digits, "around"]).join(kinds, digits), "suffix-rest")
        settled.append(rest.where(F.col("kinds") <= GROUP).drop("kinds"))
        left = materialize(halved(rest.where(F.col("kinds") > GROUP).drop("kinds"), length), "suffix-halves")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = reduce(DataFrame.unionByName, settled).repartition(partitions, *digits).sortWithinPartitions(*digits)
    return done.unionByName(decided(near, length))


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (maximal runs of removed bytes as start and end) and ``kept``, the bytes that remain."""
    named = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    found = repeated_intervals(named, length, max(1, length // 2))
    by_doc = found.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "end")).alias("found"))
    joined = with_texts(named, by_doc, "left")
    id_type = named.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sizes, spans, kept = [], [], []
                for packed, covered in zip(part.column("squeezed").to_pylist(), part.column("found").to_pylist()):
                    text, runs = unsqueezed(packed), merged(covered or [])
                    sizes.append(len(text)), spans.append([{"start": a, "end": b} for a, b in runs])
                    edges = [0, *(x for run in runs for x in run), len(text)]
                    kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(run, f"doc_id {id_type}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def merged(intervals: list[dict]) -> list[tuple[int, int]]:
    runs: list[list[int]] = []
    for start, end in sorted((x["start"], x["end"]) for x in intervals):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    return [tuple(run) for run in runs]

