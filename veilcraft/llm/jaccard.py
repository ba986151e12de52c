"""Jaccard self-join of word shingle sets by parity sketches.

A set is hashed into a bit sketch: each shingle flips one bit. The sketches of two sets differ in no more bits than the sets
differ in shingles. Two sets of similarity t differ in at most D = floor(a (1 - t) / t) shingles, a the smaller size, so if a
sketch is cut into D + 1 pieces, similar sets agree in at least one whole piece. Sizes fall into bands with a number of pieces
each; a set joins in its own band and, where a similar smaller set can be in the band below, in that one too. There are a few more pieces than D + 1, so that sets
agree in a piece with bits set; empty pieces, which would bring all sets of a band together, join only sets that have too few others. A piece has 2^16
bits, few of them set, and is kept as the XOR of one random word per bit, in which equal bits cancel as they do in
the sketch. Sets that share a piece are compared: first by size, then by one short sketch of the whole set (a lower bound as well),
then exactly. The short sketch has as many bits as the set has shingles at least, as one of fewer bits than that fills up and excludes
nothing; of two lengths the longer is folded to the shorter by XOR.

Documents with equal sets are one node from the start. The members of a piece are not paired with one another but with one leader
(first within a task, then among the tasks' leaders, so a piece that a third of all sets have sends one row per task), and
components are formed of the pairs that hold. Only where a piece still has members of different components are those
compared with each other, in blocks of bounded size: a few times along a spanning forest of the possible pairs, then for
all possible pairs that still lie between components. So no link between different texts is lost, and copies make no pairs.

Defined results: a text without words (null, empty, blank) has an empty set and links with nothing, its component is its own
id; with fewer words than a shingle, the whole sequence is one shingle; rows equal in text are in one component whatever their
ids; a null id is never a component's id unless all its members have none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilcraft.llm import blocks
from veilcraft.llm.common import RollingHash, flat, mix, slices, squeezed, unsqueezed
from veilcraft.llm.components import components
from veilcraft.session import materialize

#: Bits of a piece, and least and most bits of the short sketch.
PIECE_BITS, SHORT_BITS, LONG_BITS = 16, 512, 1 << 14
#: Bits of two blocks' sketches that are multiplied at a time.
BIT_STEP = 2048
#: Random words for the bits of a piece.
BIT_WORDS = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 64, 1 << PIECE_BITS, dtype=np.uint64)
#: A task hands on its pieces when it has so many, or so many documents.
FLUSH_ROWS, FLUSH_SETS = 2 << 20, 1 << 16
KEY_BYTES = 6
#: What is left of 64 bits beside a key tells the set among those of a task (``FLUSH_SETS`` at most).
SET_BITS = np.uint64(64 - 8 * KEY_BYTES)
#: Bytes of text that are hashed at a time; a worker keeps what its largest slice needed.
TEXT_BYTES = 1 << 19
#: Sets of a piece that are compared in one place at a time.
BLOCK = 1024
#: How often possible pairs that tie the components of a piece are tried before all that are left.
FOREST_ROUNDS = 2


@dataclass(frozen=True)
class Bands:
    """Size bands for a similarity of ``percent``; sizes below ``first`` are similar to equal sets only."""

    percent: int

    @property
    def first(self) -> int:
        return -(-self.percent // (100 - self.percent))

    def differing(self, size: int) -> int:
        """How many shingles a set of this size and a similar, larger one can differ in."""
        return size * (100 - self.percent) // self.percent

    def edges(self, most: int) -> np.ndarray:
        """Where bands begin, up to beyond ``most``."""
        ratio, out = max(1.5, 130 / self.percent), [self.first]
        while out[-1] <= most:
            out.append(int(out[-1] * ratio) + 1)
        return np.array(out)

    def of(self, size: int) -> list[tuple[int, int]]:
        """The bands in which a set of this size takes part, each with its number of pieces."""
        if size < self.first:
            return []
        edges = self.edges(size)
        own = int(np.searchsorted(edges, size, "right")) - 1
        bands = [own]
        if own and size <= (int(edges[own]) - 1) * 100 // self.percent:
            bands.append(own - 1)
        return [(band, self.pieces(int(edges[band + 1]) - 1)) for band in bands]

    def pieces(self, size: int) -> int:
        """Pieces of a band up to ``size``: one more than similar sets differ in, and four times as many more as are empty by chance."""
        least = self.differing(size) + 1
        return least + math.ceil(4 * least * math.exp(-size / least))


def word_bounds(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of several texts laid end to end, and the first word of each text (one more at the end)."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    cut = np.zeros(len(data) + 1, bool)
    cut[starts] = True
    inner = ~blank
    first = np.flatnonzero(inner & (np.concatenate(([True], blank[:-1])) | cut[:-1]))
    last = np.flatnonzero(inner & (np.concatenate((blank[1:], [True])) | cut[1:])) + 1
    return first, last, np.searchsorted(first, starts)


def lowered(data: np.ndarray) -> np.ndarray:
    """A to Z in lower case, every other byte as it is."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    data, starts = flat(texts)
    data = lowered(data)
    first, last, of_text = word_bounds(data, starts)
    hashes = RollingHash(data).of(first, last)
    rows = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k in range(words):
        rows = mix(rows + hashes[k : k + len(rows)])
    for begin, end in zip(of_text[:-1], of_text[1:]):
        if end - begin >= words:
            found = np.sort(rows[begin : end - words + 1])
            yield found[np.concatenate(([True], found[1:] != found[:-1]))]
        elif end > begin:
            whole = np.uint64(end - begin)
            for one in hashes[begin:end]:
                whole = mix(np.array([whole + one], np.uint64))[0]
            yield np.array([whole], np.uint64)
        else:
            yield hashes[:0]


def pieces(found: np.ndarray, band: int, count: int, differing: int) -> np.ndarray:
    """The sketch of a set in ``count`` pieces, each as one number that tells band, place and bits; empty pieces only if they are needed.

    A piece without bits is the same in every set that has it. A set with more pieces with bits than it can differ in
    from a similar larger one (``differing``) agrees with that, and with similar smaller ones, in one of those: the
    smaller of two sets bounds the difference. Two similar sets that both have fewer meet in their empty pieces.
    """
    bits = np.zeros(count, np.uint64)
    np.bitwise_xor.at(bits, ((found & np.uint64(0xFFFFFFFF)) % np.uint64(count)).astype(np.int64), BIT_WORDS[(found >> np.uint64(64 - PIECE_BITS)).astype(np.int64)])
    place = np.arange(count, dtype=np.uint64)
    if np.count_nonzero(bits) > differing:
        place = place[bits != 0]
    return mix(mix(place + np.uint64((band + 1) << 32)) ^ bits[place.astype(np.int64)]) >> np.uint64(64 - 8 * KEY_BYTES)


def short_sketch(found: np.ndarray) -> np.ndarray:
    bits = min(max(SHORT_BITS, 1 << max(0, len(found) - 1).bit_length()), LONG_BITS)
    parity = np.bincount(((found >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def folded(sketches: np.ndarray, size: int) -> np.ndarray:
    """Rows of words folded to ``size`` words: the sketch with so many bits."""
    return np.bitwise_xor.reduce(sketches.reshape(len(sketches), -1, size), axis=1)


def apart(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """In how many bits each row of words on the left differs from each on the right."""
    size = min(left.shape[1], right.shape[1])
    left, right = (folded(side, size).view(np.uint8) for side in (left, right))
    equal = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, left.shape[1], BIT_STEP // 8):
        x, y = (1 - 2 * np.unpackbits(side[:, at : at + BIT_STEP // 8], axis=1).astype(np.float32) for side in (left, right))
        equal += x @ y.T
    return (64 * size - equal) / 2


def _folded(sketch: Column, size: Column) -> Column:
    part = lambda k: F.slice(sketch, k * size + 1, size)
    rest = F.aggregate(F.sequence(F.lit(1), (F.size(sketch) / size).cast("int") - 1), F.slice(sketch, F.lit(1), size), lambda x, k: F.zip_with(x, part(k), lambda u, v: u.bitwiseXOR(v)))
    return F.when(F.size(sketch) <= size, sketch).otherwise(rest)


def set_name(found: np.ndarray) -> int:
    """One number for a set."""
    return int(mix(np.array([found.sum(dtype=np.uint64) + np.uint64(len(found))], np.uint64)).view(np.int64)[0])


DOC_COLUMNS = "text_hash long, n_shingles long, set_id long, sketch array<long>"
PIECE_COLUMNS = "bucket int, keys binary, owners binary, sets array<long>, star_key array<long>, star_a array<long>, star_b array<long>"


def stars(keys: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For sorted keys: which rows lead (the first of each key), and (key, leader, member) for other rows with another set."""
    leads = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
    leader = sets[np.maximum.accumulate(np.where(leads, np.arange(len(keys)), 0))] if len(keys) else sets
    member = leader != sets
    return leads, keys[member], leader[member], sets[member]


def packed(entries: np.ndarray, names: np.ndarray, buckets: int) -> Iterator[dict]:
    """The rows of a task by bucket of the key: sorted keys as byte planes, which compress, and short numbers for their sets.

    An entry is a key with the number of its set below it, and is sorted in place, so that nothing but one bucket is held twice.
    """
    entries.sort()
    width = -(-(1 << 8 * KEY_BYTES) // buckets)
    edges = [*np.searchsorted(entries, np.array([bucket * width for bucket in range(buckets)], np.uint64) << SET_BITS), len(entries)]
    for bucket, (begin, end) in enumerate(zip(edges, edges[1:])):
        if begin == end:
            continue
        keys, numbers = entries[begin:end] >> SET_BITS, (entries[begin:end] & np.uint64((1 << int(SET_BITS)) - 1)).astype(np.int64)
        leads, key, leader, member = stars(keys, names[numbers])
        leading, owners = np.unique(numbers[leads], return_inverse=True)
        planes = keys[leads].view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].T
        yield {
            "bucket": bucket, "keys": planes.tobytes(), "owners": owners.astype(np.uint16).tobytes(), "sets": names[leading],
            "star_key": key.view(np.int64), "star_a": leader, "star_b": member,
        }


def signatures(docs: DataFrame, words: int, bands: Bands, buckets: int) -> DataFrame:
    """A row per document (n_shingles, set_id, sketch), and rows that hold the pieces of a task's documents by bucket."""
    wanted = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    id_type = wanted.schema["doc_id"].dataType
    schema = f"doc_id {id_type.simpleString()}, {DOC_COLUMNS}, {PIECE_COLUMNS}"
    arrow = [
        ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.int64()), ("sketch", pa.list_(pa.int64())), ("bucket", pa.int32()), ("keys", pa.binary()),
        ("owners", pa.binary()), ("sets", pa.list_(pa.int64())), ("star_key", pa.list_(pa.int64())), ("star_a", pa.list_(pa.int64())), ("star_b", pa.list_(pa.int64())),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: list[np.ndarray] = []
        sets: list[int] = []
        waiting, id_field = 0, pa.field("doc_id", pa.int64())

        def rows(count: int, columns: dict) -> pa.RecordBatch:
            arrays = [columns.get(name, pa.nulls(count, kind)) for name, kind in [("doc_id", id_field.type), *arrow]]
            return pa.RecordBatch.from_arrays(arrays, [id_field.name, *(name for name, _ in arrow)])

        def flush() -> Iterator[pa.RecordBatch]:
            held, names = np.concatenate(entries), np.array(sets, np.int64)
            entries.clear(), sets.clear()
            found = packed(held, names, buckets)
            while part := list(islice(found, 32)):
                yield rows(len(part), {name: pa.array([row[name] for row in part], kind) for name, kind in arrow[4:]})

        for batch in batches:
            id_field = batch.schema.field("doc_id")
            for part in slices(batch, "text", TEXT_BYTES):
                sizes, names, sketches = [], [], []
                for found in shingle_sets(part.column("text"), words):
                    name = set_name(found) if len(found) else None
                    if entries and (waiting >= FLUSH_ROWS or len(sets) == FLUSH_SETS):
                        yield from flush()
                        waiting = 0
                    if bands_of := bands.of(len(found)):
                        own = np.concatenate([pieces(found, band, count, bands.differing(len(found))) for band, count in bands_of])
                        entries.append((own << SET_BITS) | np.uint64(len(sets)))
                        sets.append(name)
                        waiting += len(own)
                    sizes.append(len(found)), names.append(name), sketches.append(short_sketch(found))
                columns = {"n_shingles": pa.array(sizes, pa.int64()), "set_id": pa.array(names, pa.int64()), "sketch": pa.array(sketches, pa.list_(pa.int64()))}
                yield rows(part.num_rows, columns | {name: part.column(name) for name in ("doc_id", "text_hash")})
        if entries:
            yield from flush()

    return wanted.mapInArrow(run, schema)


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(row["keys"], np.uint8).reshape(KEY_BYTES, -1).T
    keys = np.zeros((len(planes), 8), np.uint8)
    keys[:, :KEY_BYTES] = planes
    return keys.view(np.uint64).ravel(), np.array(row["sets"], np.int64)[np.frombuffer(row["owners"], np.uint16)]


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(star_key, star_a, star_b) of the tasks' leaders, for all buckets of a partition."""
    held: dict[int, list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            held.setdefault(row["bucket"], []).append(unpack(row))
    for parts in held.values():
        keys, sets = (np.concatenate(column) for column in zip(*parts))
        order = np.argsort(keys, kind="stable")
        _, key, leader, member = stars(keys[order], sets[order])
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(leader), pa.array(member)], ["star_key", "star_a", "star_b"])


def forest(near: np.ndarray, left: np.ndarray, right: np.ndarray, labels: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the possible pairs (rows of ``left``, of ``right``), enough to connect all labels that they connect."""
    draw = np.random.Generator(np.random.PCG64([seed, len(left), len(right)]))
    names, number = np.unique(labels, return_inverse=True)
    done, rows, columns = np.zeros(len(names), bool), [], []
    place, other = np.full(len(labels), -1), np.full(len(labels), -1)
    place[left], other[right] = np.arange(len(left)), np.arange(len(right))
    order = np.argsort(number, kind="stable")
    edges = np.searchsorted(number[order], np.arange(len(names) + 1))
    for start in draw.permutation(len(names)):
        if done[start]:
            continue
        done[start], waiting = True, [start]
        while waiting:
            label = waiting.pop()
            for member in draw.permutation(order[edges[label] : edges[label + 1]]):
                for found, at in ((right, near[place[member]]) if place[member] >= 0 else (right[:0], None), (left, near[:, other[member]]) if other[member] >= 0 else (left[:0], None)):
                    if at is None:
                        continue
                    met = np.flatnonzero(at)
                    met = draw.permutation(met[~done[number[found[met]]]])
                    fresh, first = np.unique(number[found[met]], return_index=True)
                    done[fresh] = True
                    waiting += fresh.tolist()
                    for k in met[first]:
                        rows.append(place[member] if found is right else k)
                        columns.append(k if found is right else other[member])
    return np.array(rows, np.int64), np.array(columns, np.int64)


class Join:
    """The steps of one join; intermediate tables are in the shared folder."""

    def __init__(self, docs: DataFrame, words: int, percent: int):
        self.docs, self.words, self.bands, self.spark = docs, words, Bands(percent), docs.sparkSession
        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        signed = materialize(signatures(docs, words, self.bands, 4 * partitions), "jaccard-signatures")
        self.rows = signed.where("bucket is null").select("doc_id", "text_hash", "n_shingles", "set_id", "sketch")
        blobs = signed.where("bucket is not null")
        local = blobs.select(F.explode(F.arrays_zip("star_key", "star_a", "star_b")).alias("s")).select("s.*")
        across = blobs.select("bucket", "keys", "owners", "sets").repartition(partitions, "bucket").mapInArrow(met, "star_key long, star_a long, star_b long")
        self.stars = materialize(local.unionByName(across).toDF("key", "a", "b"), "jaccard-stars")
        sets = self.rows.where("set_id is not null").groupBy("set_id").agg(
            F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.min(F.struct("doc_id", "text_hash")).alias("at")
        )
        self.sets = materialize(sets, "jaccard-nodes")

    def similar(self, shared: Column, n_a: Column, n_b: Column) -> Column:
        return 100 * shared >= self.bands.percent * (n_a + n_b - shared)

    def possible(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that sizes and short sketches do not exclude, with the sizes."""
        sized = self.sets.select("set_id", "n", "sketch")
        for side in "ab":
            pairs = pairs.join(sized.toDF(side, f"n_{side}", f"sketch_{side}"), side)
        size = F.least(F.size("sketch_a"), F.size("sketch_b"))
        differing = F.aggregate(F.zip_with(_folded(F.col("sketch_a"), size), _folded(F.col("sketch_b"), size), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
        smaller, larger = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
        close = (100 * smaller >= self.bands.percent * larger) & (differing * self.bands.percent <= smaller * (100 - self.bands.percent))
        return pairs.where(close).select("a", "b", "n_a", "n_b")

    def between(self, members: DataFrame, seed: int | None = None, sets_only: bool = False) -> DataFrame:
        """Pairs (a, b) of a piece's members (key, set_id, label, n, sketch) with different labels that sizes and sketches allow.

        Members meet in blocks, and no row leaves for a pair that is not possible. With a seed, of all possible pairs of a block
        only those of a spanning forest leave, as many as labels at most. With ``sets_only``, the sets that have a possible
        partner leave, each paired with itself.
        """
        percent = self.bands.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in blocks.groups(batches):
                low, block = group["low"][0].as_py(), group["block"].to_numpy()
                sets, labels, sizes = (group[name].to_numpy() for name in ("set_id", "label", "n"))
                left, right = np.flatnonzero(block == low), np.flatnonzero(block == group["high"][0].as_py())
                differing = np.zeros((len(left), len(right)), np.float32)
                words = group["sketch"].combine_chunks()
                lengths, flat_words = words.value_lengths().to_numpy(zero_copy_only=False), words.flatten().to_numpy()
                begins = np.concatenate(([0], np.cumsum(lengths)))
                for x_size in np.unique(lengths[left]):
                    for y_size in np.unique(lengths[right]):
                        x, y = np.flatnonzero(lengths[left] == x_size), np.flatnonzero(lengths[right] == y_size)
                        x_words, y_words = (flat_words[begins[rows][:, None] + np.arange(size)] for rows, size in ((left[x], x_size), (right[y], y_size)))
                        differing[np.ix_(x, y)] = apart(x_words, y_words)
                smaller, larger = (least(sizes[left][:, None], sizes[right][None, :]) for least in (np.minimum, np.maximum))
                near = (labels[left][:, None] != labels[right][None, :]) & (100 * smaller >= percent * larger) & (differing * percent <= smaller * (100 - percent))
                if sets_only:
                    x = y = np.unique(np.concatenate((sets[left[near.any(axis=1)]], sets[right[near.any(axis=0)]])))
                else:
                    rows, columns = np.nonzero(near) if seed is None else forest(near, left, right, labels, seed)
                    x, y = sets[left[rows]], sets[right[columns]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

        return blocks.in_order(blocks.dealt(members, "set_id", BLOCK)).mapInArrow(run, "a long, b long")

    def shingles(self, wanted: DataFrame) -> DataFrame:
        """(set_id, shingles) of the sets wanted, from the texts."""
        places = self.sets.join(wanted, "set_id").select("set_id", F.col("at.doc_id").alias("at_id"), F.col("at.text_hash").alias("at_hash"))
        keyed = squeezed(self.docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")))
        texts = keyed.join(places, (F.col("text_hash") == F.col("at_hash")) & F.col("doc_id").eqNullSafe(F.col("at_id"))).select("set_id", "squeezed")
        words = self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 64):
                    part = batch.slice(start, 64)
                    whole = pa.array([unsqueezed(z) for z in part.column("squeezed").to_pylist()], pa.large_binary()).cast(pa.large_string())
                    found = [x.view(np.int64) for x in shingle_sets(whole, words)]
                    yield pa.RecordBatch.from_arrays([part.column("set_id"), pa.array(found, pa.list_(pa.int64()))], ["set_id", "shingles"])

        return texts.mapInArrow(run, "set_id long, shingles array<long>").dropDuplicates(["set_id"])

    def links(self, pairs: DataFrame, whole: DataFrame | None = None) -> DataFrame:
        """Those of the pairs (a, b) that hold, by their whole sets."""
        pairs = materialize(self.possible(pairs), "jaccard-pairs")
        if pairs.isEmpty():
            return pairs.select("a", "b")
        if whole is None:
            whole = self.shingles(pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct())
        both = pairs.join(whole.toDF("a", "of_a"), "a").join(whole.toDF("b", "of_b"), "b")
        shared = F.size(F.array_intersect("of_a", "of_b"))
        return both.where(self.similar(shared, F.col("n_a"), F.col("n_b"))).select("a", "b")

    def components(self) -> DataFrame:
        """(node, component) over set ids, for sets that link with another."""
        ordered = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        tried = self.stars.select(*ordered).distinct()
        links = materialize(self.links(tried), "jaccard-links")
        known = materialize(components(links), "jaccard-components")
        members = self.stars.select("key", F.explode(F.array("a", "b")).alias("set_id")).distinct()
        members = self.mixed(members, known)
        if members.isEmpty():
            return known
        # members of one piece in different components meet: first some possible pairs that tie most of them, then all that are left
        members = members.drop("label").join(self.sets.select("set_id", "n", "sketch"), "set_id")
        members = materialize(members, "jaccard-open")
        # most members have no possible partner left; whole sets are written of the others alone
        possible = self.between(self.mixed(members, known), sets_only=True).select(F.col("a").alias("set_id")).distinct()
        possible = materialize(possible, "jaccard-possible")
        members = materialize(members.join(possible, "set_id"), "jaccard-open")
        whole = materialize(self.shingles(possible), "jaccard-sets")
        for seed in (*range(FOREST_ROUNDS), None):
            still = self.mixed(members, known)
            if still.isEmpty():
                break
            pairs = materialize(self.between(still, seed).distinct().join(tried, ["a", "b"], "left_anti"), "jaccard-tried")
            if pairs.isEmpty():
                continue
            more = materialize(self.links(pairs, whole), "jaccard-links")
            tried = tried.union(pairs)
            if not more.isEmpty():
                links = links.union(more)
                known = materialize(components(links), "jaccard-components")
        return known

    def mixed(self, members: DataFrame, known: DataFrame) -> DataFrame:
        """The members (key, set_id, ...) of pieces that have members of several components, with the component as ``label``."""
        labels = known.toDF("set_id", "label")
        labelled = members.join(labels, "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
        several = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n")).where("x <> y and n > 2")
        return materialize(labelled.join(several.select("key"), "key"), "jaccard-mixed")

    def classes(self) -> DataFrame:
        """(set_id, component_id): the least document id of each component."""
        found = self.components()
        named = self.rows.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least"))
        named = named.join(found.toDF("set_id", "component"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
        named = materialize(named, "jaccard-classes")
        least = named.groupBy("component").agg(F.min("least").alias("component_id"))
        return named.join(least, "component").select("set_id", "component_id")


def renamed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the least id reachable by links) of every document."""
    join = Join(renamed(docs, id_column, text_column), words, percent)
    rows = join.rows.join(join.classes(), "set_id", "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One document of each component, with its columns: the least by id and text; documents without words all stay."""
    join = Join(renamed(docs, id_column, text_column), words, percent)
    found = join.components().toDF("set_id", "component")
    rows = join.rows.where("set_id is not null").join(found, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    least = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), "text_hash")).alias("at"))
    places = materialize(least.select(F.col("at.doc_id").alias("__at_id"), F.col("at.text_hash").alias("__at_hash")), "jaccard-kept")
    keyed = docs.withColumn("__text_hash", F.xxhash64(text_column))
    wordless = ~F.coalesce(F.col(text_column).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = keyed.where(~wordless).join(places, (F.col("__text_hash") == F.col("__at_hash")) & F.col(id_column).eqNullSafe(F.col("__at_id")))
    once = kept.dropDuplicates(["__at_id", "__at_hash"]).select(*docs.columns)
    return once.unionByName(docs.where(wordless))
