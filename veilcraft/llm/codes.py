"""Compressing vectors to short codes with per-dimension value dictionaries.

Components become integers, ``floor(scale * x)``, and a vector is cut into ``parts`` equal parts; each part position has a codebook
of at most ``entries`` entries, and a part's code is the number of its nearest entry. The integers of one dimension take few
distinct values, so a task keeps a dictionary of them for each dimension, tabulates the squared difference of every distinct
integer to all entries, and a part's distances are rows of these tables, gathered by dictionary code and added up.

Codebooks begin as the parts of the vectors of least id and are moved ``rounds`` times to the floored means of the parts nearest
to them. A task adds its sums per entry before the shuffle; what comes to the driver and goes back to the tasks are the codebooks,
``entries`` times the length of a vector, whatever the number of rows. The integers are written once, so that every pass reads
the same ones.

Defined results: rows whose vector is null, holds a null or non-finite component, has no component, a length that ``parts`` does
not divide, or another length than the first kept vector, are dropped. Vectors of least id: equal ids in the order of their
integers, null ids last; fewer rows than ``entries`` make smaller codebooks. Integers are held within ``LIMIT`` either way,
which keeps every error in a long; a label's sum beyond a long is null. Equal rows are rows of their own; equal labels count
together, null ones too; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilcraft.session import materialize

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
LIMIT = 1 << 24
#: Rows whose distances to all entries are held at a time.
SLICE_ROWS = 4096


@dataclass
class Codebooks:
    """Entries by part, number and position within the part."""

    entries: np.ndarray

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every vector and part the number of the nearest entry (ties: the lower) and its squared distance."""
        parts, count, width = self.entries.shape
        codes, errors = np.zeros((len(vectors), parts), np.int64), np.zeros((len(vectors), parts), np.int64)
        for part in range(parts):
            distance = np.zeros((len(vectors), count), np.int64)
            for place in range(width):
                values, code = np.unique(vectors[:, part * width + place], return_inverse=True)
                table = (values[:, None] - self.entries[part, :, place]) ** 2
                distance += table[code.ravel()]
            codes[:, part] = distance.argmin(axis=1)
            errors[:, part] = distance.min(axis=1)
        return codes, errors

    def moved(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> Codebooks:
        """Entries at the floored means of their parts; entries without parts stay."""
        entries = self.entries.copy()
        for (part, entry), (count, total) in sums.items():
            entries[part, entry] = [x // count for x in total]
        return Codebooks(entries)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integers(vectors: DataFrame, vector_column: str, parts: int, scale: int) -> DataFrame:
    """The rows of (id, label, vector) with usable vectors, as integers in ``v``."""
    x = F.col(vector_column)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    usable = x.isNotNull() & (F.size(x) > 0) & (F.size(x) % parts == 0) & finite
    whole = F.transform(x, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int"))
    return vectors.where(usable).withColumn("v", whole).drop(vector_column)


def rows_of(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for at in range(0, batch.num_rows, SLICE_ROWS):
        part = batch.slice(at, SLICE_ROWS)
        yield part, part.column("v").flatten().to_numpy().astype(np.int64).reshape(-1, width)


def part_sums(kept: DataFrame, books: Codebooks) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Count and component sums of the parts nearest to every entry: at most one row per entry from each task."""
    parts, count, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * count, width), np.int64), np.zeros(parts * count, np.int64)
        for batch in batches:
            for _, vectors in rows_of(batch, parts * width):
                codes, _ = books.nearest(vectors)
                flat = (codes + np.arange(parts) * count).ravel()
                counts += np.bincount(flat, minlength=parts * count)
                np.add.at(sums, flat, vectors.reshape(-1, width))
        used = np.flatnonzero(counts)
        columns = [used // count, used % count, counts[used], *sums[used].T]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "entry", "n", *(f"s{k}" for k in range(width))])

    schema = "part long, entry long, n long, " + ", ".join(f"s{k} long" for k in range(width))
    total = kept.select("v").mapInArrow(run, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(f"s{k}").alias(f"s{k}") for k in range(width)))
    return {(r["part"], r["entry"]): (r["n"], [r[f"s{k}"] for k in range(width)]) for r in total.collect()}


def train(kept: DataFrame, id_column: str, parts: int, entries: int, rounds: int) -> Codebooks:
    """Codebooks of rows with integers ``v`` of one length."""
    first = kept.orderBy(F.col(id_column).asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = Codebooks(np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        books = books.moved(part_sums(kept, books))
    return books


def compress(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", parts: int = PARTS, entries: int = ENTRIES,
    rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, code, error) of every usable vector, and the codebooks; ``code`` holds a byte per part. None for no vectors."""
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: entries must be 1 to 256")
    named = vectors.select(F.col(id_column).alias("vec_id"), F.col(label_column).alias("label"), F.col(vector_column).alias("vector"))
    kept = materialize(integers(named, "vector", parts, scale), "code-integers")
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v").alias("n")).first()
    id_type, label_type = (kept.schema[name].dataType.simpleString() for name in ("vec_id", "label"))
    schema = f"vec_id {id_type}, label {label_type}, code binary, error long"
    if first is None:
        return kept.select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")), None
    kept = kept.where(F.size("v") == first["n"])
    books = train(kept, "vec_id", parts, entries, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rows in rows_of(batch, first["n"]):
                codes, errors = books.nearest(rows)
                packed = pa.array([row.tobytes() for row in codes.astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), packed, pa.array(errors.sum(axis=1))], ["vec_id", "label", "code", "error"])

    return kept.mapInArrow(run, schema), books


def code_digests(vectors: DataFrame) -> DataFrame:
    """vec_id, code (hexadecimal), error, label_error and codebooks_sha256 of every usable vector."""
    coded, books = compress(vectors)
    coded = materialize(coded, "codes")
    # written before they are joined, so that Spark knows their size and can split a label that most rows have
    totals = materialize(coded.groupBy(F.col("label").alias("of_label")).agg(F.try_sum("error").alias("label_error")), "code-labels")
    out = coded.join(totals, F.col("label").eqNullSafe(F.col("of_label")), "left")
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256() if books else "").alias("codebooks_sha256"))


def decoded(codes: DataFrame, books: Codebooks) -> DataFrame:
    """The integers that the codes of (…, code) stand for, in ``v``."""
    table = F.array(*(F.array(*(F.array(*(F.lit(x) for x in entry)) for entry in part)) for part in books.entries.tolist()))
    place = F.transform(F.sequence(F.lit(1), F.octet_length("code")), lambda i: F.element_at(F.element_at(table, i), F.conv(F.hex(F.substring(F.col("code"), i, F.lit(1))), 16, 10).cast("int") + 1))
    return codes.withColumn("v", F.flatten(place))
