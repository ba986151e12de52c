"""Helpers the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a task holds as number arrays at a time.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(id_column: Column, folds: int) -> Column:
    """The fold of a row: crc32 of its id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and where each row starts (one more at the end); null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, ends, data = column.buffers()
    starts = np.frombuffer(ends, np.int64, len(column) + 1, column.offset * 8)
    if data is None or starts[-1] == starts[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8, starts[-1] - starts[0], starts[0]), starts - starts[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with about ``most`` bytes in ``column``; a longer text is a slice of its own."""
    ends = flat(batch.column(column))[1]
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def squeezed(docs: DataFrame) -> DataFrame:
    """The rows with ``squeezed`` in place of ``text``: its UTF-8 bytes compressed, so that a shuffle moves less; null is empty."""
    place = docs.columns.index("text")
    schema = T.StructType([T.StructField("squeezed", T.BinaryType()) if f.name == "text" else f for f in docs.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(3)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = pa.array([packer.compress((text or "").encode()) for text in part.column(place).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([texts if i == place else c for i, c in enumerate(part.columns)], [f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def unsqueezed(data: bytes) -> bytes:
    return zstandard.decompress(data)


#: An odd base of the rolling hash, and a random word for each byte.
BASE = np.uint64(0x9E3779B97F4A7C15)
BYTE_WORDS = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)


def powers(base: np.uint64, count: int) -> np.ndarray:
    """``base`` to the powers 0 to count - 1, modulo 2^64."""
    out = np.full(count, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_BACK = np.uint64(pow(int(BASE), -1, 1 << 64))
_up, _down = powers(BASE, 1 << 12), powers(_BACK, 1 << 12)


class RollingHash:
    """Hashes of any run of a byte array, from prefix sums; equal runs are equal wherever they stand."""

    def __init__(self, data: np.ndarray):
        global _up, _down
        if len(data) >= len(_up):
            size = 1 << (len(data)).bit_length()
            _up, _down = powers(BASE, size), powers(_BACK, size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_WORDS[data] * _up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of each run ``data[start:end]``."""
        return mix((self.sums[ends] - self.sums[starts]) * _down[starts])

    def windows(self, length: int) -> np.ndarray:
        """The hash of every run of ``length`` bytes."""
        count = max(0, len(self.sums) - length)
        return mix((self.sums[length : length + count] - self.sums[:count]) * _down[:count])
