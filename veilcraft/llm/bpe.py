"""Byte-level BPE by monoid tree reduction.

A text is cut into pieces by the vocabulary's pattern and each piece is encoded by itself. A piece is encoded as a tree: its
halves are encoded recursively and joined. A join re-encodes a window of tokens around the seam and widens it until both
tokens just outside provably stay: a token sequence is the encoding of its bytes exactly if every two neighbours are
(``encode(a + b) == [a, b]``), so once the pairs at the window's two edges are stable, everything beyond them is. Windows
stay a few tokens wide in ordinary text, so a piece of n bytes costs O(n log n); where a seam shifts every token behind it
(one letter repeated a million times), the doubling window costs O(n log n) once a level.

Long texts are trees as well. A position between a non-blank and a blank is a piece boundary whatever stands around it
(no alternative of the pattern crosses it, and none looks back), so parts cut there are encoded one by one and join by
concatenation; that bounds the memory of the pattern's matches, and lets words between single blanks be looked up whole. Decoding concatenates the bytes of the tokens.

Defined results: a null or empty text has no tokens; rows are independent, so repeated rows get equal results. Vocabulary and
pattern are parameters; the 50,000 ranks (under 2 MB) travel with the tasks.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilcraft.llm.common import slices

#: Pieces up to this many bytes are leaves, merged directly.
LEAF_BYTES = 12
#: Windows beyond this many bytes are merged with a heap.
SCAN_BYTES = 96
#: Code points of a long text that are matched at a time.
PART_CHARS = 1 << 18
#: Encoded pieces, and words, that a worker remembers; a memory is emptied when full.
MEMORY = 600_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ids, from lines of Base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pieces = ranks, regex.compile(pattern)
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.packed: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.stable: dict[tuple[bytes, bytes], bool] = {}

    def merged(self, piece: bytes) -> list[bytes]:
        """A leaf or window: merge the neighbours of least rank, the leftmost of equal ones, until none is in the vocabulary."""
        if len(piece) > SCAN_BYTES:
            return self.merged_by_heap(piece)
        parts, ranks = [piece[i : i + 1] for i in range(len(piece))], self.ranks
        pairs = [ranks.get(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
        while pairs:
            least = min(pairs)
            if least == _NEVER:
                break
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], _NEVER)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], _NEVER)
        return parts

    def merged_by_heap(self, piece: bytes) -> list[bytes]:
        """The same merges for a wide window: neighbours wait in a heap, and parts are linked by where they start and end."""
        ends, ranks, size = list(range(1, len(piece) + 1)), self.ranks, len(piece)
        before = list(range(-1, size))
        heap = [(rank, i, i + 2) for i in range(size - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, start, end = heappop(heap)
            middle = ends[start]
            if middle >= end or middle < 0 or ends[middle] != end:
                continue  # one of the two has been merged meanwhile
            ends[start], ends[middle] = end, -1
            if end < size:
                before[end] = start
                if (rank := ranks.get(piece[start : ends[end]])) is not None:
                    heappush(heap, (rank, start, ends[end]))
            if start and (rank := ranks.get(piece[before[start] : end])) is not None:
                heappush(heap, (rank, before[start], end))
        parts, start = [], 0
        while start < size:
            parts.append(piece[start : ends[start]])
            start = ends[start]
        return parts

    def stays(self, left: bytes, right: bytes) -> bool:
        """Whether two tokens are the encoding of their bytes."""
        pair = (left, right)
        known = self.stable.get(pair)
        if known is None:
            if len(self.stable) > MEMORY:
                self.stable.clear()
            known = self.stable[pair] = left + right not in self.ranks and self.merged(left + right) == [left, right]
        return known

    def joined(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The encoding of two neighbours from their encodings."""
        if self.stays(left[-1], right[0]):
            return left + right
        reach = 1
        while True:
            i, j = max(0, len(left) - reach), min(len(right), reach)
            reach *= 2
            window = self.merged(b"".join(left[i:] + right[:j]))
            if (i == 0 or self.stays(left[i - 1], window[0])) and (j == len(right) or self.stays(window[-1], right[j])):
                return left[:i] + window + right[j:]

    def encoded(self, piece: bytes) -> list[bytes]:
        """The tokens of one piece; the depth is logarithmic."""
        if piece in self.ranks:
            return [piece]
        if len(piece) <= LEAF_BYTES:
            return self.merged(piece)
        half = len(piece) // 2
        return self.joined(self.encoded(piece[:half]), self.encoded(piece[half:]))

    def ids_of(self, piece: str) -> bytes:
        """The ids of one piece, packed as little-endian 32-bit integers."""
        ids = np.array([self.ranks[token] for token in self.encoded(piece.encode("utf-8", "replace"))], "<u4").tobytes()
        if len(piece) <= 64:
            if len(self.packed) > MEMORY:
                self.packed.clear()
            self.packed[piece] = ids
        return ids

    def spaced_ids(self, word: str) -> bytes:
        """The ids of a blank and the text up to the next one, which begin and end where pieces do."""
        ids = b"".join([self.packed.get(piece) or self.ids_of(piece) for piece in self.pieces.findall(" " + word)])
        if len(word) <= 64:
            if len(self.spaced) > MEMORY:
                self.spaced.clear()
            self.spaced[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """All ids of a text, packed."""
        spaced, spaced_ids, parts = self.spaced.get, self.spaced_ids, []
        for part in cut(text):
            if _WIDE_BLANK.search(part):
                parts += [self.packed.get(piece) or self.ids_of(piece) for piece in self.pieces.findall(part)]
                continue
            first, *words = part.split(" ")
            parts += [self.packed.get(piece) or self.ids_of(piece) for piece in self.pieces.findall(first)]
            parts += [spaced(word) or spaced_ids(word) for word in words]
        return b"".join(parts)

    def forget(self) -> None:
        """Let go of what was found, so that a worker that goes on to other work does not keep it."""
        self.packed.clear(), self.spaced.clear(), self.stable.clear()

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_NEVER = 1 << 62
_SEAM = regex.compile(r"(?<=\S)(?=\s)")
#: A blank at the start or after another blank or line break: words cannot be told apart there by splitting at blanks.
_WIDE_BLANK = re.compile(r"^ |\s | $")


def cut(text: str, most: int = PART_CHARS) -> Iterator[str]:
    """Parts of a text that end where a piece ends in any case; a part is longer than ``most`` only if it has no such place."""
    start = 0
    while start + most < len(text):
        seam = _SEAM.search(text, start + most)
        if seam is None:
            break
        yield text[start : seam.start()]
        start = seam.start()
    yield text[start:]


@lru_cache(2)
def encoder(vocabulary: str, pattern: str) -> Encoder:
    """One encoder per Python worker; every worker finds the vocabulary in its own installation."""
    return Encoder(load_ranks(vocabulary), pattern)


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, ids (packed little-endian 32-bit integers) and decoded (the bytes they stand for) of every text."""
    wanted = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    id_type = wanted.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [coder.encode(text or "") for text in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(map(coder.decode, ids), pa.binary())], ["doc_id", "ids", "decoded"]
                )
        coder.forget()

    return wanted.mapInArrow(run, f"doc_id {id_type}, ids binary, decoded binary")


def token_digests(docs: DataFrame, vocabulary: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the packed ids and of the decoded bytes."""
    coded = encode_documents(docs, vocabulary, pattern, id_column, text_column)
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
