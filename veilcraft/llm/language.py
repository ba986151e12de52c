"""Language identification by character language models.

One interpolated Kneser-Ney model per language over letters and word gaps. The n-grams of all languages share one sorted
array of 64-bit hashes per order; beside each hash stands a row with each language's log probability (and back-off weight),
so one binary search serves every language. A text is scored in all models; the language of the lowest cross-entropy per
character wins. Its confidence is the softmax of minus the cross-entropies, sharpened by a factor fitted on pieces that
the models did not see. Rejection is calibrated on the same pieces: by length, a text is rejected when its
cross-entropy lies far above what pieces of its own language reach, that is, when no model explains it.

Training reads a bounded sample: pieces of ``PIECE_CHARS`` code points of labelled texts, chosen by the hash of their text so
that each language gives about ``sample_chars`` / languages characters. Hence n-grams, and what is sent to the tasks, are
bounded however large the corpus is. Prediction reads every text whole, a long one in parts, with the text alone.

Defined results: a text that is null or has no letter is ``und`` with score 0 and rejected; without any labelled text every
result is ``und``; ties go to the first language by name; repeated rows get equal results; other columns pass through.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilcraft.llm.common import mix, slices

ORDER = 4
PIECE_CHARS = 4_000
SAMPLE_CHARS = 1_500_000
UNKNOWN = "und"
#: Code points scored at a time.
PART_CHARS = 1 << 19
#: Lengths, in letters and gaps, by which rejection is calibrated.
LENGTHS = (8, 16, 32, 64, 128, 256, 512, 1024, 2048)
#: A text is rejected beyond the worst calibration piece of its length by this share and this many nats per character.
SLACK_SHARE, SLACK_NATS = 0.15, 0.5
GAP = ord(" ")


@lru_cache(1)
def letter_table() -> np.ndarray:
    """For each code point its lower-case letter; a gap for whatever is no letter."""
    table = np.full(0x110000, GAP, np.uint32)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            table[point] = ord(low) if len(low) == 1 else point
        elif unicodedata.category(char) in ("Mn", "Mc"):
            table[point] = point  # vowel signs and accents belong to their letters
    return table


@lru_cache(1)
def mark_table() -> np.ndarray:
    """Which code points the letter table keeps without being letters."""
    kept = np.flatnonzero(letter_table() != GAP)
    table = np.zeros(0x110000, bool)
    table[kept] = [not chr(point).isalpha() for point in kept]
    return table


def normal_form(text: str) -> np.ndarray:
    """Letters in lower case, each run of other characters as one gap, with a gap at both ends."""
    points = letter_table()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    gap = points == GAP
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]
    points = points[keep]
    if len(points) and points[0] == GAP:
        points = points[1:]
    if len(points) and points[-1] == GAP:
        points = points[:-1]
    if (mark_table()[points] | (points == GAP)).all():
        return points[:0]
    return np.concatenate(([GAP], points, [GAP])).astype(np.uint32)


def gram_hashes(points: np.ndarray, order: int) -> np.ndarray:
    """The hash of each run of ``order`` characters."""
    count = max(0, len(points) - order + 1)
    out = np.zeros(count, np.uint64)
    for k in range(order):
        out = out * np.uint64(0x100000001B3) + points[k : k + count]
    return mix(out)


@dataclass
class Models:
    """Per order the sorted hashes of n-grams, and a row per hash: log probability and log back-off of each language."""

    languages: list[str]
    keys: list[np.ndarray]
    log_p: list[np.ndarray]
    backoff: list[np.ndarray]
    unseen: np.ndarray
    sharpness: float = 1.0
    limits: np.ndarray | None = None

    def find(self, order: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.keys[order - 1]
        if not len(keys):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return at, keys[at] == hashes

    def log_probabilities(self, points: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log probability of each character from the ``order``-th on, a column per language."""
        hashes = gram_hashes(points, order)
        at, known = self.find(order, hashes)
        out = self.log_p[order - 1][at] if len(self.keys[order - 1]) else np.zeros((len(hashes), len(self.languages)), np.float32)
        missing = np.flatnonzero(~known)
        if len(missing):
            if order == 1:
                out[missing] = self.unseen
            else:
                runs = np.lib.stride_tricks.sliding_window_view(points, order)[missing]
                out[missing] = self._backed_off(runs, order)
        return out

    def _backed_off(self, runs: np.ndarray, order: int) -> np.ndarray:
        """For n-grams that no language has: the next lower order, after the back-off of their context."""
        lower = row_hashes(runs[:, 1:])
        at, known = self.find(order - 1, lower)
        out = np.empty((len(runs), len(self.languages)), np.float32)
        out[known] = self.log_p[order - 2][at[known]]
        rest = np.flatnonzero(~known)
        if len(rest):
            out[rest] = self._backed_off(runs[rest, 1:], order - 1) if order > 2 else self.unseen
        at, known = self.find(order - 1, row_hashes(runs[:, :-1]))
        out[known] += self.backoff[order - 2][at[known]]
        return out

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character of each text in each language, and the number of characters (0: no letter)."""
        sums, sizes = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        lead = np.full(ORDER - 1, GAP, np.uint32)
        for i, text in enumerate(texts):
            tail = lead
            for start in range(0, len(text), PART_CHARS):
                points = normal_form(text[start : start + PART_CHARS])
                if len(points):
                    points = np.concatenate((tail, points[1:] if tail[-1] == GAP else points))
                    sums[i] -= self.log_probabilities(points).sum(axis=0, dtype=np.float64)
                    sizes[i] += len(points) - len(tail)
                    tail = points[-(ORDER - 1):]
        return sums / np.maximum(sizes, 1)[:, None], sizes

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and rejection of each text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
        entropies, sizes = self.cross_entropies(texts)
        best = entropies.argmin(axis=1)
        lowest = entropies[np.arange(len(texts)), best]
        share = 1 / np.exp(-self.sharpness * (entropies - lowest[:, None])).sum(axis=1)
        empty = sizes == 0
        names = [UNKNOWN if none else self.languages[b] for none, b in zip(empty, best)]
        rejected = empty if self.limits is None else empty | (lowest > self.limits[length_class(sizes)])
        return names, np.where(empty, 0.0, share), np.where(empty, 0.0, lowest), rejected


def row_hashes(runs: np.ndarray) -> np.ndarray:
    out = np.zeros(len(runs), np.uint64)
    for k in range(runs.shape[1]):
        out = out * np.uint64(0x100000001B3) + runs[:, k]
    return mix(out)


def length_class(sizes: np.ndarray) -> np.ndarray:
    return np.clip(np.searchsorted(LENGTHS, sizes, "right") - 1, 0, len(LENGTHS) - 1)


def estimate(languages: list[str], grams: np.ndarray, language: np.ndarray, counts: np.ndarray) -> Models:
    """Interpolated Kneser-Ney from counts of ``ORDER``-grams (rows of code points) per language.

    Lower orders count distinct left neighbours instead of occurrences. Each order takes a discount n1 / (n1 + 2 n2) off each
    count and gives it to the next lower order; below single characters stands an even share for ``letters + 1`` characters.
    """
    models = Models(languages, [], [], [], np.zeros(len(languages), np.float32))
    tables = []
    for order in range(ORDER, 0, -1):
        tables.append((order, grams, language, counts))
        runs, at = np.unique(np.column_stack((language.astype(np.uint32), grams[:, 1:])), axis=0, return_counts=True)
        grams, language, counts = runs[:, 1:], runs[:, 0].astype(np.int64), at
    width = len(languages)
    for order, grams, language, counts in reversed(tables):
        hashes = row_hashes(grams)
        keys, row = np.unique(hashes, return_inverse=True)
        table = np.zeros((len(keys), width))
        table[row, language] = counts
        once, twice = (table == 1).sum(axis=0), (table == 2).sum(axis=0)
        discount = np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.95)
        first = np.zeros(len(keys), np.int64)
        first[row] = np.arange(len(row))
        kept = np.maximum(table - discount, 0)
        if order == 1:
            total = np.maximum(table.sum(axis=0), 1)
            left = np.maximum(discount * (table > 0).sum(axis=0) / total, 1e-4)
            even = left / (len(keys) + 1)
            probability, context = kept / total + even, None
            models.unseen = np.log(even).astype(np.float32)
        else:
            contexts, of = np.unique(row_hashes(grams[first][:, :-1]), return_inverse=True)
            total = np.zeros((len(contexts), width))
            kinds = np.zeros((len(contexts), width))
            np.add.at(total, of, table)
            np.add.at(kinds, of, table > 0)
            weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            lower = np.exp(lower_order(models, grams[first], order))
            probability = np.where(total[of] > 0, kept / np.maximum(total[of], 1), 0.0) + weight[of] * lower
            at, known = models.find(order - 1, contexts)
            models.backoff[order - 2][at[known]] = np.log(weight[known])
        models.keys.append(keys)
        models.log_p.append(np.log(probability).astype(np.float32))
        models.backoff.append(np.zeros((len(keys), width), np.float32))
    return models


def lower_order(models: Models, grams: np.ndarray, order: int) -> np.ndarray:
    """Log probability of the last characters by the next lower order, for n-grams of which every part is known."""
    at, known = models.find(order - 1, row_hashes(grams[:, 1:]))
    return np.where(known[:, None], models.log_p[order - 2][at], models.unseen)


def calibrate(models: Models, texts: list[str], truth: list[str]) -> None:
    """Fit the sharpness of scores and the limits of rejection on pieces that were kept out of the counts."""
    number = {name: i for i, name in enumerate(models.languages)}
    pieces, known, lengths = [], [], []
    for text, name in zip(texts, truth):
        for kind, length in enumerate(LENGTHS):
            for start in range(0, min(len(text), 4 * length), length):
                piece = text[start : start + length]
                if len(piece) == length and normal_form(piece).size:
                    pieces.append(piece), known.append(number[name]), lengths.append(kind)
    limits = np.full(len(LENGTHS), np.inf)
    if pieces:
        entropies, sizes = models.cross_entropies(pieces)
        known, kinds = np.array(known), length_class(sizes)
        own = entropies[np.arange(len(known)), known]
        for kind in range(len(LENGTHS)):
            if (kinds == kind).any():
                limits[kind] = own[kinds == kind].max() * (1 + SLACK_SHARE) + SLACK_NATS
        limits = np.maximum.accumulate(np.where(np.isinf(limits), -np.inf, limits)[::-1])[::-1]  # shorter texts vary more
        limits[limits == -np.inf] = np.inf
        gaps = entropies - own[:, None]
        losses = {s: np.log(np.exp(np.minimum(-s * gaps, 700)).sum(axis=1)).mean() for s in 2.0 ** np.arange(-1, 9)}
        models.sharpness = min(losses, key=losses.get)
    models.limits = limits


def train(docs: DataFrame, text_column: str = "text", label_column: str = "lang", sample_chars: int = SAMPLE_CHARS) -> Models:
    """Models of every label, from about ``sample_chars`` characters of the rows given; null labels and texts are skipped.

    Copies of a text with one label count once.
    """
    labelled = docs.select(F.col(text_column).alias("text"), F.col(label_column).alias("lang")).where("text is not null and lang is not null")
    hashed = labelled.withColumn("h", F.xxhash64("text"))
    distinct = hashed.groupBy("lang", "h").agg(F.max(F.length("text")).alias("size"))
    totals = {row["lang"]: row for row in distinct.groupBy("lang").agg(F.sum("size").alias("chars"), F.min(F.struct("h")).alias("least")).collect()}
    languages = sorted(totals)
    if not languages:
        return Models([], [], [], [], np.zeros(0, np.float32))
    shares = {lang: min(1.0, sample_chars / len(languages) / max(1, totals[lang]["chars"])) for lang in languages}
    share = F.create_map(*(F.lit(x) for lang in languages for x in (lang, shares[lang])))
    count = F.ceil(F.length("text") / PIECE_CHARS).cast("int")
    pieces = hashed.where("length(text) > 0").select("text", "lang", "h", F.explode(F.sequence(F.lit(0), count - 1)).alias("n"))
    draw = F.pmod(F.xxhash64("h", "n"), F.lit(1_000_003)) / 1_000_003
    least = F.create_map(*(F.lit(x) for lang in languages for x in (lang, totals[lang]["least"]["h"])))
    chosen = pieces.where((draw < share[F.col("lang")]) | ((F.col("h") == least[F.col("lang")]) & (F.col("n") == 0)))
    piece = F.substring("text", F.col("n") * PIECE_CHARS + 1, F.lit(PIECE_CHARS))
    sample = chosen.select("lang", "h", "n", piece.alias("text")).groupBy("lang", "h", "n").agg(F.min("text").alias("text")).select(
        "lang", "text",
        (F.pmod(F.xxhash64("n", "h"), F.lit(5)) == 0).alias("held_out"),
    ).toPandas()
    if not (~sample["held_out"]).any() or sample["held_out"].all():
        sample["held_out"] = False
    return fit(languages, sample)


def fit(languages: list[str], sample) -> Models:
    number = {name: i for i, name in enumerate(languages)}
    learn = sample[~sample["held_out"]]
    if set(learn["lang"]) != set(sample["lang"]):
        learn = sample
    rows = []
    for name, texts in learn.groupby("lang")["text"]:
        lead = np.full(ORDER - 1, GAP, np.uint32)
        runs = [np.lib.stride_tricks.sliding_window_view(np.concatenate((lead, points[1:])), ORDER) for text in texts if len(points := normal_form(text))]
        if runs:
            grams, counts = np.unique(np.concatenate(runs), axis=0, return_counts=True)
            rows.append((grams, np.full(len(grams), number[name]), counts))
    if not rows:
        return Models([], [], [], [], np.zeros(0, np.float32))
    models = estimate(languages, *(np.concatenate(part) for part in zip(*rows)))
    kept = sample[sample["held_out"]] if sample["held_out"].any() else sample
    calibrate(models, list(kept["text"]), list(kept["lang"]))
    return models


def identify(docs: DataFrame, models: Models, text_column: str = "text", prefix: str = "") -> DataFrame:
    """Every input column beside ``lang_pred``, ``score``, ``entropy`` and ``rejected`` (names with ``prefix``).

    Input columns of these names are replaced.
    """
    names = [f"{prefix}{name}" for name in ("lang_pred", "score", "entropy", "rejected")]
    docs = docs.drop(*names)
    place = docs.columns.index(text_column)
    shared = docs.sparkSession.sparkContext.broadcast(models)
    schema = T.StructType([*docs.schema.fields, *map(T.StructField, names, (T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_column):
                texts = [text or "" for text in part.column(place).to_pylist()]
                languages, scores, entropies, rejected = shared.value.decide(texts)
                added = [pa.array(languages, pa.string()), pa.array(scores, pa.float64()), pa.array(entropies, pa.float64()), pa.array(rejected, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], [*part.schema.names, *names])

    return docs.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, models: Models, text_column: str = "text") -> DataFrame:
    """The documents that are not rejected, with the columns they came with."""
    flagged = identify(docs, models, text_column, prefix="__lid_")
    return flagged.where("not __lid_rejected").select(*docs.columns)
