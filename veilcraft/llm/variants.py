"""Grouping spelling variants with bit-sliced position indexes.

Two words are near if one inserted, deleted or replaced code point makes one the other. Words are looked up in an index that holds,
for every position and letter, a bitset of the words with that letter there. One pass over a query's letters keeps three bitsets
up to date with a few word-wide operations: the words that agree so far (no error), those with one other letter, and those with
one letter more, which are read one position further on. Every 64 words are one machine word, and all queries of a shape are
advanced together.

The vocabulary grows with the corpus, so an index holds only words that share a part. For the ``m`` letters of the shorter word of
a pair, either its first half or its second half is untouched: words of ``m`` and ``m + 1`` letters meet by first half and by second
half. A group of more than ``GROUP`` words is split the same way: half of what is not yet known joins the known letters, on the
left or on the right. So every pair meets in exactly one group (to the left if the words agree that far), and groups shrink until
at most one letter is open, where the alphabet bounds them. What leaves a group is a count and the best near word of each
word, never the pairs.

Defined results: null and empty words are left out; a word given more than once counts with the sum of its counts; ties of count go
to the word that is first in code-point order; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilcraft.session import materialize

GROUP = 1 << 13
#: A form is at least so many times as frequent as its variant.
RATIO = 10
#: Pairs of a query and 64 words that are advanced at a time, and table cells of one position.
STEP, CELLS = 1 << 17, 1 << 20
LETTERS = r"[A-Za-zÀ-ÿ]"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SHAPE = ["m", "p", "s", "open", "known"]


def runs(docs: DataFrame, least: int, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` once per run of at least ``least`` letters of the text, in ``run``, with A to Z in lower case."""
    found = F.regexp_extract_all(F.translate(text_column, _UPPER, _UPPER.lower()), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))
    return docs.withColumn("run", F.explode(found))


def counted(words: DataFrame, word: Column, length: int, times: int) -> DataFrame:
    """(word, n): the words of at least ``length`` code points that occur ``times`` times or more."""
    own = words.select(word.alias("word")).where(F.length("word") >= length)
    return own.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def _known(word: str, p: str, s: str) -> Column:
    """The known letters of a word: ``p`` at the front and ``s`` at the back."""
    return F.expr(f"concat(substring({word}, 1, {p}), right({word}, {s}))")


def _split(rows: DataFrame) -> DataFrame:
    """Each row (word, n, m, p, s, open) twice: half of the open letters become known on the left, or the other half on the right."""
    left = F.expr("struct(m, cast(m - s - (m - p - s) div 2 as int) AS p, s, open)")
    right = F.expr("struct(m, p, cast(s + (m - p - s) div 2 as int) AS s, false AS open)")
    halves = rows.select("word", "n", F.explode(F.array(left, right)).alias("x")).select("word", "n", "x.*")
    return halves.withColumn("known", _known("word", "p", "s"))


def grouped(words: DataFrame, size: int) -> DataFrame:
    """(word, n, m, p, s, open, known): words by what they share, in groups of about ``size`` at most."""
    whole = words.withColumn("m", F.explode(F.array(F.length("word"), F.length("word") - 1)))
    rows = _split(whole.withColumns({"p": F.lit(0), "s": F.lit(0), "open": F.lit(True)}))
    done = []
    while True:
        many = rows.where("m - p - s > 1").groupBy(*_SHAPE).agg(F.count("*").alias("size")).where(F.col("size") > size).select(*_SHAPE)
        many = materialize(many, "variant-groups")
        if many.isEmpty():
            break
        done.append(rows.join(many, _SHAPE, "left_anti"))
        rows = materialize(_split(rows.join(many, _SHAPE, "left_semi")), "variant-halves")
    for part in done:
        rows = rows.unionByName(part)
    return rows


class Index:
    """Words of some groups of one shape, 64 to a slice: a slice is of one group."""

    def __init__(self, open_parts: list[str], edges: np.ndarray, letters: int):
        sizes = np.diff(edges)
        group = np.repeat(np.arange(len(sizes)), sizes)
        inside = np.arange(len(group)) - edges[:-1][group]
        slices = -(-sizes // 64)
        self.first = np.concatenate(([0], np.cumsum(slices)))
        self.slice = self.first[group] + inside // 64
        self.bit = np.uint64(1) << (inside % 64).astype(np.uint64)
        self.begin = np.repeat(edges[:-1], slices) + 64 * (np.arange(int(self.first[-1])) - np.repeat(self.first[:-1], slices))
        self.group, self.letters = group, letters
        # one place more than the longer words have: no letter stands there
        codes = np.array(open_parts, f"<U{letters + 2}").view(np.uint32).reshape(len(group), letters + 2)
        self.alphabet, numbers = np.unique(codes, return_inverse=True)
        self.codes = numbers.reshape(codes.shape)
        self.shorter = codes[:, letters] == 0

    def words_in(self, rows: np.ndarray) -> np.ndarray:
        """For every slice the bitset of the chosen rows."""
        out = np.zeros(int(self.first[-1]), np.uint64)
        np.bitwise_or.at(out, self.slice[rows], self.bit[rows])
        return out

    def with_letter(self, place: int) -> np.ndarray:
        """For every slice and letter the bitset of the words with that letter at ``place``, end to end."""
        out = np.zeros(int(self.first[-1]) * len(self.alphabet), np.uint64)
        np.bitwise_or.at(out, self.slice * len(self.alphabet) + self.codes[:, place], self.bit)
        return out

    def near(self, even: bool) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Row of a shorter word, row of a near word, and whether that is longer; ``even`` tells whether a letter may follow the last."""
        queries = np.flatnonzero(self.shorter)
        group = self.group[queries]
        counts = self.first[group + 1] - self.first[group]
        rows = np.repeat(queries, counts)
        slices = self.first[self.group[rows]] + np.arange(len(rows)) - np.repeat(np.concatenate(([0], np.cumsum(counts)))[:-1], counts)
        every = self.words_in(np.arange(len(self.slice)))
        same, longer = self.words_in(queries), self.words_in(np.flatnonzero(~self.shorter))
        exact = every[slices]
        other, more = np.zeros(len(rows), np.uint64), np.zeros(len(rows), np.uint64)
        ahead = self.with_letter(0)
        for place in range(self.letters):
            here, ahead = ahead, self.with_letter(place + 1)
            for at in range(0, len(rows), STEP):
                some = slice(at, at + STEP)
                cell = slices[some] * len(self.alphabet) + self.codes[rows[some], place]
                agree = here[cell]
                other[some] = other[some] & agree | exact[some] & ~agree
                more[some] = (more[some] | exact[some]) & ahead[cell]
                exact[some] &= agree
        more = (more | exact if even else more & ~exact) & longer[slices]
        for found, is_longer in ((other & same[slices], False), (more, True)):
            left = np.flatnonzero(found)
            bits = found[left]
            while len(left):
                low = bits & (~bits + np.uint64(1))
                yield rows[left], self.begin[slices[left]] + np.log2(low.astype(float)).astype(np.int64), is_longer
                bits ^= low
                left, bits = left[bits != 0], bits[bits != 0]


def _segments(edges: np.ndarray, shape: np.ndarray, letters: np.ndarray) -> Iterator[np.ndarray]:
    """Edges of consecutive groups of one shape, with a bounded table for each position."""
    begin = 0
    while begin < len(edges) - 1:
        end, slices = begin + 1, -(-(edges[begin + 1] - edges[begin]) // 64)
        while end < len(edges) - 1 and shape[edges[end]] == shape[edges[begin]] and (slices := slices - (edges[end] - edges[end + 1]) // 64) * 128 < CELLS:
            end += 1
        yield edges[begin : end + 1]
        begin = end


def compared(rows: pa.Table, edges: np.ndarray) -> pa.RecordBatch:
    """(word, n_near, n, other) from whole groups: how many near words each word has there, and the best of them."""
    words, times = rows["word"], rows["n"].to_numpy()
    texts = words.to_pylist()
    order = pc.sort_indices(words).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    m, p, s, even = (rows[name].to_numpy() for name in ("m", "p", "s", "open"))
    shape = np.cumsum(np.concatenate(([False], (np.diff(m) != 0) | (np.diff(p) != 0) | (np.diff(s) != 0) | (even[1:] != even[:-1])))) if len(m) else m
    near, best = np.zeros(len(order), np.int64), np.full(len(order), -1)
    for part in _segments(edges, shape, m):
        begin, end = int(part[0]), int(part[-1])
        front, back = int(p[begin]), int(s[begin])
        index = Index([text[front : len(text) - back] for text in texts[begin:end]], part - begin, int(m[begin]) - front - back)
        for left, right, longer in index.near(bool(even[begin])):
            for own, other in ((left + begin, right + begin), *(((right + begin, left + begin),) if longer else ())):
                np.add.at(near, own, 1)
                # the best of each word: highest count, then first in order; the last of them in this order
                by = np.lexsort((-rank[other], times[other], own))
                own, other = own[by], other[by]
                last = np.concatenate((own[1:] != own[:-1], [True]))
                own, other = own[last], other[last]
                held = best[own]
                better = (held < 0) | (times[other] > times[held]) | ((times[other] == times[held]) & (rank[other] < rank[held]))
                best[own[better]] = other[better]
    told = np.flatnonzero(near)
    columns = [words.take(pa.array(told)).combine_chunks(), pa.array(near[told]), pa.array(times[best[told]]), words.take(pa.array(best[told])).combine_chunks()]
    return pa.RecordBatch.from_arrays(columns, ["word", "n_near", "n", "other"])


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(word, n_near, form_n, form): for the words (word, n) that have any, the number of near words and the most frequent of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            rows = pa.Table.from_batches([*held, batch]).combine_chunks()
            fresh = np.zeros(rows.num_rows, bool)
            fresh[:1] = True
            for name in _SHAPE:
                column = rows[name].combine_chunks()
                fresh[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(fresh)
            if len(edges) > 1:
                yield compared(rows.slice(0, int(edges[-1])), edges)
            held = rows.slice(int(edges[-1])).to_batches() if len(edges) else []
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            yield compared(rows, np.array([0, rows.num_rows]))

    partitions = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = grouped(words, group).repartition(partitions, *_SHAPE).sortWithinPartitions(*_SHAPE)
    found = dealt.mapInArrow(run, "word string, n_near long, n long, other string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "other")).alias("best"))
    return best.select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.other").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word of (word, form): forms followed to the last, in as many passes as the logarithm of the longest way."""
    state = materialize(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        further = state.select(F.col("word").alias("at"), F.col("root").alias("next"))
        joined = state.join(further, F.col("root") == F.col("at"), "left")
        if joined.where("at is not null").isEmpty():
            return state
        state = materialize(joined.select("word", F.coalesce("next", "root").alias("root")), "variant-roots")


def variants(words: DataFrame, ratio: int = RATIO, group: int = GROUP) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of (word, n): its form is its most frequent near word, if that is
    ``ratio`` times as frequent or more; its root is the end of the way from form to form, the word itself if it has none."""
    words = words.where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))
    words = materialize(words, "variant-words")
    near = words.join(near_words(words, group), "word", "left")
    has_form = F.col("form_n") >= F.col("n") * ratio
    told = near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has_form, F.col("form")).alias("form"), F.when(has_form, F.col("form_n")).alias("form_n"))
    told = materialize(told, "variant-forms")
    ends = roots(told.where("form is not null")).withColumnRenamed("word", "of_word")
    return told.join(ends, F.col("word") == F.col("of_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
