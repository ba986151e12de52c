"""Scoring texts with a deleted-interpolation language model of word trigrams.

Tokens are words in lower case (A to Z only) and one end per text; ends stand before each text. A token's probability mixes the
maximum-likelihood estimates of word trigram and word bigram, from the counts of every n-gram of all training texts, with a class
model that every token has. The weights depend on how often the context was seen (powers of two) and are learned by
expectation-maximisation on the tokens of a deleted tenth of the training texts, with counts from the other nine; then all counts
are used. For that learning alone, the ratios of the estimates to the class model are rounded to quarters of a power of two, so that
the driver gathers a bounded table of cells, in which every deleted token counts.

The class model: the ``CLASSES`` - 2 most frequent words are classes of their own, the end is one, and all other words share
one; a word's probability is that of its class after the two classes before it, times, for other words, its share
(c + 0.5) / (N' + 0.5 (V' + 1)) among the other words, which leaves a place for one unknown word. Class probabilities mix trigram,
bigram and unigram of classes with an even share, by weights learned in the same way; it is ``CLASSES`` ** 3 numbers.

N-grams are counted and looked up in one exchange. Documents are kept in chunks, each wholly of one use (not training, kept,
deleted). A chunk sends its distinct n-grams, as sorted 64-bit hashes with its own counts, to ranges of hashes; a range adds the counts
up and answers each chunk with totals in the order of its hashes, without the hashes. An n-gram reaches a range at most once per
chunk, however frequent it is, and the number of ranges grows with the text. Nothing of the n-grams is gathered on one machine.

Defined results: a null or empty text has one token, its end; without training texts every probability is that of an unknown
word or an even share; repeated rows get equal results; words and n-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilcraft.llm.common import RollingHash, flat, mix, slices, unsqueezed
from veilcraft.llm.jaccard import lowered, word_bounds
from veilcraft.session import materialize

CLASSES = 128
HEAD = 1 << 19
OTHER, END = 0, 1
#: The hash that stands for the end of a text.
END_HASH = np.uint64(0xE4D0F7E87)
ITERATIONS = 30
#: Tokens counted in a task before they are combined.
HELD_TOKENS = 2 << 20
#: Bytes of text in a chunk of documents, and for each range of n-gram hashes.
CHUNK_BYTES = 4 << 20
RANGE_BYTES = 4 << 20
#: Bytes of text that a task holds as number arrays at a time.
SLICE = 1 << 19
#: What the documents of a chunk are used for.
UNSEEN, KEPT, DELETED = 0, 1, 2


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The token hashes of all texts, each followed by its end, and where each text's tokens begin (one more at the end)."""
    data, starts = flat(texts)
    data = lowered(data)
    first, last, of_text = word_bounds(data, starts)
    words = RollingHash(data).of(first, last)
    begins = of_text + np.arange(len(of_text))
    out = np.full(len(words) + len(texts), END_HASH, np.uint64)
    inside = np.ones(len(out), bool)
    inside[begins[1:] - 1] = False
    out[inside] = words
    return out, begins


def counted(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(pieces), return_counts=True)


def vocabulary(training: DataFrame) -> DataFrame:
    """(word, c, kept): the count of every token hash, and its count in the texts not deleted, from rows (deleted, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {True: [], False: []}, 0

        def told() -> Iterator[pa.RecordBatch]:
            for deleted, pieces in held.items():
                if pieces:
                    found, counts = counted(pieces)
                    columns = [found.view(np.int64), counts, counts * (not deleted)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["word", "c", "kept"])
                    pieces.clear()

        for batch in batches:
            for part in slices(batch, "text", SLICE):
                hashes, begins = tokens(part.column("text"))
                deleted = np.repeat(part.column("deleted").to_numpy(zero_copy_only=False).astype(bool), np.diff(begins))
                held[True].append(hashes[deleted]), held[False].append(hashes[~deleted])
                size += len(hashes)
                if size > HELD_TOKENS:
                    yield from told()
                    size = 0
        yield from told()

    partial = training.select("deleted", "text").mapInArrow(run, "word long, c long, kept long")
    return partial.groupBy("word").agg(F.sum("c").alias("c"), F.sum("kept").alias("kept"))


@dataclass
class Head:
    """The most frequent words: sorted hashes, their counts, and their classes."""

    words: np.ndarray
    counts: np.ndarray
    classes: np.ndarray

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.words):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return at, self.words[at] == hashes

    def class_of(self, hashes: np.ndarray) -> np.ndarray:
        at, known = self.find(hashes)
        out = np.where(known, self.classes[at] if len(self.classes) else OTHER, OTHER)
        out[hashes == END_HASH] = END
        return out


def step_of(count: Column) -> Column:
    """The eighth of a power of two that a count is in."""
    return F.floor(F.log2("c") * 8).cast("int")


def head_of(words: DataFrame, head: int, classes: int) -> tuple[Head, int]:
    """The words of the highest counts, at most ``head`` of them, and the step of counts from which on they are in it.

    The end is always among them.
    """
    steps = sorted(((r["s"], r["n"]) for r in words.groupBy(step_of(F.col("c")).alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, total = (steps[0][0] + 1 if steps else 0), 0
    for step, size in steps:
        total += size
        if total > head:
            break
        least = step
    rows = words.where((step_of(F.col("c")) >= least) | (F.col("word") == int(END_HASH))).toArrow()
    hashes, counts = rows["word"].to_numpy().view(np.uint64), rows["c"].to_numpy()
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    ranked = np.lexsort((hashes, -counts))
    ranked = ranked[hashes[ranked] != END_HASH][: classes - 2]
    numbers = np.full(len(hashes), OTHER, np.int64)
    numbers[ranked] = np.arange(2, 2 + len(ranked))
    return Head(hashes, counts, numbers), least


def shifted(values: np.ndarray, begins: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """For each token the values of the token before it and of the one before that; ``end`` stands before each text."""
    ends = np.array([end, end], values.dtype)
    before = np.concatenate((ends[:1], values[:-1]))
    second = np.concatenate((ends, values[:-2]))[: len(values)]
    second[begins[:-1]] = end
    before[begins[:-1]] = end
    follow = begins[:-1] + 1
    second[follow[follow < begins[1:]]] = end
    return before, second


def contexts(numbers: np.ndarray, begins: np.ndarray, classes: int) -> np.ndarray:
    """For each token the number of its class trigram; ends stand before each text."""
    before, second = shifted(numbers, begins, END)
    return (second * classes + before) * classes + numbers


def trigrams(training: DataFrame, head, classes: int) -> DataFrame:
    """(deleted, trigram, c) over class trigrams, from rows (deleted, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {True: [], False: []}, 0

        def told() -> Iterator[pa.RecordBatch]:
            for deleted, pieces in held.items():
                if pieces:
                    found, counts = counted(pieces)
                    yield pa.RecordBatch.from_arrays([pa.array([deleted] * len(found), pa.bool_()), pa.array(found), pa.array(counts)], ["deleted", "trigram", "c"])
                    pieces.clear()

        for batch in batches:
            for part in slices(batch, "text", SLICE):
                hashes, begins = tokens(part.column("text"))
                found = contexts(head.value.class_of(hashes), begins, classes)
                deleted = np.repeat(part.column("deleted").to_numpy(zero_copy_only=False).astype(bool), np.diff(begins))
                held[True].append(found[deleted]), held[False].append(found[~deleted])
                size += len(found)
                if size > HELD_TOKENS:
                    yield from told()
                    size = 0
        yield from told()

    return training.select("deleted", "text").mapInArrow(run, "deleted boolean, trigram long, c long").groupBy("deleted", "trigram").agg(F.sum("c").alias("c"))


def estimates(counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Trigram, bigram, unigram and even estimates for every (u, v, w), and the bucket of every context (u, v)."""
    size = counts.shape[0]
    pairs, single = counts.sum(axis=0), counts.sum(axis=(0, 1))
    context, last = counts.sum(axis=2), pairs.sum(axis=1)
    shares = [
        counts / np.maximum(context, 1)[:, :, None],
        np.broadcast_to(pairs / np.maximum(last, 1)[:, None], counts.shape),
        np.broadcast_to(single / max(1, single.sum()), counts.shape),
        np.broadcast_to(1 / size, counts.shape),
    ]
    seen = np.where(context > 0, 2 + np.floor(np.log2(np.maximum(context, 1))), np.where(last > 0, 1, 0)[None, :])
    return shares, seen.astype(np.int64)


def mixture_weights(kept: np.ndarray, deleted: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """Weights of the four estimates per bucket, by expectation-maximisation on the deleted counts; a row per bucket."""
    shares, seen = estimates(kept)
    u, v, w = np.nonzero(deleted)
    times, bucket = deleted[u, v, w].astype(float), seen[u, v]
    found = np.column_stack([share[u, v, w] for share in shares])
    weights = np.full((66, 4), 0.25)
    weights[0], weights[1] = (0, 0, 0.5, 0.5), (0, 1 / 3, 1 / 3, 1 / 3)  # no such context: no such estimate
    for _ in range(iterations):
        part = found * weights[bucket]
        part *= (times / part.sum(axis=1))[:, None]
        sums = np.column_stack([np.bincount(bucket, part[:, k], len(weights)) for k in range(4)])
        total = sums.sum(axis=1)
        weights[total > 0] = sums[total > 0] / total[total > 0, None]
    weights = 0.999 * weights  # the even share never vanishes
    weights[:, 3] += 0.001
    return weights


def log_model(kept: np.ndarray, deleted: np.ndarray, all_counts: bool = True) -> np.ndarray:
    """log10 of the mixed class probability of every trigram, with estimates from all counts or from the kept ones."""
    weights = mixture_weights(kept, deleted)
    used = kept + deleted if all_counts else kept
    shares, seen = estimates(used)
    out = sum(share * weights[seen, k][:, :, None] for k, share in enumerate(shares))
    missing = (seen == 0)[:, :, None] if used.sum() == 0 else None
    if missing is not None:
        out = np.where(missing, 1 / kept.shape[0], out)
    return np.log10(out)


def chunks(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """(use, n_bytes, n_texts, docs): rows (doc_id, text, training, use) of one use, about ``chunk_bytes`` of text together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sizes = {use: [] for use in (UNSEEN, KEPT, DELETED)}, dict.fromkeys((UNSEEN, KEPT, DELETED), 0)

        def told(use: int) -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[use][0].schema) as stream:
                for part in held[use]:
                    stream.write_batch(part)
            row = [[use], [sizes[use]], [sum(part.num_rows for part in held[use])], [zstandard.compress(sink.getvalue(), 3)]]
            held[use], sizes[use] = [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["use", "n_bytes", "n_texts", "docs"])

        for batch in batches:
            for part in slices(batch, "text", min(chunk_bytes, SLICE)):
                for use in held:
                    rows = part.filter(pc.equal(part.column("use"), use)).drop_columns(["use"])
                    if rows.num_rows:
                        held[use].append(rows)
                        sizes[use] += int(flat(rows.column("text"))[1][-1])
                        if sizes[use] >= chunk_bytes:
                            yield told(use)
        for use in held:
            if held[use]:
                yield told(use)

    return docs.mapInArrow(run, "use int, n_bytes long, n_texts long, docs binary")


def opened(docs: bytes) -> Iterator[pa.RecordBatch]:
    """The rows of a chunk."""
    with pa.ipc.open_stream(unsqueezed(docs)) as stream:
        yield from stream


def chunk_tokens(docs: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The token hashes of a chunk's texts, and where each text's tokens begin (one more at the end)."""
    hashes, begins, done = [], [np.zeros(1, np.int64)], 0
    for batch in opened(docs):
        for part in slices(batch, "text", SLICE):
            found, starts = tokens(part.column("text"))
            hashes.append(found), begins.append(starts[1:] + done)
            done += len(found)
    return np.concatenate(hashes), np.concatenate(begins)


#: Bits kept of the hashes of bigrams and trigrams. Among n distinct ones, one shares its hash with another with a chance of
#: about n / 2^52 (one in 4,500 for 10^12 of them), and is then counted with it. Words keep 64 bits, so what is known of them is exact.
GRAM_BITS = 52


def grams(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The hashes of all words, then of all word bigrams, then of all word trigrams, each in the order of the tokens they end at.

    The last bits of those of bigrams and trigrams are zero, which takes their space from what is sent.
    """
    before, second = shifted(hashes, begins, END_HASH)
    leading = ~np.uint64((1 << (64 - GRAM_BITS)) - 1)
    pairs = mix(before * np.uint64(0xD6E8FEB86659FD93) + hashes) & leading
    triples = mix(mix(second * np.uint64(0xD6E8FEB86659FD93) + before) * np.uint64(0xA0761D6478BD642F) + hashes) & leading
    return np.concatenate((hashes, pairs, triples))


def packed(values: np.ndarray) -> bytes:
    """64-bit numbers, compressed byte by byte of equal weight."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(unsqueezed(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def requests(kept_chunks: DataFrame, ranges: int) -> DataFrame:
    """(range, chunk, use, grams, counts): the distinct n-gram hashes of each chunk in each range, as differences, and their counts there."""
    least = np.array([(place << 64) // ranges for place in range(ranges)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, use, docs in zip(*(batch.column(name).to_pylist() for name in ("chunk", "use", "docs"))):
                found = grams(*chunk_tokens(docs))
                found.sort()
                first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1], [True])))
                found = found[first[:-1]]
                cuts = np.append(np.searchsorted(found, least), len(found)).tolist()
                rows = [
                    (place, chunk, use, packed(np.diff(found[a:b], prepend=np.uint64(0))), None if use == UNSEEN else packed(np.diff(first[a : b + 1])))
                    for place, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b
                ]
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                for start in range(0, len(rows), 1000):
                    columns = [pa.array(x, t) for x, t in zip(zip(*rows[start : start + 1000]), kinds)]
                    yield pa.RecordBatch.from_arrays(columns, ["range", "chunk", "use", "grams", "counts"])

    return kept_chunks.select("chunk", "use", "docs").mapInArrow(run, "range int, chunk long, use int, grams binary, counts binary")


def replies(asked: DataFrame) -> DataFrame:
    """(chunk, range, totals, kept): for every n-gram asked for, in the order asked, its count in all training texts.

    Deleted chunks also get the counts of the kept texts.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        sent = [np.cumsum(unpacked(row["grams"], np.uint64), dtype=np.uint64) for row in rows]
        sizes = [len(x) for x in sent]
        counts = np.concatenate([np.zeros(n, np.int64) if row["counts"] is None else unpacked(row["counts"], np.int64) for row, n in zip(rows, sizes)])
        deleted = np.repeat([row["use"] == DELETED for row in rows], sizes)
        found = np.concatenate(sent)
        order = np.argsort(found)
        found = found[order]
        new = np.concatenate(([True], found[1:] != found[:-1]))
        first, group = np.flatnonzero(new), np.cumsum(new) - 1
        totals, kept = np.empty_like(counts), np.empty_like(counts)
        totals[order] = np.add.reduceat(counts[order], first)[group]
        kept[order] = np.add.reduceat(np.where(deleted, 0, counts)[order], first)[group]
        cuts = np.cumsum(sizes)[:-1]
        answers = [packed(x) for x in np.split(totals, cuts)], [packed(x) if row["use"] == DELETED else None for row, x in zip(rows, np.split(kept, cuts))]
        return pa.table({"chunk": table.column("chunk"), "range": table.column("range"), "totals": pa.array(answers[0], pa.binary()), "kept": pa.array(answers[1], pa.binary())})

    return asked.groupBy("range").applyInArrow(run, "chunk long, range int, totals binary, kept binary")


@dataclass
class Model:
    """What is known of the counts of some training texts besides n-grams: the class model, the rest's size and the number of texts."""

    classed: np.ndarray
    rest_log: float
    texts: int


def token_counts(gram_hashes: np.ndarray, answers: pa.Table, column: str) -> np.ndarray:
    """Counts of the word, bigram and trigram at each token: three rows, from a chunk's replies."""
    answered = answers.sort_by("range").column(column).to_pylist()
    counts = np.concatenate([unpacked(x, np.int64) for x in answered])
    order = np.argsort(gram_hashes)
    found = gram_hashes[order]
    new = np.concatenate(([True], found[1:] != found[:-1]))
    del found
    out = np.empty(len(new), np.int64)
    out[order] = counts[np.cumsum(new) - 1]
    return out.reshape(3, -1)


def word_estimates(counts: np.ndarray, begins: np.ndarray, numbers: np.ndarray, classes: int, model: Model) -> tuple[list[np.ndarray], np.ndarray]:
    """Trigram, bigram and class-model probability of every token, and the bucket of its context.

    A context was seen as often as the n-gram that ends before the token; ends stand before each text, once per text.
    """
    word, pair, triple = counts
    begin = begins[:-1]
    last, context = np.concatenate(([0], word[:-1])), np.concatenate(([0], pair[:-1]))
    last[begin] = context[begin] = model.texts
    classed = model.classed[contexts(numbers, begins, classes)].astype(float)
    classed += np.where(numbers == OTHER, np.log10(word + 0.5) - model.rest_log, 0.0)
    seen = np.where(context > 0, 2 + np.floor(np.log2(np.maximum(context, 1))), last > 0)
    return [triple / np.maximum(context, 1), pair / np.maximum(last, 1), 10.0**classed], seen.astype(np.int64)


#: Cells of the ratios of an estimate to the class model: quarters of a power of two; no such n-gram.
STEPS, NEVER = 4, -(1 << 20)


def ratio_cells(shares: list[np.ndarray], seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (bucket, trigram ratio, bigram ratio) of tokens, and how many have each."""
    with np.errstate(divide="ignore"):
        steps = [np.where(share > 0, np.round(STEPS * (np.log2(share) - np.log2(shares[2]))), NEVER) for share in shares[:2]]
    return np.unique(np.column_stack([seen, *steps]).astype(np.int64), axis=0, return_counts=True)


def word_weights(cells: np.ndarray, times: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """Weights of trigram, bigram and class model per bucket, by expectation-maximisation on cells of deleted tokens."""
    bucket = cells[:, 0]
    found = np.column_stack([np.where(cells[:, k] == NEVER, 0.0, 2.0 ** (cells[:, k] / STEPS)) for k in (1, 2)] + [np.ones(len(cells))])
    weights = np.full((66, 3), 1 / 3)
    weights[0], weights[1] = (0, 0, 1), (0, 0.5, 0.5)  # no such context: no such estimate
    for _ in range(iterations):
        part = found * weights[bucket]
        part *= (times / part.sum(axis=1))[:, None]
        sums = np.column_stack([np.bincount(bucket, part[:, k], len(weights)) for k in range(3)])
        total = sums.sum(axis=1)
        weights[total > 0] = sums[total > 0] / total[total > 0, None]
    weights = 0.999 * weights  # the class model never vanishes
    weights[:, 2] += 0.001
    return weights


def score_texts(
    docs: DataFrame, training: Column, head_size: int = HEAD, classes: int = CLASSES, id_column: str = "doc_id", text_column: str = "text",
    chunk_bytes: int = CHUNK_BYTES, range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Every document's doc_id, n_tokens, n_known, train_tokens, base_score and score; ``training`` tells the rows to learn from."""
    spark = docs.sparkSession
    named = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    deleted = F.pmod(F.xxhash64("text"), F.lit(10)) == 0
    learned = named.where("training").select("text", deleted.alias("deleted"))
    words = materialize(vocabulary(learned), "scoring-words")
    totals = words.agg(*(F.coalesce(x, F.lit(0)).alias(n) for n, x in (("n", F.sum("c")), ("v", F.count("*")), ("kept_v", F.sum((F.col("kept") > 0).cast("long")))))).first()
    head, _ = head_of(words.select("word", "c"), head_size, classes)
    own = (head.classes > OTHER) | (head.words == END_HASH)
    head = Head(head.words[own], head.counts[own], head.classes[own])
    shared = spark.sparkContext.broadcast(head)
    cells = trigrams(learned, shared, classes).toArrow()  # at most 2 x classes^3 rows
    counts = np.zeros((2, classes**3))
    counts[cells["deleted"].to_numpy().astype(int), cells["trigram"].to_numpy()] = cells["c"].to_numpy()
    counts = counts.reshape(2, classes, classes, classes)

    use = F.when(~F.col("training"), UNSEEN).when(deleted, DELETED).otherwise(KEPT)
    stored = materialize(chunks(named.withColumn("use", use), chunk_bytes).withColumn("chunk", F.monotonically_increasing_id()), "scoring-chunks")
    sizes = {r["use"]: r for r in stored.groupBy("use").agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_texts").alias("n_texts")).collect()}
    texts = {use: sizes[use]["n_texts"] if use in sizes else 0 for use in (KEPT, DELETED)}
    answers = materialize(replies(requests(stored, 1 + sum(r["n_bytes"] for r in sizes.values()) // range_bytes)), "scoring-counts")

    def model(all_counts: bool, distinct: int) -> Model:
        by_class = (counts.sum(axis=0) if all_counts else counts[0]).sum(axis=(0, 1))
        known = int((by_class[1:] > 0).sum())
        table = log_model(*counts, all_counts).astype(np.float32).ravel()
        return Model(table, float(np.log10(by_class[OTHER] + 0.5 * (distinct - known + 1))), texts[KEPT] + texts[DELETED] * all_counts)

    kept_model = spark.sparkContext.broadcast(model(False, totals["kept_v"]))
    full_model = spark.sparkContext.broadcast(model(True, totals["v"]))
    all_log = float(np.log10(totals["n"] + 0.5 * (totals["v"] + 1)))

    def met(some_chunks: DataFrame, some_answers: DataFrame, run, schema: str) -> DataFrame:
        return some_chunks.groupBy("chunk").cogroup(some_answers.groupBy("chunk")).applyInArrow(run, schema)

    def told(chunk: pa.Table, answer: pa.Table) -> pa.Table:
        hashes, begins = chunk_tokens(chunk.column("docs")[0].as_py())
        seen_counts = token_counts(grams(hashes, begins), answer, "kept")
        found, times = ratio_cells(*word_estimates(seen_counts, begins, shared.value.class_of(hashes), classes, kept_model.value))
        return pa.table({"bucket": found[:, 0], "trigram": found[:, 1], "bigram": found[:, 2], "n": times.astype(np.int64)})

    in_cells = met(stored.where(F.col("use") == DELETED).select("chunk", "docs"), answers.where("kept is not null"), told, "bucket long, trigram long, bigram long, n long")
    in_cells = in_cells.groupBy("bucket", "trigram", "bigram").agg(F.sum("n").alias("n")).toArrow()
    weights = word_weights(np.column_stack([in_cells[name].to_numpy() for name in ("bucket", "trigram", "bigram")]), in_cells["n"].to_numpy())

    def scored(chunk: pa.Table, answer: pa.Table) -> pa.Table:
        docs_bytes = chunk.column("docs")[0].as_py()
        rows = pa.Table.from_batches(opened(docs_bytes)).select(["doc_id", "training"])
        hashes, begins = chunk_tokens(docs_bytes)
        seen_counts = token_counts(grams(hashes, begins), answer, "totals")
        shares, seen = word_estimates(seen_counts, begins, shared.value.class_of(hashes), classes, full_model.value)
        add = lambda values: np.add.reduceat(values, begins[:-1])
        lengths = np.diff(begins)
        return pa.table({
            "doc_id": rows.column("doc_id"), "held_out": pc.invert(rows.column("training")), "n_tokens": lengths.astype(np.int64),
            "n_known": add((seen_counts[0] > 0).astype(np.int64)), "base_score": add(np.log10(seen_counts[0] + 0.5)) - lengths * all_log,
            "score": add(np.log10(sum(share * weights[seen, k] for k, share in enumerate(shares)))),
        })

    id_type = named.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    out = met(stored.select("chunk", "docs"), answers.select("chunk", "range", "totals"), scored, schema)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(totals["n"]).cast("long").alias("train_tokens"), "base_score", "score")
