"""Finding benchmark items in a corpus with suffix arrays of the training texts.

Texts and items are words (A to Z lowered). A window is ``words`` consecutive words of an item; an item of fewer words is one
window. The documents are read in shards: the words of a shard that some item has become numbers, runs too short for any
window are left out (an exact cut: a window cannot reach over a word that no item has), and the suffixes of the rest are put
in order by prefix doubling. Every distinct window is then looked up by binary search, all windows at once; the suffixes
between its lower and its upper bound are all its places in the shard. For longest matches the search goes on past the window,
and the neighbours of a test suffix in the array share the most words with it.

Shards are cut from the rows a task reads and need no shuffle. The items come to every task: their words are counted first and
dealt into blocks of about ``BLOCK_WORDS`` words (long items in overlapping pieces), so that what is sent has a bound; each
further block is another pass over the documents, which carries on what the passes before have found.

Words are compared by 64-bit hashes of their bytes. Defined results: a null text or item has no words; equal rows give equal
results, each on its own; items of one id are one item, a null id is written as empty text; without items no word is hit; an
empty table gives an empty result; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilcraft.llm.common import RollingHash, flat, slices
from veilcraft.session import materialize

WORDS = 10
#: Words of items that are sent to the tasks at a time, and words of a piece of an item.
BLOCK_WORDS, PIECE_WORDS = 2 << 20, 1 << 16
#: A shard's suffix array covers about so many bytes of text, or so many words that items have.
SHARD_BYTES, SHARD_WORDS = 32 << 20, 2 << 20
#: A longer text is cut into words piece by piece.
TEXT_BYTES = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: digits, letters, and all that is not ASCII.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[128:] = True
#: Between runs of document words, and behind an item; never equal, so no match crosses them.
_GAP, _END = 0, -1


def _hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = _LOWER[data]
    inner = _IN_WORD[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[starts] = True
    first = np.flatnonzero(inner & (~np.concatenate(([False], inner[:-1])) | cut[:-1]))
    last = np.flatnonzero(inner & (~np.concatenate((inner[1:], [False])) | cut[1:])) + 1
    return RollingHash(data).of(first, last), np.searchsorted(first, starts)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of a column's texts, and the first word of each text (one more at the end)."""
    data, starts = flat(column)
    if len(column) != 1 or len(data) <= TEXT_BYTES:
        return _hashes(data, starts)
    found, begin = [], 0
    while begin < len(data):
        end = min(begin + TEXT_BYTES, len(data))
        while end < len(data) and _IN_WORD[data[end]]:  # on to the end of the word
            ahead = np.flatnonzero(~_IN_WORD[data[end : end + TEXT_BYTES]])
            end += int(ahead[0]) if len(ahead) else min(TEXT_BYTES, len(data) - end)
        found.append(_hashes(data[begin:end], np.array([0, end - begin]))[0])
        begin = end
    hashes = np.concatenate(found)
    return hashes, np.array([0, len(hashes)])


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """The starts of all suffixes in the order of (at least) their first ``depth`` tokens; gaps start none."""
    order = np.argsort(tokens, kind="stable")
    ranks, reach = tokens.astype(np.int64), 1
    while reach < depth and len(tokens) > 1:
        key = ranks * (int(ranks.max()) + 1)
        key[:-reach] += ranks[reach:]
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate(([False], key[order[1:]] != key[order[:-1]]))
        ranks = np.empty(len(tokens), np.int64)
        ranks[order] = np.cumsum(fresh)
        reach *= 2
        if ranks[order[-1]] == len(tokens) - 1:
            break
    return order[tokens[order] != _GAP]


@dataclass
class Block:
    """Items to look for: sorted word hashes (a word's number is its place from 1 on), tokens of all items, distinct windows."""

    vocabulary: np.ndarray
    tokens: np.ndarray
    #: Row of ``ids`` and place in its item for every token.
    item: np.ndarray
    place: np.ndarray
    #: Start and words of the window at every place that has one.
    starts: np.ndarray
    lengths: np.ndarray
    #: Distinct windows (shorter ones end in gaps), the window at each start, and the items of each window.
    windows: np.ndarray
    window_at: np.ndarray
    item_edges: np.ndarray
    items: np.ndarray
    ids: pa.Array
    names: list[str]
    words: int

    @staticmethod
    def of(pieces: pa.Table, words: int) -> Block:
        hashes = [np.frombuffer(x, np.uint64) for x in pieces["hashes"].to_pylist()]
        sizes = np.array([len(x) for x in hashes], np.int64)
        vocabulary, numbers = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]), return_inverse=True)
        begins = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        tokens = np.full(int(sizes.sum()) + len(sizes) + words, _END, np.int64)
        inside = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)
        tokens[inside] = numbers.ravel() + 1
        piece = np.repeat(np.arange(len(sizes)), sizes + 1)
        place = np.arange(len(piece)) - begins[piece] + pieces["begin"].to_numpy()[piece]
        counts = np.where(sizes < words, sizes > 0, sizes - words + 1)
        of_window = np.repeat(np.arange(len(sizes)), counts)
        starts = begins[of_window] + np.arange(len(of_window)) - np.repeat(np.concatenate(([0], np.cumsum(counts)))[:-1], counts)
        lengths = np.minimum(sizes, words)[of_window]
        rows = tokens[starts[:, None] + np.arange(words)]
        rows[np.arange(words) >= lengths[:, None]] = _GAP
        windows, window_at = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.zeros(0, np.int64))
        names = pieces["name"].to_pylist()
        distinct = {name: n for n, name in enumerate(dict.fromkeys(names))}
        item = np.array([distinct[name] for name in names], np.int64)
        window, items = pairs(window_at.ravel(), item[of_window], len(distinct))
        edges = np.searchsorted(window, np.arange(len(windows) + 1))
        return Block(vocabulary, tokens, piece, place, starts, lengths, windows, window_at.ravel(), edges, items, pieces["item_id"].combine_chunks(), list(distinct), words)

    def least(self) -> int:
        return int(self.lengths.min()) if len(self.lengths) else self.words

    def numbered(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, 0 for words that no item has."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, _GAP)


@dataclass
class Shard:
    """The words of some documents that items have: tokens with a gap behind each run, and where each is (row and word of its text)."""

    tokens: np.ndarray
    rows: np.ndarray
    places: np.ndarray

    @staticmethod
    def parts(numbers: np.ndarray, begins: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
        """Tokens, rows and places of the runs of at least ``least`` known words of some texts."""
        known = np.concatenate(([False], numbers != _GAP, [False]))
        cut = np.zeros(len(numbers) + 1, bool)
        cut[begins] = True
        first = np.flatnonzero(known[1:-1] & (~known[:-2] | cut[:-1]))
        last = np.flatnonzero(known[1:-1] & (~known[2:] | cut[1:])) + 1
        long = last - first >= least
        first, sizes = first[long], (last - first)[long]
        run = np.repeat(np.arange(len(first)), sizes + 1)
        inside = np.arange(len(run)) - np.repeat(np.concatenate(([0], np.cumsum(sizes + 1)))[:-1], sizes + 1)
        at = first[run] + inside
        rows = np.searchsorted(begins, first, "right")[run] - 1
        gap = inside == sizes[run]
        return np.where(gap, _GAP, numbers[np.minimum(at, max(0, len(numbers) - 1))]) if len(run) else at, rows, at - begins[rows]

    def found(self, block: Block, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of the suffix array that starts with each window, by binary search."""
        padded = np.concatenate((self.tokens, np.full(block.words, _GAP)))
        ends = []
        for upper in (False, True):
            low, high = np.zeros(len(block.windows), np.int64), np.full(len(block.windows), len(order))
            while (going := np.flatnonzero(low < high)).size:
                middle = (low[going] + high[going]) // 2
                wanted = block.windows[going]
                differs = padded[order[middle][:, None] + np.arange(block.words)] - wanted
                differs[wanted == _GAP] = 0  # a shorter window asks for no more
                one = differs[np.arange(len(going)), np.argmax(differs != 0, axis=1)]
                before = one <= 0 if upper else one < 0
                low[going[before]], high[going[~before]] = middle[before] + 1, middle[~before]
            ends.append(low)
        return ends[0], ends[1]


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges low to high: the range's number and each index in it."""
    sizes = high - low
    owner = np.repeat(np.arange(len(low)), sizes)
    return owner, low[owner] + np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(sizes)))[:-1], sizes)


def hits(shard: Shard, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which tokens windows cover, and the pairs of row and item that meet."""
    covered = np.zeros(len(shard.tokens) + 1, np.int64)
    order = suffix_array(shard.tokens, block.words)
    low, high = shard.found(block, order)
    window, at = spread(low, high)
    place = order[at]
    np.add.at(covered, place, 1)
    np.add.at(covered, place + (block.windows != _GAP).sum(axis=1)[window], -1)
    row, window = pairs(shard.rows[place], window, len(block.windows))
    owner, at = spread(block.item_edges[window], block.item_edges[window + 1])
    return np.cumsum(covered)[:-1] > 0, *pairs(row[owner], block.items[at], len(block.names))


def pairs(left: np.ndarray, right: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, in order; ``right`` is below ``size``."""
    return np.divmod(np.unique(left * size + right), size) if size else (left, right)


def common_words(shard: Shard, block: Block, suffixes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that test suffixes share with suffixes of the shard, and the difference of the first other word (shard less test)."""
    ours, theirs = np.concatenate((shard.tokens, np.full(16, _GAP))), np.concatenate((block.tokens, np.full(16, _END)))
    shared, difference = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
    going = np.arange(len(places))
    while len(going):
        steps = shared[going][:, None] + np.arange(16)
        differs = ours[places[going][:, None] + steps] - theirs[suffixes[going][:, None] + steps]
        first = np.argmax(differs != 0, axis=1)
        difference[going] = differs[np.arange(len(going)), first]
        equal = difference[going] == 0
        shared[going] += np.where(equal, 16, first)
        going = going[equal]
    return shared, difference


def longest(shard: Shard, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The test suffixes with a window in the shard, the words of their longest match, and one place of it."""
    order = suffix_array(shard.tokens, int(np.diff(np.flatnonzero(block.tokens == _END), prepend=-1).max()))
    low, high = shard.found(block, order)
    suffixes = np.flatnonzero((high > low)[block.window_at])
    left, right = low[block.window_at[suffixes]], high[block.window_at[suffixes]]
    start = block.starts[suffixes]
    first, last = left.copy(), right - 1
    while (going := np.flatnonzero(left < right)).size:
        middle = (left[going] + right[going]) // 2
        before = common_words(shard, block, start[going], order[middle])[1] < 0
        left[going[before]], right[going[~before]] = middle[before] + 1, middle[~before]
    below, above = order[np.clip(left - 1, first, last)], order[np.clip(left, first, last)]
    one, other = common_words(shard, block, start, below)[0], common_words(shard, block, start, above)[0]
    return start, np.maximum(one, other), np.where(one >= other, below, above)


def sharded(batches: Iterator[pa.RecordBatch], column: str, block: Block) -> Iterator[tuple[pa.Table, np.ndarray, Shard]]:
    """Rows of a task as shards: the rows, the words of each text, and the tokens to be searched."""
    rows: list[pa.RecordBatch] = []
    parts: list[tuple[np.ndarray, ...]] = []
    counts: list[np.ndarray] = []
    bytes_held = words_held = rows_held = 0

    def told() -> tuple[pa.Table, np.ndarray, Shard]:
        whole = pa.Table.from_batches(rows), np.concatenate(counts), Shard(*(np.concatenate(x) for x in zip(*parts)))
        rows.clear(), parts.clear(), counts.clear()
        return whole

    for batch in batches:
        for part in slices(batch, column):
            hashes, begins = word_hashes(part.column(column))
            tokens, owners, places = Shard.parts(block.numbered(hashes), begins, block.least())
            rows.append(part), counts.append(np.diff(begins)), parts.append((tokens, owners + rows_held, places))
            rows_held += part.num_rows
            words_held += len(tokens)
            bytes_held += part.nbytes
            if bytes_held > SHARD_BYTES or words_held > SHARD_WORDS:
                yield told()
                bytes_held = words_held = rows_held = 0
    if rows:
        yield told()


def item_pieces(items: DataFrame, words: int, id_column: str, text_column: str) -> DataFrame:
    """(item_id, name, begin, hashes, n): the words of every item, long items in pieces that overlap by a window less a word."""
    named = items.select(F.col(id_column).alias("item_id"), F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("name"), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, begins = word_hashes(part.column("text"))
                cuts = [(row, at, min(at + PIECE_WORDS + words - 1, end)) for row, (begin, end) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist()))
                        for at in range(begin, max(begin + 1, end - words + 1), PIECE_WORDS) if end > begin]
                owner = pa.array([row for row, _, _ in cuts], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("item_id").take(owner), part.column("name").take(owner), pa.array([a - int(begins[r]) for r, a, _ in cuts], pa.int64()),
                     pa.array([hashes[a:b].tobytes() for _, a, b in cuts], pa.binary()), pa.array([b - a for _, a, b in cuts], pa.int64())],
                    ["item_id", "name", "begin", "hashes", "n"],
                )

    kind = named.schema["item_id"].dataType.simpleString()
    return materialize(named.mapInArrow(run, f"item_id {kind}, name string, begin long, hashes binary, n long"), "benchmark-words")


def blocks(items: DataFrame, words: int, id_column: str, text_column: str) -> Iterator[tuple[bool, Block]]:
    """The items in blocks of bounded size, one after the other, and whether a block is the last; at least one."""
    pieces = item_pieces(items, words, id_column, text_column)
    count = max(1, -(-(pieces.agg(F.sum("n")).first()[0] or 0) // BLOCK_WORDS))
    for number in range(count):
        yield number == count - 1, Block.of(pieces.where(F.pmod(F.xxhash64("name", "begin"), F.lit(count)) == number).toArrow(), words)


def joined_runs(*runs: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int]]:
    """The union of sorted stretches (starts, ends)."""
    out: list[list[int]] = []
    for start, end in sorted(pair for starts, ends in runs for pair in zip(starts, ends)):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


_FOUND = "struct<n_words: long, hits: array<struct<start: long, end: long>>, items: array<string>>"
_FOUND_ARROW = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])


def marker(block: Block, text_column: str, found: str, again: bool, kept: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task of :func:`marked` for one block; ``again`` tells that earlier blocks have left their findings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, n_words, shard in sharded(batches, text_column, block):
            covered, owners, items = hits(shard, block)
            inside = np.concatenate(([False], covered, [False]))
            first, last = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:]) - 1
            # a stretch of tokens ends at a gap, so first and last token belong to one text
            owner, starts, ends = shard.rows[first], shard.places[first], shard.places[last] + 1
            run_edges, item_edges = np.searchsorted(owner, np.arange(len(n_words) + 1)), np.searchsorted(owners, np.arange(len(n_words) + 1))
            told = [{"n_words": n, "hits": [], "items": []} for n in n_words.tolist()] if not again else rows[found].to_pylist()
            for row in np.union1d(np.unique(owner), np.unique(owners)).tolist():
                at, names = slice(run_edges[row], run_edges[row + 1]), {block.names[i] for i in items[item_edges[row] : item_edges[row + 1]].tolist()}
                before = told[row]["hits"]
                runs = joined_runs((starts[at].tolist(), ends[at].tolist()), ([x["start"] for x in before], [x["end"] for x in before]))
                told[row] |= {"hits": [{"start": a, "end": b} for a, b in runs], "items": sorted(names.union(told[row]["items"]))}
            yield from rows.select(kept).append_column(found, pa.array(told, _FOUND_ARROW)).combine_chunks().to_batches()

    return run


def marked(docs: DataFrame, items: DataFrame, words: int, text_column: str, item_columns: tuple[str, str], keep_text: bool) -> tuple[DataFrame, str]:
    """The rows of ``docs`` with what was found in each, in a column whose name is returned too."""
    found = "found"
    while found in map(str.lower, docs.columns):
        found += "_"
    out = docs
    for last, block in blocks(items, words, *item_columns):
        again = out is not docs
        if again:
            out = materialize(out, "contamination-pass")
        kept = [f for f in docs.schema.fields if f.name != text_column or keep_text or not last]
        out = out.mapInArrow(marker(block, text_column, found, again, [f.name for f in kept]), T.StructType([*kept, *T.StructType.fromDDL(f"{found} {_FOUND}")]))
    return out, found


def contamination(
    docs: DataFrame, items: DataFrame, words: int = WORDS, id_column: str = "doc_id", text_column: str = "text", item_columns: tuple[str, str] = ("item_id", "text")
) -> DataFrame:
    """doc_id, n_words, hits (stretches of words, start and end, that windows cover) and items (ids as text, sorted) of every document."""
    named = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    out, found = marked(named, items, words, "text", item_columns, keep_text=False)
    return out.select("doc_id", f"{found}.*")


def remove_contaminated(
    docs: DataFrame, items: DataFrame, words: int = WORDS, text_column: str = "text", item_columns: tuple[str, str] = ("item_id", "text")
) -> DataFrame:
    """The documents in which no window of an item occurs, with all their columns."""
    out, found = marked(docs, items, words, text_column, item_columns, keep_text=True)
    return out.where(F.size(f"{found}.hits") == 0).select(*(f"`{name}`" for name in docs.columns))


def longest_matches(
    docs: DataFrame, items: DataFrame, words: int = WORDS, id_column: str = "doc_id", text_column: str = "text", item_columns: tuple[str, str] = ("item_id", "text")
) -> DataFrame:
    """item_id, start, length, doc_id, doc_start: for every test suffix with a window in the corpus its longest verbatim match
    (within its piece of ``PIECE_WORDS`` words) and where it is; of several places that of the least id and word counts."""
    named = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    id_type, item_type = named.schema["doc_id"].dataType.simpleString(), items.schema[item_columns[0]].dataType.simpleString()
    parts = []
    for _, block in blocks(items, words, *item_columns):

        def run(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            for rows, _, shard in sharded(batches, "text", block):
                if not len(block.windows) or not len(shard.tokens):
                    continue
                suffixes, length, place = longest(shard, block)
                doc = rows["doc_id"].combine_chunks().take(pa.array(shard.rows[place]))
                item = block.ids.take(pa.array(block.item[suffixes]))
                numbers = [pa.array(x.astype(np.int64)) for x in (block.place[suffixes], length, shard.places[place])]
                yield pa.RecordBatch.from_arrays([item, numbers[0], numbers[1], doc, numbers[2]], ["item_id", "start", "length", "doc_id", "doc_start"])

        parts.append(named.mapInArrow(run, f"item_id {item_type}, start long, length long, doc_id {id_type}, doc_start long"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    best = F.min(F.struct((-F.col("length")).alias("less"), "doc_id", "doc_start")).alias("best")
    return every.groupBy("item_id", "start").agg(best).select("item_id", "start", (-F.col("best.less")).alias("length"), "best.doc_id", "best.doc_start")
