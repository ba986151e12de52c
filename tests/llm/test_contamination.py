import random
import re

import pytest

from veilcraft.llm import contamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, words):
    windows = {}
    for item, text in items:
        w = split(text)
        k = min(len(w), words)
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add("" if item is None else str(item))
    sizes, out = {len(w) for w in windows}, []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (names := windows.get(tuple(w[i : i + k]))) is not None:
                    hit.update(range(i, i + k))
                    found |= names
        out.append((doc, len(w), sorted(hit), sorted(found)))
    return sorted(out, key=repr)


def corpus(seed):
    draw = random.Random(seed)
    some = lambda n, of="abcdé": " ".join("".join(draw.choice(of) for _ in range(draw.randint(1, 2))) for _ in range(n))
    items = [(n, some(draw.randint(5, 60))) for n in range(20)] + [(20, "lone"), (21, "Two, WORDS!"), (22, ""), (23, None), (None, some(30)), (3, some(12)), (24, "a b " * 30)]
    docs = [(1, None), (2, ""), (3, "?!"), (None, items[4][1]), (5, "x " * 5000 + items[7][1].upper()), (6, "lone"), (7, "the two-words here"), (8, "ab " * 40 + "a b " * 40)]
    for n in range(60):
        text = draw.choice(items)[1] or ""
        cut = draw.randrange(40)
        docs.append((10 + n, some(draw.randrange(30)) + draw.choice([" ", "", "\n— "]) + text[cut : cut + draw.randrange(200)] + " " + some(draw.randrange(30))))
    return docs + docs[-3:], items


def table(spark, rows, names):
    return spark.createDataFrame([(*row, 7) for row in rows], f"{names[0]} long, text string, found int").repartition(3)


@pytest.mark.parametrize("seed, block, piece, shard, text", [(1, 2 << 20, 1 << 16, 32 << 20, 4 << 20), (2, 100, 15, 200, 64)])
@pytest.mark.parametrize("words", [4, 10])
def test_equals_brute_force(spark, monkeypatch, seed, block, piece, shard, text, words):
    for name, value in (("BLOCK_WORDS", block), ("PIECE_WORDS", piece), ("SHARD_BYTES", shard), ("TEXT_BYTES", text)):
        monkeypatch.setattr(contamination, name, value)
    docs, items = corpus(seed)
    if block > 100:
        items = items[:20] + items[21:]  # without a window of one word
    left, right = table(spark, docs, ["doc_id"]), table(spark, items, ["item_id"])
    got = contamination.contamination(left, right, words).collect()
    got = sorted(((r.doc_id, r.n_words, [i for h in r.hits for i in range(h.start, h.end)], list(r["items"])) for r in got), key=repr)
    expected = brute(docs, items, words)
    assert got == expected
    kept = contamination.remove_contaminated(left, right, words)
    assert kept.columns == left.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, _, hit, _ in expected if not hit), key=str)


@pytest.mark.parametrize("block, shard", [(2 << 20, 32 << 20), (60, 300)])
def test_longest_matches_equal_brute_force(spark, monkeypatch, block, shard):
    monkeypatch.setattr(contamination, "BLOCK_WORDS", block)
    monkeypatch.setattr(contamination, "SHARD_BYTES", shard)
    docs, items = corpus(3)
    items = [row for row in dict(items).items()]
    got = contamination.longest_matches(table(spark, docs, ["doc_id"]), table(spark, items, ["item_id"]), 6).collect()
    texts, expected = [(doc, split(text)) for doc, text in docs], {}
    for item, text in items:
        w = split(text)
        for start in range(max(1, len(w) - 5) if w else 0):
            best = 0
            for _, words in texts:
                for at in range(len(words)):
                    n = 0
                    while start + n < len(w) and at + n < len(words) and w[start + n] == words[at + n]:
                        n += 1
                    best = max(best, n)
            if best >= min(len(w), 6):
                expected[item, start] = best
    assert {(r.item_id, r.start): r.length for r in got} == expected
    for r in got:  # the place holds the match
        own = split(dict(items)[r.item_id])[r.start : r.start + r.length]
        assert any(words[r.doc_start : r.doc_start + r.length] == own for doc, words in texts if doc == r.doc_id)


def test_empty_tables(spark):
    docs, items = corpus(4)
    left, right = table(spark, docs, ["doc_id"]), table(spark, items, ["item_id"])
    assert contamination.contamination(left.limit(0), right).count() == 0
    assert all(not r.hits and not r["items"] for r in contamination.contamination(left, right.limit(0)).collect())
    assert contamination.remove_contaminated(left, right.limit(0)).count() == len(docs)
    assert contamination.longest_matches(left, right.limit(0)).count() == 0


def test_text_in_pieces_has_the_same_words(monkeypatch):
    import pyarrow as pa

    text = "".join(random.Random(5).choice("ab é.-") for _ in range(3000)) + "z" * 500 + " end"
    whole = contamination.word_hashes(pa.array([text]))[0].tolist()
    monkeypatch.setattr(contamination, "TEXT_BYTES", 50)
    assert contamination.word_hashes(pa.array([text]))[0].tolist() == whole
