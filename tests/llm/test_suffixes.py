import random
from collections import Counter
from pathlib import Path

import pytest

from veilcraft.llm import suffixes


def brute(docs, length):
    data = [(text or "").encode() for _, text in docs]
    counts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (doc_id, _), d in zip(docs, data):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(d), spans, bytes(c for c, g in zip(d, gone) if not g)))
    return sorted(out, key=str)


def corpus(seed, length):
    draw = random.Random(seed)
    fresh = lambda n: "".join(draw.choice("abcdé f") for _ in range(n))
    passage, docs = fresh(length * 3), [(1, None), (2, ""), (3, "short"), (4, "a" * (length * 3)), (5, "ab" * length), (None, fresh(length * 2))]
    for n in range(30):
        cut = draw.randrange(length * 2)
        docs.append((10 + n, fresh(draw.randrange(length)) + passage[cut : cut + draw.randrange(length * 2)] + fresh(draw.randrange(length))))
    base = fresh(length * 6)
    for n in range(25):
        copy = list(base)
        for _ in range(draw.randrange(4)):
            copy[draw.randrange(len(copy))] = draw.choice(["", "xy", "é"])
        docs.append((100 + n, "".join(copy)))
    text = fresh(length * 2)
    return docs + [(200, text), (200, text), (201, fresh(length * 3)), (202, text * 3)]


@pytest.mark.parametrize("group, piece, seed", [(512, 1 << 20, 1), (3, 150, 2)])
def test_equals_brute_force(spark, monkeypatch, group, piece, seed):
    monkeypatch.setattr(suffixes, "GROUP", group)
    monkeypatch.setattr(suffixes, "PIECE_BYTES", piece)
    docs = corpus(seed, 40)
    table = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_bytes int").repartition(3)
    got = [(r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in suffixes.remove_repeats(table, length=40).collect()]
    assert sorted(got, key=str) == brute(docs, 40)
    assert suffixes.remove_repeats(table.limit(0), 40).count() == 0


@pytest.mark.parametrize("group", [512, 3])
@pytest.mark.parametrize("period", ["abcd", "ab cdef", "abcdefg "])
@pytest.mark.parametrize("copies", [1, 2])
def test_short_period_does_not_repeat_itself(spark, monkeypatch, group, period, copies):
    monkeypatch.setattr(suffixes, "GROUP", group)
    draw = random.Random(9)
    text = lambda n: "".join(draw.choice("ghijklm") for _ in range(n))
    stretch = (period * 100)[:280]
    docs = [(n, text(164) + stretch + text(164)) for n in range(3)] + [(7, text(350) + stretch + stretch[3:] + text(350))]
    docs = docs + [(i + 100 * c, t) for i, t in docs for c in range(1, copies)]
    got = suffixes.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in got), key=str) == brute(docs, 400)


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").is_dir(), reason="sample tables are absent")
def test_sample_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = suffixes.remove_repeats(docs).collect()
    counts, texts = Counter(), [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    for _, d in texts:
        counts.update(hash(d[i : i + 400]) for i in range(len(d) - 399))
    expected = []
    for doc_id, d in texts:
        gone = bytearray(len(d))
        for i in range(len(d) - 399):
            if counts[hash(d[i : i + 400])] > 1:
                gone[i : i + 400] = b"\1" * 400
        expected.append((doc_id, bytes(c for c, g in zip(d, gone) if not g)))
    assert sorted((r.doc_id, bytes(r.kept)) for r in got) == sorted(expected)


def test_long_text_in_pieces(monkeypatch):
    import pyarrow as pa

    text = "".join(random.Random(4).choice("abcd ") for _ in range(5000))
    whole = {tuple(row) for row in zip(*(c.tolist() for c in suffixes.anchors_of(pa.array([text]), 40, 20)))}
    monkeypatch.setattr(suffixes, "PIECE_BYTES", 300)
    assert {tuple(row) for row in zip(*(c.tolist() for c in suffixes.anchors_of(pa.array([text]), 40, 20)))} == whole
