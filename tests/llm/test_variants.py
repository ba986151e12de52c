import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilcraft.llm import variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=10):
    told, form = [], {}
    for w, n in counts.items():
        found = sorted((-counts[x], x) for x in counts if near(w, x))
        form[w] = found[0][1] if found and -found[0][0] >= ratio * n else None
        told.append((w, n, len(found)))
    out = []
    for w, n, count in told:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, count, counts[form[w]] if form[w] else None))
    return sorted(out)


def vocabulary(seed, letters="abé", lengths=(1, 12), n=250):
    draw = random.Random(seed)
    words = {"".join(draw.choice(letters) for _ in range(draw.randint(*lengths))) for _ in range(n)}
    for w in list(words)[:60]:  # chains of near words
        for _ in range(3):
            i = draw.randrange(len(w) + 1)
            w = draw.choice([w[:i] + w[i + 1 :], w[:i] + draw.choice(letters) + w[i:], w[:i] + draw.choice(letters) + w[i + 1 :]])
            words.add(w)
    return {w: draw.choice([1, 2, 3, 40, 700, 9000, 100000]) for w in words - {""}}


@pytest.mark.parametrize("seed, group, letters, lengths", [(1, 1 << 13, "abé", (1, 12)), (2, 4, "abé", (1, 12)), (3, 20, "ab", (1, 9)), (4, 70, "abcdefghijklmnopqrstuvwxyzàÿ÷×", (7, 8)), (5, 1 << 13, "ab", (4, 9))])
def test_equals_brute_force(spark, seed, group, letters, lengths):
    counts = vocabulary(seed, letters, lengths)
    rows = [(w, n // 2) for w, n in counts.items()] + [(w, n - n // 2) for w, n in counts.items()] + [(None, 5), ("", 3)]
    got = variants.variants(spark.createDataFrame(rows, "word string, n long").repartition(3), group=group).collect()
    assert sorted(tuple(r) for r in got) == brute(counts)


def test_small_steps_and_tables(spark, monkeypatch):
    monkeypatch.setattr(variants, "STEP", 5)
    monkeypatch.setattr(variants, "CELLS", 300)
    counts = vocabulary(7)
    got = variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert sorted(tuple(r) for r in got) == brute(counts)


def test_long_words_and_empty_table(spark):
    long = "abcdefghij" * 300
    counts = {long: 50, long[:-1]: 2, long[:1500] + "z" + long[1500:]: 5, long[1:]: 1, "x" + long[1:]: 1}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert sorted(tuple(r) for r in variants.variants(table).collect()) == brute(counts)
    assert variants.variants(table.limit(0)).collect() == []


def test_runs_and_counts(spark):
    docs = spark.createDataFrame([(1, "Straßen, STRASSEN straßen"), (2, None), (None, ""), (3, "×÷abcdefĀ abcdefgh")], "doc_id long, text string")
    run = variants.runs(docs, 7)
    assert Counter(r.run for r in run.collect()) == Counter({"straßen": 2, "strassen": 1, "×÷abcdef": 1, "abcdefgh": 1})
    assert [tuple(r) for r in variants.counted(run, F.col("run"), 7, 2).collect()] == [("straßen", 2)]
