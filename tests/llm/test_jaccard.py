import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilcraft.llm import jaccard
from veilcraft.llm.components import components


def shingles(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if 0 < len(found) < words:
        return {tuple(found)}
    return {tuple(found[i : i + words]) for i in range(len(found) - words + 1)}


def brute(docs, words, percent):
    sets, parent = [shingles(text, words) for _, text in docs], list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(docs):
        ids = [docs[j][0] for j in range(len(docs)) if root(j) == root(i) and docs[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids, default=None) if sets[i] else doc_id))
    return sorted(out, key=str)


def corpus(seed, words):
    draw, docs = random.Random(seed), [(-1, None), (-2, ""), (-3, " \n\t"), (-4, "one"), (-5, "ONE"), (-6, "one two"), (-6, "one two"), (None, "one two"), (None, "x y z w")]
    for group in range(12):
        base = [f"w{draw.randrange(3000)}" for _ in range(draw.choice([4, 9, 12, 30, 31, 80, 200, 600]))]
        docs.append((len(docs), " ".join(base)))
        for _ in range(draw.randrange(9)):
            copy = list(base)
            for _ in range(draw.randrange(0, max(2, len(base) // 25))):
                place = draw.randrange(len(copy))
                copy[place : place + draw.randrange(2)] = [f"v{draw.randrange(3000)}"] * draw.randrange(1, 3)
            docs.append((len(docs), draw.choice([" ", "\n ", "\t"]).join(copy)))
    return docs


@pytest.mark.parametrize("words, percent, seed", [(3, 90, 1), (1, 80, 3)])
def test_equals_brute_force(spark, words, percent, seed):
    docs = corpus(seed, words)
    table = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n_shingles string").repartition(3)
    got = sorted(map(tuple, jaccard.near_duplicates(table, words, percent).collect()), key=str)
    assert got == brute(docs, words, percent)
    kept = [r.doc_id for r in jaccard.drop_near_duplicates(table, words, percent).collect()]
    wanted = [c for _, n, c in brute(docs, words, percent) if n] + [-1, -2, -3]
    assert set(kept) - {None} == set(wanted) - {None} and len([k for k in kept if k is not None]) == len(set(kept) - {None})


def test_short_sketches_bound_and_exclude(spark):
    draw = np.random.Generator(np.random.PCG64(8))
    sets = [draw.integers(0, 1 << 64, n, dtype=np.uint64) for n in (3, 500, 600, 1500, 1900, 2100, 9000, 11000, 40000)]
    sets += [np.concatenate((x[: len(x) * 9 // 10], draw.integers(0, 1 << 64, max(1, len(x) // 20), dtype=np.uint64))) for x in sets]
    sketches = [jaccard.short_sketch(x) for x in sets]
    rows = []
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[: i + 1]):
            found = int(jaccard.apart(sketches[i][None], sketches[j][None])[0, 0])
            truly = len(np.setxor1d(x, y))
            assert found <= truly
            rows.append((sketches[i].tolist(), sketches[j].tolist(), found))
            small, large = sorted((len(x), len(y)))
            if i != j and truly > 0.9 * large and 80 * large <= 100 * small and 600 < small < 16000:
                assert found > small / 4  # excluded at a similarity of 0.8
    size = F.least(F.size("a"), F.size("b"))
    words = F.zip_with(jaccard._folded(F.col("a"), size), jaccard._folded(F.col("b"), size), lambda u, v: F.bit_count(u.bitwiseXOR(v)))
    told = spark.createDataFrame(rows, "a array<long>, b array<long>, n int").select("n", F.aggregate(words, F.lit(0), lambda s, x: s + x).alias("m"))
    assert all(r.n == r.m for r in told.collect())


def test_chain_within_one_piece(spark):
    """Sets that share pieces with a leader they are not similar to still link with each other."""
    base = [f"w{i}" for i in range(40)]
    docs = [(n, " ".join(base[: 40 - n] + [f"x{n // 2}_{i}" for i in range(n)])) for n in range(12)]
    docs += [(100 + n, " ".join([f"y{n}"] + base[1:])) for n in range(5)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for percent in (80,):
        assert sorted(map(tuple, jaccard.near_duplicates(table, 2, percent).collect()), key=str) == brute(docs, 2, percent)


def test_bounds_and_empty(spark):
    bands = jaccard.Bands(90)
    assert bands.first == 9 and bands.of(8) == [] and bands.differing(18) == 2
    for small in range(9, 400):
        own = {band: count for band, count in bands.of(small)}
        for large in range(small, small * 100 // 90 + 1):
            met = own.keys() & {band for band, _ in bands.of(large)}
            assert any(own[band] > bands.differing(small) for band in met)
    draw = np.random.Generator(np.random.PCG64(4))
    for percent in (80, 90):  # any two sets that differ as much as similar ones can share a key
        bands = jaccard.Bands(percent)
        for size in [*range(bands.first, 60), *range(60, 900, 37)]:
            for _ in range(6):
                base, gone = draw.integers(0, 1 << 64, size, dtype=np.uint64), bands.differing(size)
                fewer = int(draw.integers(0, gone + 1))
                other = np.concatenate((base[fewer:], draw.integers(0, 1 << 64, gone - fewer, dtype=np.uint64)))
                keys = [np.concatenate([jaccard.pieces(x, band, count, bands.differing(len(x))) for band, count in bands.of(len(x))] or [np.zeros(0, np.uint64)]) for x in (base, other)]
                shared = len(np.intersect1d(base, other))
                if 100 * shared >= percent * (len(base) + len(other) - shared):
                    assert len(np.intersect1d(*keys))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_duplicates(empty).count() == 0 and jaccard.drop_near_duplicates(empty).count() == 0


def test_components(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(60)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    expected = {(x, root(x)) for e in edges if e[0] != e[1] for x in e}
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == expected
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packing_holds_entries_once():
    """What a task hands on is made bucket by bucket: beside the entries, no more than a fraction of them is held."""
    draw = np.random.Generator(np.random.PCG64(6))
    names = draw.integers(-(1 << 62), 1 << 62, 5000)
    keys, owners = draw.integers(0, 1 << 40, 1 << 20, dtype=np.uint64) << np.uint64(8), draw.integers(0, 5000, 1 << 20, dtype=np.uint64)
    keys[::7] = keys[0]
    entries = (keys << jaccard.SET_BITS) | owners
    tracemalloc.start()
    leads, pairs = [], []
    for row in jaccard.packed(entries, names, 64):
        leads.append(len(row["owners"]) // 2), pairs.append(len(row["star_key"]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(leads) == len(np.unique(keys)) and sum(leads) + sum(pairs) > 0.99 * len(keys)
    assert most < entries.nbytes * 1.5  # the crowded key's bucket is a seventh of all entries
