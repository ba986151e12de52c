import hashlib
import math
import random
from collections import defaultdict

import pytest

from veilcraft.llm import codes


def brute(rows, parts, entries, rounds):
    usable = [(i, label, [math.floor(256 * max(min(x, 2.0**16), -(2.0**16))) for x in v]) for i, v, label in rows if v and None not in v and all(map(math.isfinite, v)) and len(v) % parts == 0]
    usable.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    usable = [r for r in usable if len(r[2]) == len(usable[0][2])]
    if not usable:
        return []
    width = len(usable[0][2]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, _, v in usable[:entries]] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e)), n) for n, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for _, _, v in usable:
                members[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(x) // len(members[n]) for x in zip(*members[n])] if n in members else e for n, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    told, totals = [], defaultdict(int)
    for i, label, v in usable:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        told.append((i, label, "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found)))
        totals[label] += told[-1][3]
    return sorted(((i, code, error, totals[label], digest) for i, label, code, error in told), key=repr)


def some(seed, n, size):
    draw = random.Random(seed)
    rows = [(i, [draw.gauss(0, 0.3) for _ in range(size)], draw.choice([None, 1, 2])) for i in range(n)]
    rows += [(None, rows[3][1], 1), (3, rows[4][1], None), rows[5], (n, None, 1), (n + 1, [], 1), (n + 2, [None] * size, 1), (n + 3, [float("nan")] + [0.0] * (size - 1), 2)]
    return rows + [(n + 4, [float("inf")] * size, 2), (n + 5, [0.5] * (size + 1), 2), (n + 6, [1e30] + [-1e30] * (size - 1), 2), (-1, [-0.001] * size, 2), (n + 7, [0.5] * (2 * size), None)]


SCHEMA = "vec_id long, embedding array<float>, label int, error string, v int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("n, size, rows_held", [(300, 32, 4096), (20, 16, 7)])
def test_equals_brute_force(spark, monkeypatch, n, size, rows_held):
    monkeypatch.setattr(codes, "SLICE_ROWS", rows_held)
    table = frame(spark, some(n, n, size))
    got = codes.code_digests(table).collect()
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, 16, 64, 2)


def test_no_usable_rows(spark):
    assert codes.code_digests(frame(spark, [])).collect() == []
    assert codes.code_digests(frame(spark, [(1, None, 2), (2, [1.0, 2.0], None)])).collect() == []
    with pytest.raises(ValueError):
        codes.compress(frame(spark, []), entries=257)


def test_decoded_vectors_are_as_far_as_the_error_says(spark):
    rows = some(5, 100, 8)[:100]
    coded, books = codes.compress(frame(spark, rows), parts=4, entries=16, rounds=3)
    wanted = {i: [math.floor(256 * x) for x in r.embedding] for r in frame(spark, rows).collect() for i in [r.vec_id]}
    for r in codes.decoded(coded, books).collect():
        assert sum((a - b) ** 2 for a, b in zip(r.v, wanted[r.vec_id])) == r.error
