import math

import numpy as np

from veilcraft.llm import nearvectors


def brute(rows, threshold=0.95):
    usable = [i for i, (_, v) in enumerate(rows) if v and None not in v and all(map(math.isfinite, v)) and any(v)]
    scaled = {i: np.array(rows[i][1], float) / np.abs(rows[i][1]).max() for i in usable}
    units = {i: v / np.linalg.norm(v) for i, v in scaled.items()}
    links = {i: [j for j in usable if j != i and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold] for i in usable}
    out = []
    for i, (vec_id, _) in enumerate(rows):
        reached, waiting = {i}, [i]
        while waiting:
            for j in links.get(waiting.pop(), []):
                if j not in reached:
                    reached.add(j), waiting.append(j)
        least = min((rows[j][0] for j in reached if rows[j][0] is not None), default=None)
        out.append((vec_id, len(links.get(i, [])), least, vec_id == least))
    return sorted(out, key=str)


def test_equals_brute_force_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearvectors, "BLOCK", 4)
    draw, rows = np.random.default_rng(1), []
    for size in (1, 1, 1, 2, 3, 9, 30):
        base = draw.standard_normal(16)
        rows += [(len(rows) + n, list(base + draw.standard_normal(16) * 0.03)) for n in range(size)]
    rows += [(900 + n, list(rows[0][1])) for n in range(6)] + [(950, [2.0 * x for x in rows[0][1]]), (951, [1e-300] * 16), (952, [1e300] * 16)]
    rows += [(960, None), (961, []), (962, [0.0] * 16), (963, [float("nan")] + [1.0] * 15), (964, [None] + [1.0] * 15), (965, [float("inf")] * 16)]
    rows += [(970, [1.0, 2.0]), (971, [1.0, 2.0]), (0, rows[0][1]), (None, rows[0][1]), (None, [0.0, 1.0, 0.0])]
    table = spark.createDataFrame([(i, v and [None if x is None else float(x) for x in v], 1.0) for i, v in rows], "vec_id long, embedding array<double>, weight double").repartition(3)
    assert sorted(map(tuple, nearvectors.near_vectors(table).collect()), key=str) == brute(rows)
    assert nearvectors.near_vectors(table.limit(0)).count() == 0


def test_recall_at_the_threshold():
    """Share of pairs at cosine 0.95 that meet in a table, and what the formula says."""
    draw = np.random.default_rng(2)
    x, y = draw.standard_normal((2, 3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y -= (x * y).sum(axis=1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    other = 0.95 * x + math.sqrt(1 - 0.95**2) * y
    met = (nearvectors.keys_of(x, nearvectors.TABLES) == nearvectors.keys_of(other, nearvectors.TABLES)).any(axis=1).mean()
    one = nearvectors.share_probability(math.sqrt(2 - 2 * 0.95)) ** nearvectors.HASHES
    assert met >= 0.95 and abs(met - (1 - (1 - one) ** nearvectors.TABLES)) < 0.02
