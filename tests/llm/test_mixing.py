from collections import Counter, defaultdict

from pyspark.sql import functions as F

from veilcraft.llm import mixing

SCHEMA = "doc_id long, text string, source string, hash string, size string, __mix_size int"


def rows():
    told = [(n, "word " * (1 + n % 13), "hot" if n % 3 else f"s{n % 5}") for n in range(1200)]
    told += [(n, "long " * 400, "s1") for n in range(1200, 1203)]
    told += [(None, "no id here", "s2"), (None, None, "s2"), (5000, None, "hot"), (5001, "", "hot"), (5002, "no source of its own", None), (5003, "again", None)]
    told += [(7000, "equal rows stay together", "twin")] * 3 + [(8000, None, "only nulls")]
    return [(*row, "h", "s", 1) for row in told]


def targets(sizes):
    """Shares by weight, what is above a cap reshared until none is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: n % 3 + 1 for n, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        told = {s: 3 * sizes[s] if s in capped else rest * weight[s] / free for s in order}
        above = {s for s in order if s not in capped and told[s] > 3 * sizes[s]}
        if not above:
            return told
        capped |= above


def test_mixture_meets_its_targets(spark):
    listed = rows()
    docs = spark.createDataFrame(listed, SCHEMA).repartition(5)
    told = mixing.mixture(docs).collect()
    assert Counter((r.doc_id, r["size"]) for r in told) == Counter((r[0], len((r[1] or "").split())) for r in listed)
    sizes = defaultdict(int)
    for _, text, source, *_ in listed:
        sizes[source] += len((text or "").split())
    want = targets(sizes)
    source_of = {(r[0], len((r[1] or "").split())): r[2] for r in listed}
    taken = defaultdict(int)
    for r in told:
        source = source_of[r.doc_id, r["size"]]
        assert r.source_size == sizes[source] and abs(r.target - want[source]) < 1e-6
        assert r.taken == r.copies * r["size"] <= 3 * r["size"] and (r["size"] or r.copies == 0 or r.taken == 0)
        taken[source] += r.taken
    largest = defaultdict(int)
    for _, text, source, *_ in listed:
        largest[source] = max(largest[source], len((text or "").split()))
    for source, words in taken.items():
        bound = 3 * largest[source] if source == "twin" else largest[source]
        assert abs(words - want[source]) <= bound, source
    assert len({r.copies for r in told if r.doc_id == 7000}) == 1
    assert sorted(map(str, told)) == sorted(map(str, mixing.mixture(docs.repartition(3)).collect()))


def test_documents_as_often_as_planned_with_clashing_columns(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).drop("__mix_size")
    plan = Counter()
    for r in mixing.mixture(docs).collect():
        plan[r.doc_id, r["size"]] += r.copies if r["size"] else 0
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    got = Counter((r.doc_id, len((r.text or "").split())) for r in mixed.collect())
    assert {k: n for k, n in got.items() if k[1]} == {k: n for k, n in plan.items() if n}


def test_empty_table_and_one_source(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    assert mixing.mixture(docs.limit(0)).count() == 0
    alone = mixing.mixture(docs.where("source = 'twin'")).collect()
    assert [(r.copies, r.taken, r.target) for r in alone] == [(1, 4, 12.0)] * 3
    assert {r.taken for r in mixing.mixture(docs.where(F.col("text").isNull())).collect()} == {0}
