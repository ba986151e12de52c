import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilcraft.llm import scoring
from veilcraft.llm.common import fold


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + ["</s>"]


def brute(docs):
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs}
    counts = Counter(w for i, t in docs if not held[i] for w in words(t))
    n, v = sum(counts.values()), len(counts)
    return {i: (held[i], len(words(t)), sum(counts[w] > 0 for w in words(t)), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t))) for i, t in docs}


@pytest.mark.parametrize("head", [1 << 19, 6, 0])
def test_base_equals_brute_force(spark, head):
    draw = np.random.default_rng(5)
    docs = [(i, " ".join(f"W{draw.zipf(1.4) % 400}" for _ in range(draw.integers(0, 60)))) for i in range(80)] + [(200, None), (201, ""), (202, "é É z z never-seen")]
    table = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, score int").repartition(3)
    got = scoring.score_texts(table, fold(F.col("doc_id"), 5) != 1, head_size=head, classes=8).collect()
    want = brute(docs)
    assert len(got) == len(docs)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4] and abs(r.base_score - want[r.doc_id][4]) < 1e-6
        assert r.score < 0


def test_class_probabilities_sum_to_one():
    draw = np.random.default_rng(1)
    kept, deleted = draw.poisson(0.4, (2, 6, 6, 6)).astype(float)
    kept[2], deleted[3], kept[:, 4], deleted[:, 4] = 0, 0, 0, 0
    assert np.allclose((10.0 ** scoring.log_model(kept, deleted)).sum(axis=2), 1)
    assert np.allclose((10.0 ** scoring.log_model(kept * 0, kept * 0)).sum(axis=2), 1)


def test_expectation_maximisation_raises_the_likelihood():
    draw = np.random.default_rng(2)
    truth = draw.dirichlet(np.full(6, 0.2), (6, 6))
    kept, deleted = (draw.poisson(40 * truth).astype(float) for _ in range(2))
    shares, seen = scoring.estimates(kept)
    likelihood = []
    for rounds in (0, 1, 5, 30):
        weights = scoring.mixture_weights(kept, deleted, rounds)
        p = sum(share * weights[seen, k][:, :, None] for k, share in enumerate(shares))
        likelihood.append((deleted * np.log(p)).sum())
    assert likelihood == sorted(likelihood) and likelihood[-1] > likelihood[0]


def test_model_beats_base_where_context_tells(spark):
    docs = [(i, " ".join(["red", "fox", "blue", "sky"] * 12)) for i in range(60)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = scoring.score_texts(table, fold(F.col("doc_id"), 5) != 1, classes=8).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.5 * got[1]
    same = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "b")], "doc_id long, text string")
    rows = scoring.score_texts(same, F.lit(True)).collect()
    assert len(rows) == 3 and len({(r.doc_id, r.score) for r in rows}) == 2
    none = scoring.score_texts(same, F.lit(False), classes=4).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and abs(r.base_score) < 1e-9 for r in none)
    assert scoring.score_texts(same.limit(0), F.lit(True)).count() == 0


def brute_grams(texts):
    found = [Counter(), Counter(), Counter()]
    for text in texts:
        padded = ["</s>", "</s>", *words(text)]
        for i in range(2, len(padded)):
            for k in range(3):
                found[k][tuple(padded[i - k : i + 1])] += 1
    return found


@pytest.mark.parametrize("chunk_bytes, range_bytes", [(12 << 20, 8 << 20), (60, 40)])
def test_counts_of_all_ngrams_equal_brute_force(spark, chunk_bytes, range_bytes):
    draw = np.random.default_rng(7)
    texts = [" ".join(f"w{draw.zipf(1.3) % 90}" for _ in range(draw.integers(0, 40))) for _ in range(70)] + [None, "", "a", "a b"]
    uses = [i % 3 for i in range(len(texts))]
    rows = spark.createDataFrame([(i, t, u > 0, u) for i, (t, u) in enumerate(zip(texts, uses))], "doc_id long, text string, training boolean, use int").repartition(3)
    stored = scoring.materialize(scoring.chunks(rows, chunk_bytes).withColumn("chunk", F.monotonically_increasing_id()), "test-chunks")
    answers = scoring.replies(scoring.requests(stored, 1 + sum(len(t or "") for t in texts) // range_bytes)).toArrow()
    want = {"totals": brute_grams(t for t, u in zip(texts, uses) if u), "kept": brute_grams(t for t, u in zip(texts, uses) if u == scoring.KEPT)}
    seen = 0
    for chunk in stored.collect():
        answer = answers.filter(scoring.pc.equal(answers["chunk"], chunk.chunk))
        hashes, begins = scoring.chunk_tokens(chunk.docs)
        ids = [i for batch in scoring.opened(chunk.docs) for i in batch.column("doc_id").to_pylist()]
        for column in ("totals", "kept") if chunk.use == scoring.DELETED else ("totals",):
            got = scoring.token_counts(scoring.grams(hashes, begins), answer, column)
            for at, i in enumerate(ids):
                padded = ["</s>", "</s>", *words(texts[i])]
                for k in range(3):
                    assert got[k, begins[at] : begins[at + 1]].tolist() == [want[column][k][tuple(padded[j - k : j + 1])] for j in range(2, len(padded))]
        seen += len(ids)
    assert seen == len(texts)


def test_order_of_words_outside_the_classes_counts(spark):
    docs = [(i, "common " * 20 + "rare words meet here " * 2) for i in range(40)] + [(100, "common rare words meet here"), (101, "common rare meet words here"), (102, "common words rare meet here")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    for sizes in ({}, {"chunk_bytes": 100, "range_bytes": 50}):
        got = {r.doc_id: r.score for r in scoring.score_texts(table, F.col("doc_id") < 100, classes=3, **sizes).collect()}
        assert got[100] > got[101] + 1 and got[100] > got[102] + 1


def test_word_weights_follow_the_better_estimate():
    cells = np.array([[5, 12, scoring.NEVER], [5, scoring.NEVER, 8], [7, scoring.NEVER, scoring.NEVER]])
    weights = scoring.word_weights(cells, np.array([90, 10, 50]))
    assert np.allclose(weights.sum(axis=1), 1) and weights[5, 0] > 0.8 and weights[7, 2] > 0.9 and weights[0].tolist() == [0, 0, 1]
