from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilcraft.llm import catalog, language

SF_DIR = Path("/root/testdata/sf0.001")


def models_of(**texts):
    sample = pd.DataFrame([(lang, text, False) for lang, several in texts.items() for text in several], columns=["lang", "text", "held_out"])
    return language.fit(sorted(texts), sample)


def test_probabilities_sum_to_one():
    models = models_of(x=["abcab abba cab", "ab ca"], y=["xyz zyx abz", "zz"])
    letters = [ord(c) for c in "abcxyz ø"]  # ø stands for every character that was not seen
    for context in ("ab ", "zzz", "cab", "  a", "qqq"):
        runs = np.array([[ord(c) for c in context] + [letter] for letter in letters], np.uint32)
        p = np.exp(np.concatenate([models.log_probabilities(run) for run in runs]))
        assert np.allclose(p.sum(axis=0), 1, atol=1e-5)


def test_kneser_ney_by_hand():
    """Bigram level of one language, worked out from the definition."""
    models = models_of(x=["abab", "abc"])
    text = " abab  abc "
    padded = [f"   {'abab '}", f"   {'abc '}"]
    top = {}
    for p in padded:
        for i in range(len(p) - 3):
            top[p[i : i + 4]] = top.get(p[i : i + 4], 0) + 1
    three = {g[1:] for g in top}
    two = {}
    for g in three:
        two[g[1:]] = two.get(g[1:], 0) + 1
    at, known = models.find(2, language.row_hashes(np.array([[ord(c) for c in g] for g in two], np.uint32)))
    assert known.all() and len(models.keys[1]) == len(two) and text
    one = {}
    for g in two:
        one[g[1:]] = one.get(g[1:], 0) + 1
    n1, n2 = sum(c == 1 for c in one.values()), sum(c == 2 for c in one.values())
    d = min(max(n1 / max(1, n1 + 2 * n2), 0.1), 0.95)
    total = sum(one.values())
    even = max(d * len(one) / total, 1e-4) / (len(one) + 1)
    p1 = {c: (k - d) / total + even for c, k in one.items()}
    n1, n2 = sum(c == 1 for c in two.values()), sum(c == 2 for c in two.values())
    d = min(max(n1 / max(1, n1 + 2 * n2), 0.1), 0.95)
    for place, gram in zip(at, two):
        seen = {g: c for g, c in two.items() if g[0] == gram[0]}
        want = (two[gram] - d) / sum(seen.values()) + d * len(seen) / sum(seen.values()) * p1[gram[1]]
        assert np.isclose(np.exp(models.log_p[1][place, 0]), want, rtol=1e-4)


def test_normal_form():
    form = lambda text: "".join(map(chr, language.normal_form(text)))
    assert form("ÉT&&& in%%% 42") == " ét in " and form("42 %") == "" and form("") == "" and form("\u0301 \u0301") == ""


def test_rejects_what_no_model_explains():
    english = ["the cat and the dog sat on the mat and then the rat ran to the hat " * 8] * 6
    french = ["le chat et le chien sont dans la maison avec une souris dans le jardin " * 8] * 6
    rows = [("en", t, i % 3 == 0) for i, t in enumerate(english)] + [("fr", t, i % 3 == 0) for i, t in enumerate(french)]
    models = language.fit(["en", "fr"], pd.DataFrame(rows, columns=["lang", "text", "held_out"]))
    names, scores, _, rejected = models.decide(["the dog sat on the cat", "le chien et la souris", "xq zvk wjx qpz kkvw xzj " * 20, "123 !!", ""])
    assert names[:2] == ["en", "fr"] and names[3:] == ["und", "und"] and list(rejected) == [False, False, True, True, True]
    assert all(0 <= s <= 1 for s in scores) and scores[3] == 0


def test_tables(spark):
    docs = spark.createDataFrame(
        [(1, "the cat sat", "en", 7), (1, "the cat sat", "en", 7), (2, "le chat dort", "fr", 8), (None, None, None, None), (4, "", None, 1), (5, "the " * 200_000, None, 2)],
        "doc_id long, text string, lang string, score int",
    ).repartition(3)
    models = language.train(docs)
    got = language.identify(docs, models)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score", "entropy", "rejected"] and got.count() == 6
    by_id = {r.doc_id: r for r in got.collect()}
    assert by_id[1].lang_pred == by_id[5].lang_pred == "en" and by_id[2].lang_pred == "fr" and by_id[None].lang_pred == by_id[4].lang_pred == "und"
    kept = language.keep_identified(docs, models)
    assert kept.columns == docs.columns and {None, 4}.isdisjoint(r.doc_id for r in kept.collect())
    none = language.train(docs.where("lang is null"))
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}
    assert language.identify(docs.limit(0), models).count() == 0 and language.train(docs.limit(0)).languages == []


@pytest.mark.skipif(not SF_DIR.is_dir(), reason="sample tables are absent")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(str(SF_DIR / "documents.parquet")).select("doc_id", "lang")
    got = catalog.QUERIES["op1_identify_language"](spark, str(SF_DIR)).join(docs, "doc_id").where("held_out and lang is not null")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.98 and got.where("rejected").count() == 0


def test_copies_of_a_text_are_drawn_once(spark, monkeypatch):
    samples = []
    monkeypatch.setattr(language, "fit", lambda languages, sample: samples.append(sample))
    rows = [("one text that many rows hold " * 20, "en")] * 500 + [(f"ein Satz mit der Nummer {i}", "de") for i in range(20)]
    language.train(spark.createDataFrame(rows, "text string, lang string").repartition(3))
    assert sorted(samples[0]["text"]) == sorted(text for text, _ in set(rows))
