from veilcraft.llm import sentences


def test_sentences():
    text = " One two.  Three 3.14 is pi!? Yes\nno end "
    assert [s for s, _, _ in sentences.sentences(text)] == ["One two.", "Three 3.14 is pi!?", "Yes", "no end"]
    assert "".join(text[a:b] for _, a, b in sentences.sentences(text)) == text.lstrip()
    assert sentences.sentences("") == [] and [s for s, _, _ in sentences.sentences("..")] == [".."]


def brute(docs, run=3, long_words=50, least_words=20):
    places = {}
    for n, (_, text) in enumerate(docs):
        found = sentences.sentences(text or "")
        for i in range(len(found)):
            sizes = [len(" ".join(s for s, _, _ in found[i:j]).split()) for j in range(i + 1, min(i + max(run, least_words), len(found)) + 1)]
            ends = next((k for k, size in enumerate(sizes, 1) if k >= run and size >= least_words), None)
            for k in [k for k, size in enumerate(sizes[: run - 1], 1) if size >= long_words] + [ends] * (ends is not None):
                places.setdefault(tuple(s for s, _, _ in found[i : i + k]), []).append((n, i, k))
    out = []
    every, gone = [set() for _ in docs], [set() for _ in docs]
    for met in places.values():
        for at, (n, i, k) in enumerate(met):
            every[n] |= set(range(i, i + k)) if len(met) > 1 else set()
            gone[n] |= set(range(i, i + k)) if at else set()
    for n, (doc_id, text) in enumerate(docs):
        found = sentences.sentences(text or "")
        kept = text[: found[0][1]] + "".join(text[a:b] for i, (_, a, b) in enumerate(found) if i not in gone[n]) if gone[n] else text
        out.append((doc_id, len(found), len(every[n]), len(gone[n]), kept))
    return out


def test_equals_brute_force(spark):
    passage = "First of it. Second of it. Third of it. Fourth of it."
    varied = " ".join(f"Sentence {n} tells of some more." for n in range(6))
    long = "word " * 60 + "end."
    docs = [(1, f"Alone. {passage} Tail."), (2, f"Other start.\n{passage}  Rest of two."), (3, "A. B. C. A. B. C. D."), (4, f"X {long} Y."), (5, f"{long}"), (6, f"Z. {long}"),
            (7, ""), (8, None), (9, "A. B."), (10, "A. B."), (11, passage), (12, "  " + passage + "\n"), (13, "Same row. Same two. Same three."), (13, "Same row. Same two. Same three."),
            (14, "Once. Twice. Thrice. " * 1500), (15, f"Ahead. {varied} Behind."), (16, f"{varied} More.\nOther"), (17, " ".join(f"W{n}!" for n in range(60))), (18, "X. " + " ".join(f"W{n}!" for n in range(60)))]
    table = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, kept string").repartition(4)
    for least in (20, 0):
        got = sorted(map(tuple, sentences.remove_spans(table, least_words=least).collect()), key=str)
        assert got == sorted(brute(docs, least_words=least), key=str)
    assert sentences.remove_spans(table.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, passage), (1, passage)], "doc_id long, text string")
    assert {(r.doc_id, r.n_removed) for r in sentences.remove_spans(nulls, least_words=9).collect()} == {(1, 0), (None, 4)}
