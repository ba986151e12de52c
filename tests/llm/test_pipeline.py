import hashlib
from collections import Counter
from pathlib import Path

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from test_jaccard import brute
from veilcraft.llm import bpe, pii
from veilcraft.llm.common import table

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="sample tables are absent")
def test_stages_equal_brute_force(spark, tmp_path):
    docs, kept = table(spark, SF_DIR, "documents"), []
    columns = docs.columns
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        assert n == 4 or docs.columns == columns
        kept.append(docs.collect())
    raw, (identified, unique, clean, mixed, coded) = table(spark, SF_DIR, "documents").collect(), kept
    assert Counter(identified) == Counter(r for r in raw if any(map(str.isalpha, r.text or "")))
    components = brute([(r.doc_id, r.text) for r in identified], 5, 80)
    assert {r.doc_id for r in unique} == {c for _, _, c in components} and len(unique) == len({c for _, _, c in components})
    assert {(r.doc_id, r.text, r.n_chars) for r in clean} == {(r.doc_id, t := pii.redacted(r.text), len(t)) for r in unique}
    assert not any("@" in r.text and pii.Finder().find(r.text)["email"] for r in clean)
    size = {r.doc_id: len(r.text.encode().split()) for r in clean}
    of_source, taken = Counter(), Counter()
    for r in clean:
        of_source[r.source] += size[r.doc_id]
    for r in mixed:
        taken[r.source] += size[r.doc_id]
    assert max(Counter(r.doc_id for r in mixed).values()) <= 3
    level, capped = 0.0, set()
    weight = {s: 1 + i % 3 for i, s in enumerate(sorted(of_source))}
    while True:
        level = (sum(of_source.values()) - sum(3 * of_source[s] for s in capped)) / sum(w for s, w in weight.items() if s not in capped)
        more = {s for s in of_source if s not in capped and level * weight[s] > 3 * of_source[s]}
        if not more:
            break
        capped |= more
    for s in of_source:
        target = min(3 * of_source[s], level * weight[s])
        assert target - max(size.values()) <= taken[s] <= target + 1
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    text = {r.doc_id: r.text for r in clean}
    assert Counter(r.doc_id for r in coded) == Counter(r.doc_id for r in mixed)
    for r in coded:
        ids = library.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
        assert bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in ids)


def test_awkward_rows_pass_every_stage(spark):
    rows = [(1, "the cat sat on the mat", "en", "a", 22, 1), (1, "the cat sat on the mat", "en", "a", 22, 1), (None, None, None, None, None, 2), (3, "", "en", "b", 0, 3),
            (None, "le chat dort dans la maison", "fr", None, 27, None), (5, "x@y.org " * 20_000, "en", "a", 160_000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, hash int")
    for some in (docs, docs.limit(0)):
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, some, SF_DIR)
            assert n == 4 or out.columns == docs.columns
            some = spark.createDataFrame(out.toArrow()) if out.count() else out
