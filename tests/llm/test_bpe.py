import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from veilcraft.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    return bpe.Encoder(bpe.load_ranks(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def ids(coder, text):
    return np.frombuffer(coder.encode(text), "<u4").tolist()


@pytest.mark.parametrize("alphabet", ["ab", "abcdeé ", "the  \n\tin'sx", "日本語のテキスト", "🙂é漢a", "0123 45", "ßüöäéñ", "   a\n　"])
def test_equals_library(coder, library, alphabet):
    draw = random.Random(alphabet)
    for size in (0, 1, 2, 7, 13, 60, 300):
        text = "".join(draw.choice(alphabet) for _ in range(size))
        assert ids(coder, text) == library.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_equals_library_on_any_text(coder, library, text):
    assert ids(coder, text) == library.encode_ordinary(text)
    assert coder.decode(coder.encode(text)) == text.encode()


def test_joins_and_heap_agree_with_plain_merging(coder):
    draw = random.Random(7)
    for size in (20, 90, 97, 400):
        piece = bytes(draw.choice(b"abthe\xc3\xa9") for _ in range(size))
        plain = coder.merged_by_heap(piece)
        assert coder.encoded(piece) == plain and b"".join(plain) == piece


def test_long_pieces_and_parts(coder, library, monkeypatch):
    text = "a" * 4000 + " " + "ab" * 2000 + "  \n x" + "word 's\t" * 500
    expected = library.encode_ordinary(text)
    assert ids(coder, text) == expected
    monkeypatch.setattr(bpe, "PART_CHARS", 16)
    assert "".join(bpe.cut(text, 16)) == text and ids(coder, text) == expected
    assert len(ids(coder, "b" * 200_000)) > 0


def test_tables(spark, library):
    docs = spark.createDataFrame(
        [(1, "The same. text", 1), (1, "The same. text", 1), (None, None, 2), (3, "", 3), (4, "é" * 50_000, None)], "doc_id long, text string, ids int"
    )
    rows = bpe.token_digests(docs, PATH, public_tokenizers.PATTERN).collect()
    assert len(rows) == 5
    for row in rows:
        text = {1: "The same. text", 4: "é" * 50_000}.get(row.doc_id, "")
        expected = np.array(library.encode_ordinary(text), "<u4")
        assert row.n_tokens == len(expected) and row.ids_sha256 == hashlib.sha256(expected.tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.token_digests(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_workers_keep_nothing_of_a_task(spark):
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.createDataFrame([(n, f"some words of {n} and others") for n in range(64)], "doc_id long, text string").repartition(16)
    assert bpe.encode_documents(docs, vocabulary, public_tokenizers.PATTERN).count() == 64

    def held(batches):
        for batch in batches:
            coder = bpe.encoder(vocabulary, public_tokenizers.PATTERN)
            yield pa.RecordBatch.from_arrays([pa.array([len(coder.packed) + len(coder.spaced) + len(coder.stable)] * batch.num_rows)], ["n"])

    assert {r.n for r in docs.select("doc_id").mapInArrow(held, "n long").collect()} == {0}
