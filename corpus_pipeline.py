"""From raw documents to a tokenised training mix: each stage reads what its predecessor kept, as a written table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilcraft.llm import bpe, jaccard, language, mixing, pii
from veilcraft.llm.common import table
from veilcraft.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that some language's model explains; texts that are null, hold no letter or fit no model go."""
    return language.keep_identified(docs, language.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component by five-word shingles and a Jaccard similarity of 0.8."""
    return jaccard.drop_near_duplicates(docs, words=5, percent=80)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind, and ``n_chars`` of the new texts."""
    redacted = pii.redact_documents(docs)
    return redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else redacted


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids (packed little-endian 32-bit integers) of every text, and the digest of what they decode to."""
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode_documents(docs, vocabulary, public_tokenizers.PATTERN)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("language identification", identify_language),
    ("near-duplicate removal", drop_near_duplicates),
    ("personal data", redact_personal_data),
    ("source mixing", mix_sources),
    ("token encoding", encode),
]

#: No SQL: models, sketches and token merges are not expressible; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
