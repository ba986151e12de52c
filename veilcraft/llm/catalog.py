"""The registered queries of this folder and, where SQL can express them, the same results in SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilcraft.llm import bpe, codes, contamination, jaccard, language, mixing, nearvectors, pii, scoring, search, sentences, suffixes, variants
from veilcraft.llm.common import fold, table
from veilcraft.llm.oracles import ORACLES as ORACLES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


@query
def op1_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three of four folds."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold(F.col("doc_id"), 4) == 2)
    models = language.train(docs.where("not held_out"))
    return language.identify(docs.select("doc_id", "held_out", "text"), models).drop("text")


@query
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document gives to a mix of all sources by weight."""
    mixed = mixing.mixture(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of vectors at a cosine of 0.95 or more."""
    return nearvectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op3_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of strings of 400 bytes that also start elsewhere."""
    cleaned = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return cleaned.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op4_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents by BM25 for every document whose id is divisible by 100, with its whole text as the query."""
    docs = table(spark, sf_dir, "documents")
    return search.search(docs, docs.where("doc_id % 100 = 0"))


@query
def op5_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose three-word shingle sets have a Jaccard similarity of 0.9 or more."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=90)


@query
def op6_find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.find_pii(table(spark, sf_dir, "documents"))


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as tokens of a public vocabulary, and back."""
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.token_digests(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)


@query
def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier place has."""
    cleaned = sentences.remove_spans(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_sentences", "n_repeated", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


@query
def op10_score_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document, learned from four of five folds."""
    return scoring.score_texts(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5) != 1)


@query
def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of every document stand in a window of ten words of a benchmark item, and which items those are."""
    found = contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda total, run: total + run["end"] - run["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated")
    )


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as sixteen codes of one byte, and what that loses."""
    return codes.code_digests(table(spark, sf_dir, "embeddings"))


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of seven letters or more with their near words, forms and roots; one in 31 pairs of document and word loses a letter."""
    run = variants.runs(table(spark, sf_dir, "documents").select("doc_id", "text"), 7)
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run")
    hashed = run.select("run", F.crc32(named.cast("binary")).alias("h"))
    place = F.col("h") % F.length("run")
    shorter = F.concat(F.substring("run", F.lit(1), place.cast("int")), F.substring("run", (place + 2).cast("int"), F.length("run")))
    words = variants.counted(hashed, F.when(F.col("h") % 31 == 0, shorter).otherwise(F.col("run")), 7, 2)
    return variants.variants(words)
