"""The registered queries of the corpus operators: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, conversations, html, language_model, lengths, neardup, packing, pii, quality, sharding, spelling, tokens, toxicity
from .common import read


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract(pages).select("page_id", "url", "text", "n_chars")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, by patterns and by the random field."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, redact=False)
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op3_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return neardup.find(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth."""
    return ann.nearest(read(spark, sf_dir, "embeddings"))


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document."""
    placed = sharding.place(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op6_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens by encoded length, for every context limit."""
    docs = read(spark, sf_dir, "documents").select("text")
    return lengths.histogram(lengths.encoded_lengths(docs, tokens.public("byte_bpe_50k.tiktoken")))


def op7_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, tokens.public("word_bpe_49k.json"), with_ids=False)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes they decode to."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, tokens.public("byte_bpe_50k.tiktoken"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calibrated score for every document, learned outside the held-out fold."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = toxicity.train(docs, read(spark, sf_dir, "labels"))
    held_out = F.coalesce(toxicity.fold(F.col("doc_id")) == 0, F.lit(False))
    return scorer.score(docs).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of line-first cleaning for every document."""
    judged = quality.judge(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "n_lost_words", "base_failed", "kept",
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after damage: its faults and its cheapest repair."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversations.repair(conversations.damaged(rows))


def op12_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log-likelihood of every document by the network and by counts."""
    scored = language_model.score(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the damaged documents with its form and the root of its chain."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.variants(spelling.word_counts(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_main_text": op1_html_main_text,
        "op2_personal_data": op2_personal_data,
        "op3_minhash_near_duplicates": op3_minhash_near_duplicates,
        "op4_nearest_vectors": op4_nearest_vectors,
        "op5_hilbert_shards": op5_hilbert_shards,
        "op6_token_lengths": op6_token_lengths,
        "op7_hierarchical_packing": op7_hierarchical_packing,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_toxicity": op9_toxicity,
        "op10_quality_rules": op10_quality_rules,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_language_model": op12_language_model,
        "op13_spelling_variants": op13_spelling_variants,
        "pipeline": corpus_pipeline.run,
    }
