"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from msgsearch.llm import (
    block_topk,
    class_model,
    divergence,
    feistel_shards,
    fill_middle,
    histogram_packing,
    host_rules,
    jaccard_groups,
    language_spans,
    oracles,
    piece_codec,
    repeat_removal,
    token_files,
    url_filter,
)


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rules.judge(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return judged.select("doc_id", *host_rules.MEASURES, "base_failed", "kept")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digests(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_topk.embedding_neighbours(_table(spark, sf_dir, "embeddings"))


def op4_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups.linked_documents(_table(spark, sf_dir, "documents"))


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.coded_documents(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op6_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel_shards.sharded_documents(_table(spark, sf_dir, "documents"))


def op7_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_removal.removal_digests(_table(spark, sf_dir, "documents"))


def op8_class_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_model.scored_documents(_table(spark, sf_dir, "documents"))


def op9_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_packing.packed_documents(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_spans.predicted_languages(_table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(_table(spark, sf_dir, "pages"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fill_digests(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_host_rules,
        op2_token_files,
        op3_block_topk,
        op4_jaccard_groups,
        op5_piece_codec,
        op6_feistel_shards,
        op7_repeat_removal,
        op8_class_model,
        op9_histogram_packing,
        op10_language_spans,
        op11_divergence,
        op12_url_filter,
        op13_fill_middle,
    )
}
# Tokens, hashes of 32 bits by a polynomial, and fitted models are beyond SQL; tests hold those queries
# against brute force.
ORACLES: dict[str, str] = {
    "op1_host_rules": oracles.HOST_RULES,
    "op3_block_topk": oracles.BLOCK_TOPK,
    "op4_jaccard_groups": oracles.JACCARD_GROUPS,
    "op7_repeat_removal": oracles.REPEAT_REMOVAL,
    "op11_divergence": oracles.DIVERGENCE,
    "op13_fill_middle": oracles.FILL_MIDDLE,
}
