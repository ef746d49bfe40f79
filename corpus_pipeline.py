"""A corpus from raw documents to packed training sequences, stage by stage.

Each stage takes the documents that the one before kept, written as Parquet and read again, and returns
documents (``COLUMNS``; other columns are left behind); the last returns where each piece of each document
lies in the packed sequences. Nulls count as the stage's operator defines: a null or wordless text is
rejected by the first stage, a null source is no host, a null doc_id sorts first. Repeated rows are copies
of each other. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from msgsearch.llm import histogram_packing, host_rules, jaccard_groups, language_spans, repeat_removal
from msgsearch.llm.common import small_batches
from msgsearch.llm.queries import vocabulary
from msgsearch.session import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes when less than this share of its words is in its main language.
LEAST_SHARE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; ``lang`` becomes the predicted one."""
    small_batches(spark)
    own = docs.select(COLUMNS)
    found = language_spans.identify(own, language_spans.fit(own.select("text", "lang", "doc_id")))
    kept = found.where((F.col("lang_pred") != language_spans.UNKNOWN) & (F.col("score") >= LEAST_SHARE))
    return kept.withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host does not fail as a whole."""
    small_batches(spark)
    return host_rules.passing(docs.select(COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    small_batches(spark)
    return jaccard_groups.one_of_each(docs.select(COLUMNS), shingle=5, percent=80).select(COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that occur again; those with no word left go."""
    small_batches(spark)
    own = docs.select(COLUMNS)
    found = repeat_removal.remove_repeats(own).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    length = F.length("text").cast(own.schema["n_chars"].dataType)
    return found.withColumn("n_chars", F.when(F.col("n_removed") > 0, length).otherwise(F.col("n_chars"))).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1,024 tokens."""
    small_batches(spark)
    return histogram_packing.packed_documents(docs.select(COLUMNS), vocabulary("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("passages", passages),
    ("packing", packing),
]
#: The tokens of the last stage and the language model of the first are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
