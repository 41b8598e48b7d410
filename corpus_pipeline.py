"""From raw documents to packed sequences: five stages, each written and read again.

Language ID, n-gram Jaccard join, substring dedup, mixing to source weights, best-fit packing.
Every stage works on all rows that its predecessor kept; all but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import row_key, stored
from flowloom.llm.jaccard import jaccard_components
from flowloom.llm.langid import UNKNOWN, identify_languages
from flowloom.llm.mixing import mix
from flowloom.llm.packing import pack_documents
from flowloom.llm.substrings import drop_repeated_passages
from flowloom.llm.tokens import vocabulary_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, which have no language, go."""
    decided = identify_languages(docs, keep=docs.columns)
    return decided.where(F.col("lang_pred") != UNKNOWN).select("kept.*")


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies stays."""
    rows, key = row_key(docs, "doc_id", "text")
    decided = jaccard_components(rows, key).where(F.col(key) != F.col("component_id")).select(key)
    gone = F.col(f"l.{key}") == F.col(f"r.{key}")
    return rows.alias("l").join(decided.alias("r"), gone, "left_anti").select(*[f"l.`{c}`" for c in docs.columns])


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occurred before are cut out; a document that loses its last word goes."""
    cut = drop_repeated_passages(docs, keep=[c for c in docs.columns if c != "text"])
    cut = cut.where("n_removed = 0 OR n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    columns = {"text": text, "n_chars": F.length(text).cast("long")}
    return cut.select(*[(columns[c] if c in columns else F.col("kept")[c]).alias(c) for c in docs.columns])


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget takes them."""
    return mix(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece with its ids and its place."""
    return pack_documents(docs, vocabulary_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard_join", one_per_group),
    ("substring_dedup", without_repeats),
    ("source_mixing", mixed_sources),
    ("best_fit_packing", packed_sequences),
]

# Tokenizer and classifier have no SQL form; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
