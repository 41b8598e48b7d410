"""One query per training-data operator, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.filter_audit import audit_filters
from flowloom.llm.jaccard import jaccard_components
from flowloom.llm.langid import identify_languages
from flowloom.llm.mixing import mix_plan
from flowloom.llm.neighbours import nearest_neighbours
from flowloom.llm.packing import pack_documents
from flowloom.llm.quality import quality_scores
from flowloom.llm.quotes import link_quotations, quoted_mail
from flowloom.llm.substrings import drop_repeated_passages
from flowloom.llm.token_counts import token_counts
from flowloom.llm.token_store import token_output
from flowloom.llm.tokens import vocabulary_path
from flowloom.llm.vector_codes import compress_vectors
from flowloom.llm.vector_dedup import near_duplicate_vectors


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir), vocabulary_path("word_bpe_49k.json")).drop("ids")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(_documents(spark, sf_dir), vocabulary_path("byte_bpe_50k.json"))


def op5_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as mail that quotes the two before it; then linked and stripped again."""
    out = link_quotations(quoted_mail(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return out.withColumn("clean_sha256", F.sha2("clean_text", 256)).drop("clean_text")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_documents(spark, sf_dir))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_passages(_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_documents(spark, sf_dir))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_documents(spark, sf_dir))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_documents(spark, sf_dir), vocabulary_path("word_bpe_49k.json"))


def op12_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_token_output": op4_token_output,
    "op5_quotation_linking": op5_quotation_linking,
    "op6_language_id": op6_language_id,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_source_mixing": op9_source_mixing,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_token_counts": op11_token_counts,
    "op12_vector_code_compression": op12_vector_code_compression,
    "op13_filter_interaction_audit": op13_filter_interaction_audit,
}
