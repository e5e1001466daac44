"""The queries of this subpackage: one opN_<name> for each operator, over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stackloom.llm import sql
from stackloom.llm.centroid_clustering import cluster_vectors
from stackloom.llm.chat_format import rotate_perspectives
from stackloom.llm.collocations import collocations
from stackloom.llm.decontamination import benchmark_leaks
from stackloom.llm.jaccard_join import near_duplicate_components
from stackloom.llm.language_id import predict_language
from stackloom.llm.language_id import train as train_languages
from stackloom.llm.line_dedup import dedup_lines
from stackloom.llm.mixing import mix_plan
from stackloom.llm.quality_crf import score_quality, train
from stackloom.llm.quality_rules import quality_rules
from stackloom.llm.session import table
from stackloom.llm.suffix_dedup import remove_repeats
from stackloom.llm.token_packing import pack_tokens
from stackloom.llm.warc import round_trip


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(table(spark, sf_dir, "conversations"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op4_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tokens(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", *(f"quality.{c}" for c in names))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = round_trip(table(spark, sf_dir, "pages"), min_bytes=0)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), length=200, keep_bytes=False)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), min_chars=20, min_docs=3, keep_text=False)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict_language(docs, train_languages(docs))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_token_packing": op4_token_packing,
    "op5_quality_rules": op5_quality_rules,
    "op6_warc": op6_warc,
    "op7_source_mixing": op7_source_mixing,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_line_dedup": op10_line_dedup,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_language_id": op12_language_id,
    "op13_phrase_collocations": op13_phrase_collocations,
}

ORACLE_SQL = {
    "op2_chat_formatting": sql.OP2,
    "op3_ngram_jaccard_join": sql.OP3,
    "op5_quality_rules": sql.OP5,
    "op6_warc": sql.OP6,
    "op7_source_mixing": sql.OP7,
    "op8_suffix_dedup": sql.OP8,
    "op10_line_dedup": sql.OP10,
    "op11_centroid_clustering": sql.OP11,
    "op13_phrase_collocations": sql.OP13,
}
