"""The registered queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from priorline.llm.bpe import round_trip
from priorline.llm.conversation_trie import TRIE_SQL, prefix_nodes
from priorline.llm.decontamination import leaks
from priorline.llm.fill_middle import FILL_SQL, fill_in_middle_digests
from priorline.llm.fingerprints import edit_fingerprints
from priorline.llm.html_text import extract_main_text
from priorline.llm.lines import dedup_lines
from priorline.llm.near_duplicates import near_duplicate_classes
from priorline.llm.personal_data import find_personal_data
from priorline.llm.quality import select_documents
from priorline.llm.secrets import scan_secrets
from priorline.llm.super_minhash import near_duplicates
from priorline.llm.url_filter import JUDGE_SQL, judge_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).drop("component")


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprints(table(spark, sf_dir, "documents"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op11_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle_digests(table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_nodes(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_url_filter, op2_document_fingerprints, op3_bpe_round_trip, op4_jaccard_join, op5_quality_classifier,
        op6_line_dedup, op7_benchmark_decontamination, op8_secret_scan, op9_personal_data, op10_html_extraction,
        op11_super_minhash, op12_fill_in_middle, op13_conversation_trie,
    )
}
SQL: dict[str, str] = {
    "op1_url_filter": JUDGE_SQL, "op12_fill_in_middle": FILL_SQL, "op13_conversation_trie": TRIE_SQL,
}
