"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread by the next.

Quality classifier, line dedup, n-gram Jaccard join, benchmark decontamination and BPE encoding, in this
order. The first four return rows of documents with all their columns; the last one the token digests
of each document that is left.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from priorline.llm.bpe import round_trip
from priorline.llm.decontamination import without_leaks
from priorline.llm.lines import without_repeated_lines
from priorline.llm.near_duplicates import one_of_each_class
from priorline.llm.quality import fit_model, select
from priorline.sources.durable import durable, scratch_tables

TOKENIZER = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on those of them with labels, accepts."""
    return select(docs, fit_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier one; those with nothing of their own left go."""
    return without_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the smallest id."""
    return one_of_each_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's token ids, and the digest of the text that they decode to."""
    return round_trip(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]
#: The stages train a model, join by similarity and tokenize: SQL cannot express them. Tests compare
#: the rows with brute-force versions instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        # A stage's own tables go once its result is written.
        with scratch_tables(spark):
            docs = durable(stage(spark, docs, sf_dir), outer=True)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": run}
SQL: dict[str, str | None] = {"pipeline": ORACLE_SQL}
