"""A text corpus from raw documents to packed training sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialkit.llm.common import read_table, stored
from trialkit.llm.decontaminate import decontaminate
from trialkit.llm.line_dedup import dedup_lines
from trialkit.llm.ngram_jaccard import first_of_groups
from trialkit.llm.packing import pack
from trialkit.llm.quality_rules import quality_filter


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules judge good.

    NULL and empty texts have no words and go. Repeated rows are judged alike, each for itself; other columns stay.
    """
    return quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines that came before; those of which nothing is left go.

    A NULL text stays, an empty one goes. Of repeated rows the first keeps its lines.
    """
    return dedup_lines(docs).where(F.col("text").isNull() | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest ``doc_id``.

    NULL and empty texts are like no other and stay. Of repeated rows one stays.
    """
    return first_of_groups(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark.

    NULL and empty texts have no windows and stay. Repeated rows are treated alike.
    """
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece.

    NULL and empty texts are the end id alone. Repeated rows are packed each for itself; an empty table gives no rows.
    """
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Estimated accuracies and packed token ids are beyond SQL; the tests hold every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
