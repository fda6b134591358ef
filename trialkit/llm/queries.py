"""The text operators over the given tables, with their production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trialkit.llm.common import read_table
from trialkit.llm.decontaminate import CONTAMINATION_SQL, contamination_report
from trialkit.llm.id_files import read_ids, write_ids
from trialkit.llm.language_id import language_report
from trialkit.llm.lexical_search import SEARCH_SQL, search
from trialkit.llm.licenses import LICENSE_SQL, license_report
from trialkit.llm.line_dedup import LINE_DEDUP_SQL, dedup_lines
from trialkit.llm.ngram_jaccard import JACCARD_SQL, jaccard_report
from trialkit.llm.packing import pack
from trialkit.llm.quality_classifier import quality_scores
from trialkit.llm.quality_rules import quality_report
from trialkit.llm.resampling import RESAMPLING_SQL, resampling_report
from trialkit.llm.sharding import shard_documents
from trialkit.llm.token_counts import count_tokens
from trialkit.sources.checkpoints import scratch_folder

#: Ids of the byte-level tokenizer are below this.
BYTE_ALPHABET = 50_257


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_report(_documents(spark, sf_dir))


def op3_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_folder(spark, "id-files")
    write_ids(_documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"), BYTE_ALPHABET)
    return read_ids(spark, path)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(_documents(spark, sf_dir))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(_documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(_documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"), counts=True)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_documents(spark, sf_dir))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op12_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(_documents(spark, sf_dir))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling_report(_documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing,
        op2_ngram_jaccard,
        op3_id_files,
        op4_language_id,
        op5_decontamination,
        op6_quality_rules,
        op7_line_dedup,
        op8_token_counts,
        op9_quality_classifier,
        op10_sharding,
        op11_lexical_search,
        op12_license_scans,
        op13_resampling,
    )
}
ORACLES = {
    "op2_ngram_jaccard": JACCARD_SQL,
    "op5_decontamination": CONTAMINATION_SQL,
    "op7_line_dedup": LINE_DEDUP_SQL,
    "op11_lexical_search": SEARCH_SQL,
    "op12_license_scans": LICENSE_SQL,
    "op13_resampling": RESAMPLING_SQL,
}
