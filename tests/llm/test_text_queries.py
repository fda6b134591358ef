"""The registered text queries: SQL counterparts on the smallest tables, and the edge cases all must bear."""

import os

import duckdb
import public_tokenizers
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from trialkit.llm.decontaminate import contamination_report, decontaminate
from trialkit.llm.id_files import read_ids, write_ids
from trialkit.llm.language_id import language_report
from trialkit.llm.lexical_search import search
from trialkit.llm.licenses import license_report
from trialkit.llm.line_dedup import dedup_lines
from trialkit.llm.ngram_jaccard import first_of_groups, jaccard_report
from trialkit.llm.packing import pack
from trialkit.llm.quality_classifier import quality_scores
from trialkit.llm.quality_rules import quality_filter, quality_report
from trialkit.llm.queries import ORACLES, QUERIES
from trialkit.llm.resampling import resample
from trialkit.llm.sharding import shard_documents
from trialkit.llm.token_counts import count_tokens

SF_DIR = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14))
    assert set(ORACLES) <= set(contract.oracle_sql())


@tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    found = con.sql(ORACLES[name])
    df = QUERIES[name](spark, SF_DIR)
    assert sorted(df.columns) == sorted(found.columns)
    keys = [df.columns.index(c) for c in ("doc_id", "item_id") if c in df.columns]

    def by_key(row):
        return [row[k] for k in keys]

    want = sorted(found.select(", ".join(df.columns)).fetchall(), key=by_key)
    assert sorted((tuple(r) for r in df.collect()), key=by_key) == want


@tables
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_a_row_for_every_document(spark, name):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = QUERIES[name](spark, SF_DIR)
    assert out.select("doc_id").distinct().count() == docs.count()


ODD = [
    (1, None),
    (2, ""),
    (3, "one"),
    (4, "a b c d e f g h i j k l\nm n o p q r s t u v w x y z a b c d e f g h"),
    (4, "a b c d e f g h i j k l\nm n o p q r s t u v w x y z a b c d e f g h"),
    (None, "text of no document \x00 with odd   characters \U0001f600"),
    (None, None),
    (5, "long " * 300_000),
    (6, "\n\n \t\n"),
]


def odd(spark, rows=ODD, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if not extra:
        return df
    names = ["row", "windows", "n", "id", "comp", "key", "judged", "found", "rank", "shard", "lang", "quality", "of", "size"]
    return df.selectExpr("*", *[f"'x' AS {c}" for c in names])


def operators(spark, docs):
    bench = spark.createDataFrame([(7, "m n o p q r s t u v w"), (None, None), (8, "")], "item_id long, text string")
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (6, None)], "doc_id long, quality int")
    yield "op1", pack(docs, WORDS)
    yield "op2", jaccard_report(docs)
    yield "op2-first", first_of_groups(docs)
    yield "op4", language_report(docs)
    yield "op5", contamination_report(docs, bench)
    yield "op5-spans", decontaminate(docs, bench, remove="spans")
    yield "op6", quality_report(docs)
    yield "op6-filter", quality_filter(docs)
    yield "op7", dedup_lines(docs, counts=True)
    yield "op8", count_tokens(docs, WORDS)
    yield "op9", quality_scores(docs, labels)
    yield "op10", shard_documents(docs)
    yield "op11", search(docs, bench)
    yield "op12", license_report(docs)
    yield "op13", resample(docs, bench)


def test_odd_rows(spark):
    """NULLs, empty and very long texts, repeated rows and clashing names crash nothing and lose no row."""
    docs = odd(spark)
    for name, out in operators(spark, docs):
        rows = out.collect()
        if name == "op11":
            assert sorted((r["item_id"], r["rank"], r["doc_id"]) for r in rows) == [(7, 1, 4), (7, 2, 4)]
            continue
        if name in ("op2-first", "op6-filter"):
            assert out.columns == docs.columns, name
            continue
        assert {r["doc_id"] for r in rows} == {1, 2, 3, 4, 5, 6, None}, name
        if name != "op1":
            assert len(rows) == len(ODD), name


def test_first_of_groups_keeps_one_of_repeated_rows(spark):
    kept = [r["doc_id"] for r in first_of_groups(odd(spark)).collect()]
    assert sorted(kept, key=str) == [1, 2, 3, 4, 5, 6, None, None]


def test_empty_tables(spark):
    docs = odd(spark, []).withColumn("lang", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("en"))
    for name, out in operators(spark, docs):
        assert out.collect() == [], name


def test_id_files_of_odd_rows(spark, tmp_path):
    for k, rows in enumerate((ODD, [])):
        path = str(tmp_path / f"files{k}")
        write_ids(odd(spark, rows), path, BYTES, 50_257)
        got = read_ids(spark, path).collect()
        assert len(got) == len(rows)
        at = 0
        for r in sorted(got, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["n_tokens"]
        names = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
        assert names == sorted(names, key=lambda x: (x is not None, x))


@tables
def test_pipeline_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.schema == docs.schema
        assert 0 < out.count() <= docs.count()
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0
