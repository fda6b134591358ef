"""Every stage of the pipeline against plain Python, each on what the stage before it kept."""

import os
import re

import numpy as np
import pytest
from test_decontaminate import expected as contaminated
from test_duplicates import groups_of, lines_left
from test_packing_and_tokens import PLAIN, WORDS
from test_quality_and_language import base_counts, plain_estimate, posterior

import corpus_pipeline
from trialkit.llm import quality_rules as qr
from trialkit.llm.packing import pack

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


def texts(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_every_stage(spark):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "ngram_jaccard", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = texts(docs)

    kept = stages["quality_rules"](spark, docs, SF_DIR)
    judged, _ = qr.judged(docs.select("doc_id", "text"))
    votes = {r["doc_id"]: list(r["judged"]["votes"]) for r in judged.collect()}
    model = plain_estimate([votes[i] for i, _ in rows])
    good = []
    for i, text in rows:
        c = base_counts(text)
        failed = c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"]
        if not failed and posterior(votes[i], *model) >= 0.5:
            good.append((i, text))
    assert texts(kept) == good
    assert 0.7 * len(rows) < len(good) < len(rows)

    lined = stages["line_dedup"](spark, kept, SF_DIR)
    left = [(i, t) for i, t in sorted(lines_left(good, 25).items()) if t is None or re.search("[^\x20\x09-\x0d]", t)]
    assert texts(lined) == left

    single = stages["ngram_jaccard"](spark, lined, SF_DIR)
    first = {c for _, c in groups_of(left).values()}
    assert texts(single) == [(i, t) for i, t in left if i in first]

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    clean = stages["decontamination"](spark, single, SF_DIR)
    hit = contaminated(texts(single), items)
    assert texts(clean) == [(i, t) for i, t in texts(single) if not hit[i][4]]

    packed = stages["packing"](spark, clean, SF_DIR).collect()
    with_ids = pack(clean, WORDS, with_ids=True).collect()
    for i, t in texts(clean):
        pieces = sorted((r for r in with_ids if r["doc_id"] == i), key=lambda r: r["start"])
        assert list(np.frombuffer(b"".join(r["ids"] for r in pieces), "<u4")) == [*PLAIN[WORDS](t), 2]
        assert sum(r["length"] for r in packed if r["doc_id"] == i) == pieces[0]["doc_tokens"]
    assert {r["doc_id"] for r in packed} == {i for i, _ in texts(clean)}
