import numpy as np

from trialkit.llm import quality_classifier as qc
from trialkit.llm.quality_classifier import AttentionModel, learn_quality, score_quality


def test_labels_without_documents_take_no_place_in_the_sample(spark):
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "!!! ### $$$") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20_000)], "doc_id long, quality int")
    assert learn_quality(docs, labels, most=20).constant is None


def test_documents_are_used_whole_or_not_at_all(spark, monkeypatch):
    """All passages of a long text are fitted on; a text beyond the bound is left out, those after it are not."""
    seen = []

    def fit(bags, labels):
        seen.append([len(b) for b in bags])
        return AttentionModel(constant=0.5)

    monkeypatch.setattr(qc, "fit_attention", fit)
    rows = [(i, "word " * (30 if i != 3 else 100_000)) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int")
    learn_quality(docs, labels)
    whole = seen.pop()
    assert len(whole) == 10 and whole[3] >= 500_000 // 512 and sorted(whole)[-2] == 1
    learn_quality(docs, labels, most_passages=20)
    assert seen.pop() == [1] * 9


def test_a_score_column_stays(spark):
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "!!! ### $$$", 7) for i in range(20)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    out = score_quality(docs, learn_quality(docs, labels))
    assert out.columns == ["doc_id", "score", "score_"]
    assert {r["score"] for r in out.collect()} == {7}
    assert np.isfinite([r["score_"] for r in out.collect()]).all()
