import math
import random

import pytest
from pyspark.sql import functions as F

from trialkit.functions import stats as S
from trialkit.operators.states import MOMENTS, VALUES, SummaryStates
from trialkit.operators.summarise import summarise
from trialkit.sources.checkpoints import scratch_folder
from trialkit.sources.results import DATASET, Folder, ResultSet

SCHEMA = "chunk_idx int, k string, x double, y double"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    data = []
    for chunk in range(1, 6):
        for _ in range(rng.randrange(1, 60)):
            x = rng.choice([None, math.nan, 1e6 + rng.random(), 1e6 + rng.randrange(5)])
            data.append((chunk, rng.choice(["a", "b", None]), x, rng.choice([rng.gauss(0, 1), None])))
    data += [(2, "once", 3.0, 1.0), (3, "flat", 2.0, 1.0), (4, "flat", 2.0, 5.0), (5, "none", None, math.nan)]
    return spark.createDataFrame(data, SCHEMA).cache()


def states(spark, by=("k",)):
    return SummaryStates(
        spark, scratch_folder(spark, "states"), by, ("x", "y"), {"lm": ("y", "x")}, {"x": [0.0, 0.25, 0.5], "y": [0.5]}
    )


def direct(rows, by=("k",)):
    spec = summarise(
        by=list(by),
        wider_by=list(by),
        n=S.count(),
        **{f"{c}_mean": S.mean(c) for c in "xy"},
        **{f"{c}_sd": S.sd(c) for c in "xy"},
        **{f"{c}_min": F.min(S.present(c)) for c in "xy"},
        **{f"{c}_max": F.max(S.present(c)) for c in "xy"},
        lm=S.lm("y", "x"),
        lm_aic=S.gaussian_aic("y", "x"),
        x_quantiles=S.quantiles("x", [0.0, 0.25, 0.5]),
        y_quantiles=S.quantiles("y", [0.5]),
    )
    return spec(rows).df


def check(got, want, by=("k",)):
    got = {tuple(r[k] for k in by): r.asDict() for r in got.collect()}
    want = {tuple(r[k] for k in by): r.asDict() for r in want.collect()}
    assert set(got) == set(want)
    for key, row in want.items():
        assert set(got[key]) == set(row)
        for name, value in row.items():
            assert got[key][name] == (value if isinstance(value, (str, type(None))) else pytest.approx(value, rel=1e-6, abs=1e-6)), (key, name)


def test_merged_states_equal_a_full_summary(spark, rows):
    kept = states(spark)
    for chunk in (3, 1):
        kept.add(rows.where(F.col("chunk_idx") == chunk))
    kept.add(rows.where("chunk_idx in (2, 4, 5)"))
    kept.add(rows.where("chunk_idx = 4"))  # once more: replaced, not doubled
    assert kept.chunks() == {1, 2, 3, 4, 5}
    check(kept.read().df, direct(rows))


def test_without_groups(spark, rows):
    kept = states(spark, ())
    kept.add(rows)
    check(kept.read().df, direct(rows, ()), ())


def test_only_new_chunks_are_read(spark, rows):
    store = ResultSet.create(spark, scratch_folder(spark, "rs"))
    kept = states(spark)
    store.commit(rows.where("chunk_idx <= 3"))
    assert kept.update(store) == [1, 2, 3]
    folder = Folder(spark, store.path)
    for chunk in (1, 2, 3):
        for name in folder.names(f"{DATASET}/chunk_idx={chunk}"):
            folder.write_text(f"{DATASET}/chunk_idx={chunk}/{name}", "no parquet")
    store.commit(rows)
    with pytest.MonkeyPatch.context() as patch:
        reader = spark.read.schema(SCHEMA).parquet(folder.child(DATASET))
        patch.setattr(ResultSet, "dataset", lambda self: reader)
        assert kept.update(store) == [4, 5]
        assert kept.update(store) == []
    check(kept.read().df, direct(rows))


def test_an_unfinished_chunk_does_not_count(spark, rows):
    kept = states(spark)
    kept.add(rows.where("chunk_idx <= 2"))
    with pytest.MonkeyPatch.context() as patch:
        plain = SummaryStates._write
        patch.setattr(SummaryStates, "_write", lambda self, df, name: plain(self, df, name) if name == VALUES else None)
        kept.add(rows.where("chunk_idx = 3"))
    assert Folder(spark, kept.path).names(VALUES) != Folder(spark, kept.path).names(MOMENTS)
    check(kept.read().df, direct(rows.where("chunk_idx <= 2")))


def test_values_of_all_chunks_are_read_once(spark, rows, monkeypatch):
    from trialkit.operators import states as module

    stored = states(spark)
    stored.add(rows)
    written = []
    plain = module.materialise
    monkeypatch.setattr(module, "materialise", lambda df: written.append(df.columns) or plain(df))
    check(stored.read().df, direct(rows))
    assert written == [["k", "value", "__w"]] * 2
