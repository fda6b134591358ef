import random
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialkit.functions import stats as S
from trialkit.operators import inference
from trialkit.operators.inference import (
    AbcInput,
    Posterior,
    abc_cross_validate,
    abc_local_linear,
    abc_rejection,
    build_abc_input,
    condition_params,
    scales,
)
from trialkit.operators.summarise import SummaryTable, summarise

N = 151


def table():
    rng = random.Random(11)
    rows = []
    for i in range(1, N + 1):
        a, b = rng.uniform(1, 5), rng.uniform(0.1, 2)
        rows.append((i, a, b, a + rng.gauss(0, 0.3), b * a + rng.gauss(0, 0.2), 3.0))
    return rows


@pytest.fixture(scope="module")
def data(spark):
    df = spark.createDataFrame(table(), "condition_idx long, a double, b double, s1 double, s2 double, flat double")
    return AbcInput(df, {"s1": 3.0, "s2": 2.5, "flat": 3.0}, ("a", "b"), ("s1", "s2", "flat"))


def numpy_distance(rows, target):
    stats = np.array([r[3:6] for r in rows], dtype=float)
    mad = 1.4826 * np.median(np.abs(stats - np.median(stats, axis=0)), axis=0)
    mad[mad == 0] = 1.0
    return np.sqrt((((stats - np.array(target)) / mad) ** 2).sum(axis=1)), stats, mad


@pytest.mark.parametrize("block_rows", [None, 20])
def test_rejection(data, block_rows):
    d, _, mad = numpy_distance(table(), (3.0, 2.5, 3.0))
    got = abc_rejection(data, 0.2, block_rows).df.collect()
    k = int(np.ceil(N * 0.2))
    order = np.argsort(d, kind="stable")[:k]
    assert {r.condition_idx for r in got} == {int(i) + 1 for i in order}
    assert sorted(r.distance for r in got) == pytest.approx(sorted(d[order]))
    found = scales(data.df, data.stats, N, block_rows)
    assert [found[s] for s in data.stats] == pytest.approx(list(mad))
    assert abc_rejection(data, 1.0, block_rows).df.count() == N


@pytest.mark.parametrize("block_rows", [None, 2])
def test_ties_and_missing(spark, block_rows):
    rows = [(1, 1.0, 2.0), (2, 2.0, 4.0), (3, 3.0, 2.0), (4, 4.0, None), (5, 5.0, float("nan")), (6, 6.0, 9.0)]
    data = AbcInput(spark.createDataFrame(rows, "condition_idx long, p double, s double"), {"s": 3.0}, ("p",), ("s",))
    # three of six: 1, 2 and 3 are equally near, incomplete rows count but never enter
    assert {r.condition_idx for r in abc_rejection(data, 0.5, block_rows).df.collect()} == {1, 2, 3}
    assert {r.condition_idx for r in abc_rejection(data, 0.3, block_rows).df.collect()} == {1, 2}
    assert {r.condition_idx for r in abc_rejection(data, 1.0, block_rows).df.collect()} == {1, 2, 3, 6}
    with pytest.raises(ValueError, match="lacks values"):
        abc_rejection(AbcInput(data.df, {"s": None}, ("p",), ("s",)), 0.5)


@pytest.mark.parametrize("heteroscedastic", [False, True])
@pytest.mark.parametrize("expressions", [12, 1])
def test_local_linear(data, heteroscedastic, expressions, monkeypatch):
    monkeypatch.setattr(inference, "PRODUCT_COLUMNS", expressions)
    rows, target = table(), np.array((3.0, 2.5, 3.0))
    d, stats, mad = numpy_distance(rows, target)
    k = int(np.ceil(N * 0.4))
    near = np.sort(np.argsort(d, kind="stable")[:k])
    w = np.sqrt(1 - (d[near] / d[near].max()) ** 2)[:, None]
    x = np.c_[np.ones(k), ((stats - target) / mad)[near]]
    y = np.c_[[np.log(rows[i][1]) for i in near], [rows[i][2] for i in near]]
    beta = np.linalg.lstsq(x * w, y * w, rcond=None)[0]
    res = y - x @ beta
    shift = res.mean(axis=0)
    res = res - shift
    if heteroscedastic:
        gamma = np.linalg.lstsq(x * w, np.log(res**2) * w, rcond=None)[0]
        res = res * np.sqrt(np.exp(gamma[0] - x @ gamma))
    want = beta[0] + shift + res
    want[:, 0] = np.exp(want[:, 0])
    post = abc_local_linear(data, 0.4, ["log", "none"], heteroscedastic)
    got = {r.condition_idx: (r.adjusted_a, r.adjusted_b) for r in post.df.collect()}
    assert set(got) == {int(i) + 1 for i in near}
    for i, row in zip(near, want):
        assert got[int(i) + 1] == pytest.approx(tuple(row), rel=1e-8)
    assert post.values().columns == ["a", "b"]


def test_log_of_values_at_or_below_zero(spark):
    rows = [(i, float(i - 3), float(i)) for i in range(1, 21)]
    data = AbcInput(spark.createDataFrame(rows, "condition_idx long, p double, s double"), {"s": 9.5}, ("p",), ("s",))
    got = abc_local_linear(data, 1.0, {"p": "log"}, heteroscedastic=False).df.collect()
    assert len(got) == 20 and all(r.adjusted_p > 0 for r in got)
    with pytest.raises(ValueError, match="unknown transforms"):
        abc_local_linear(data, 1.0, {"p": "cube"})


@pytest.mark.parametrize("block_rows", [None, 15])
@pytest.mark.parametrize("n", [N, N - 1])
def test_cross_validation(data, block_rows, n):
    part = AbcInput(data.df.where(f"condition_idx <= {n}"), data.target, data.params, data.stats)
    cv = abc_cross_validate(part, 6, [0.1, 0.3], "seed", block_rows).collect()
    rows = table()[:n]
    assert len(cv) == 6 * 2 * 2 and len({r.holdout for r in cv}) == 6
    for r in cv:
        held = rows[r.holdout - 1]
        rest = [x for x in rows if x[0] != r.holdout]
        d, _, _ = numpy_distance(rest, held[3:6])
        near = np.argsort(d, kind="stable")[: int(np.ceil((n - 1) * r.tol))]
        j = {"a": 1, "b": 2}[r.parameter]
        assert r.true == held[j]
        assert r.estimate == pytest.approx(float(np.median([rest[i][j] for i in near])))


def test_condition_params(spark):
    rows = [(1, 2, 1, 5.0), (1, 1, 2, 6.0), (1, 1, 1, 7.0), (2, 1, 1, None)]
    df = spark.createDataFrame(rows, "condition_idx long, trial_idx int, rank_idx int, p double")
    assert {r.condition_idx: r.p for r in condition_params(df, ["p"]).collect()} == {1: 7.0, 2: None}


@pytest.fixture(scope="module")
def rows(spark):
    data = [(c, t, c * 10.0, c + t / 10) for c in (1, 2, 3) for t in (1, 2, 3)]
    return spark.createDataFrame(data, "condition_idx long, trial_idx int, p double, rt double")


def test_build_input(spark, rows):
    summary = summarise(m=S.mean("rt"), sd=S.sd("rt"))(rows.where("condition_idx <> 2"))
    target = summarise(by="who", wider_by="who", m=S.mean("rt"), sd=S.sd("rt"))(
        spark.createDataFrame([("b", 9.0), ("b", 7.0), ("a", 1.0), ("a", 3.0)], "who string, rt double")
    )
    data = build_abc_input(rows, summary, target, ["p"])
    assert data.target == {"m": 2.0, "sd": pytest.approx(2**0.5)}
    assert {r.condition_idx: (r.p, r.m) for r in data.df.collect()} == {
        1: (10.0, pytest.approx(1.2)), 3: (30.0, pytest.approx(3.2)),
    }


def test_build_input_refusals(spark, rows):
    summary = summarise(m=S.mean("rt"))(rows)
    with pytest.raises(ValueError, match="missing columns: q"):
        build_abc_input(rows, summary, summary, ["q"])
    with pytest.raises(ValueError, match="at least one"):
        build_abc_input(rows, summary, summary, [])
    with pytest.raises(ValueError, match="lacks statistics: m"):
        build_abc_input(rows, summary, SummaryTable(summary.df.withColumnRenamed("m", "x"), summary.key), ["p"])
    with pytest.raises(ValueError, match="no statistics"):
        build_abc_input(rows, SummaryTable(summary.df.select("condition_idx"), summary.key), summary, ["p"])
    with pytest.raises(TypeError):
        build_abc_input(rows, [1], summary, ["p"])
    with pytest.raises(ValueError, match="no row"):
        build_abc_input(rows, summary, SummaryTable(summary.df.limit(0), summary.key), ["p"])
    with pytest.warns(UserWarning, match="further columns"):
        wide = SummaryTable(summary.df.selectExpr("*", "1.0 as extra"), summary.key)
        build_abc_input(rows, summary, wide, ["p"])
    with pytest.warns(UserWarning, match="names no key"):
        build_abc_input(rows, summary.df, summary, ["p"])
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        with pytest.raises(ValueError, match="several rows"):
            build_abc_input(rows, summary.df.union(summary.df), summary, ["p"])


def test_posterior_values_prefer_adjusted(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "p double, adjusted_p double")
    assert Posterior(df, ("p",)).values().first().p == 1.0
    assert Posterior(df, ("p",), {"p": "adjusted_p"}).values().first().p == 2.0


def test_many_statistics_plan_quickly(spark):
    """Conditions and distances over dozens of columns must not multiply with later renames."""
    from time import perf_counter

    from pyspark.sql import functions as F

    stats = tuple(f"s {i}" for i in range(36))
    df = spark.range(1, 201).select(
        F.col("id").alias("condition_idx"), (F.col("id") * 0.5).alias("p"), *[F.sin(F.col("id") * (i + 1)).alias(s) for i, s in enumerate(stats)]
    )
    start = perf_counter()
    summary = SummaryTable(df.drop("p"), ("condition_idx",)).complete()
    data = build_abc_input(df, summary, SummaryTable(df.drop("p"), ("condition_idx",)), ["p"])
    post = abc_local_linear(data, 0.9)
    renamed = post.df.toDF(*[f"c{i}" for i in range(len(post.df.columns))])
    assert renamed.where("c0 > 0").count() == 180
    assert perf_counter() - start < 120


def test_local_linear_cross_validation(spark):
    """On an exact line the adjusted estimates are the true values, where rejection is off."""
    df = spark.range(1, 301).select(
        F.col("id").alias("condition_idx"),
        (F.col("id") * 2.0 + F.sin(F.col("id") * 1.0)).alias("a"),
        F.col("id").cast("double").alias("x"),
        F.sin(F.col("id") * 1.0).alias("y"),
    )
    data = AbcInput(df, {"x": 1.0, "y": 0.0}, ("a",), ("x", "y"))
    linear = abc_cross_validate(data, 5, [0.2], method="loclinear").collect()
    assert len(linear) == 5
    assert all(r["estimate"] == pytest.approx(r["true"], abs=1e-6) for r in linear)
    plain = abc_cross_validate(data, 5, [0.2]).collect()
    assert {(r["holdout"], r["true"]) for r in plain} == {(r["holdout"], r["true"]) for r in linear}
    with pytest.raises(ValueError, match="method"):
        abc_cross_validate(data, 5, [0.2], method="neural")


def test_the_cut_keeps_ties_and_the_nearest(spark):
    df = spark.createDataFrame([(i, float(abs(i - 50) // 3)) for i in range(100)], "condition_idx long, x double")
    from trialkit.operators.inference import _nearest

    for wanted in (1, 5, 37, 100):
        kept = {r["condition_idx"] for r in _nearest(df, [], "x", wanted).collect()}
        order = sorted(((abs(i - 50) // 3, i) for i in range(100)))[:wanted]
        assert {i for _, i in order} <= kept
