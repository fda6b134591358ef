import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialkit.functions import stats as S
from trialkit.operators.blocks import GroupSizes
from trialkit.operators.inference import AbcInput, Posterior
from trialkit.operators.report import (
    density_curves,
    pair_correlation,
    prior_and_posterior,
    recovery_table,
    residuals,
    scaled_histogram,
    summarise_posterior,
    within_residual_quantile,
)


@pytest.fixture(scope="module")
def cv(spark):
    rng = random.Random(5)
    rows = []
    for tol in (0.05, 0.1):
        for h in range(1, 31):
            a = rng.uniform(0, 1)
            rows.append((tol, h, "a", a, round(a + rng.gauss(0, 0.2), 1)))
            rows.append((tol, h, "b", 2 * a, round(a * a + rng.gauss(0, 0.2), 1)))
            rows.append((tol, h, "fixed", 1.0, 1.0))
    rows += [(0.05, 31, "a", 0.5, None), (0.05, 31, "b", 0.5, 3.0), (0.05, 31, "fixed", 1.0, 1.0)]
    rows += [(0.1, 31, "a", 0.5, math.inf), (0.1, 31, "b", 0.5, 3.0), (0.1, 31, "fixed", 1.0, 1.0)]
    return spark.createDataFrame(rows, "tol double, holdout long, parameter string, true double, estimate double")


def test_posterior_summary(spark):
    rows = [(float(i), float(-i) if i % 2 else math.inf, math.nan) for i in range(1, 12)] + [(None, None, None)]
    post = Posterior(spark.createDataFrame(rows, "z double, a double, m double"), ("z", "a", "m"))
    for block_rows in (None, 3):
        summary = summarise_posterior(post, 0.9, block_rows, p10=S.quantiles("value", [0.1]), n=F.count("value"))
        got = summary.df.collect()
        assert summary.df.columns == ["parameter", "mean", "median", "ci_lower_0.050", "ci_upper_0.950", "p10", "n"]
        assert [r.parameter for r in got] == ["z", "a", "m"]
        assert (got[0]["mean"], got[0]["median"], got[0]["p10"], got[0]["n"]) == (6.0, 6.0, 2.0, 11)
        assert got[0]["ci_lower_0.050"] == pytest.approx(1.5) and got[1]["median"] == -6.0
        # nothing finite: the row stays
        assert got[2]["mean"] is None and got[2]["ci_upper_0.950"] is None and got[2]["n"] == 0
        assert summary.n_samples == 12 and summary.ci_level == 0.9


def test_recovery(cv):
    got = {(r.tol, r.parameter): r for r in recovery_table(cv).collect()}
    for tol in (0.05, 0.1):
        rows = [r for r in cv.collect() if r.tol == tol and r.parameter == "b"]
        x, y = [r.true for r in rows], [r.estimate for r in rows]
        assert got[(tol, "b")].r == pytest.approx(np.corrcoef(x, y)[0, 1])
        assert (got[(tol, "b")].slope, got[(tol, "b")].intercept) == pytest.approx(tuple(np.polyfit(x, y, 1)))
        assert got[(tol, "fixed")].r is None and got[(tol, "fixed")].slope is None
        assert got[(tol, "fixed")].intercept == 1.0


@pytest.mark.parametrize("block_rows", [None, 5])
def test_residual_quantile(cv, block_rows):
    rows = residuals(cv.where("parameter = 'b'"))
    got = within_residual_quantile(rows, 0.9, block_rows=block_rows).collect()
    for tol in (0.05, 0.1):
        away = [abs(r.residual) for r in rows.collect() if r.tol == tol]
        cut = np.quantile(away, 0.9)
        assert sum(r.tol == tol for r in got) == sum(a <= cut + 1e-12 for a in away)


@pytest.mark.parametrize("block_rows", [None, 5])
def test_pair_correlation(cv, block_rows):
    got = {(r.tol, r.p1, r.p2): r for r in pair_correlation(cv, ["a", "b", "fixed"], block_rows).collect()}
    assert len(got) == 6

    def ranks(v):
        return [sum(x < y for x in v) + (sum(x == y for x in v) + 1) / 2 for y in v]

    for tol in (0.05, 0.1):
        est = {p: {r.holdout: r.estimate for r in cv.collect() if r.tol == tol and r.parameter == p} for p in "ab"}
        keep = [h for h in est["a"] if est["a"][h] is not None and math.isfinite(est["a"][h])]
        a, b = [est["a"][h] for h in keep], [est["b"][h] for h in keep]
        row = got[(tol, "a", "b")]
        assert row.n == len(keep) == 30
        assert row.rho == pytest.approx(np.corrcoef(ranks(a), ranks(b))[0, 1])
        assert (row.slope, row.intercept) == pytest.approx(tuple(np.polyfit(a, b, 1)))
        assert got[(tol, "a", "fixed")].rho is None


def test_correlation_of_many_parameters_in_one_plan(spark):
    """Fifty parameters: the same plan as for three, and all 1,225 pairs."""
    rng = np.random.default_rng(5)
    params = [f"p {k}" for k in range(50)]
    values = rng.normal(size=(40, 50)) @ rng.normal(size=(50, 50)) + 1e4
    values[:, 7] = np.round(values[:, 7])  # ties
    values[:, 9] = 3.1  # constant
    rows = [(0.1, h, p, 0.0, float(values[h, k])) for h in range(40) for k, p in enumerate(params)]
    cv = spark.createDataFrame(rows, "tol double, holdout long, parameter string, true double, estimate double").cache()
    table = pair_correlation(cv, params)
    got = {(r.p1, r.p2): r for r in table.collect()}
    assert len(got) == 1225
    ranks = pd.DataFrame(values).rank().to_numpy()
    for a, b in ((0, 1), (7, 8), (3, 49), (20, 7)):
        row = got[(params[min(a, b)], params[max(a, b)])]
        x, y = values[:, min(a, b)], values[:, max(a, b)]
        assert row.rho == pytest.approx(np.corrcoef(ranks[:, min(a, b)], ranks[:, max(a, b)])[0, 1])
        assert (row.slope, row.intercept) == pytest.approx(tuple(np.polyfit(x, y, 1)), rel=1e-5)
        assert row.n == 40
    flat = got[("p 9", "p 10")]
    assert flat.rho is None and flat.slope is None and flat.intercept == pytest.approx(values[:, 10].mean())

    def size(df):
        return len(re.findall(r"^[\s:+-]*\w", df._jdf.queryExecution().optimizedPlan().toString(), re.M))

    assert size(table) == size(pair_correlation(cv, params[:3]))


def test_histogram(spark):
    data = [("ten", float(x)) for x in range(1, 101)] + [("zero", 0.0), ("zero", 0.0), ("one", 5.0), ("below", -3.0)]
    data += [("sevenths", x / 7) for x in range(20)] + [("ten", None), ("ten", math.inf), ("ten", math.nan)]
    data += [("edges", x) for x in (1.0, 2.0, 2.0, 3.0, 4.0)]
    got = scaled_histogram(spark.createDataFrame(data, "k string, v double"), ["k"], "v").collect()
    bins = {}
    for r in sorted(got, key=lambda r: (r.k, r.bin)):
        bins.setdefault(r.k, []).append((r.left, r.right, r["count"], r.scaled))
    assert bins["ten"] == [(10.0 * i, 10.0 * i + 10, 10, 1.0) for i in range(10)]
    assert [b[2] for b in bins["sevenths"]] == [4, 4, 3, 4, 3, 2]
    assert [b[:2] for b in bins["sevenths"]][:2] == [(0.0, 0.5), (0.5, 1.0)]
    # closed on the right, and the lowest value belongs to the first bin
    assert [b[2] for b in bins["edges"]] == [3, 1, 1]
    assert sum(b[2] for b in bins["zero"]) == 2 and sum(b[2] for b in bins["one"]) == 1
    assert max(b[3] for b in bins["below"]) == 1.0


def kde(values, grid):
    v = np.array(values)
    sd, iqr = v.std(ddof=1), np.subtract(*np.quantile(v, [0.75, 0.25]))
    spread = min(sd, iqr / 1.34) or sd or abs(v[0]) or 1.0
    bw = 0.9 * spread * len(v) ** -0.2
    return np.exp(-0.5 * ((grid[:, None] - v[None, :]) / bw) ** 2).sum(axis=1) / (len(v) * bw * math.sqrt(2 * math.pi))


@pytest.mark.parametrize("block_rows", [None, 10])
def test_density(spark, block_rows):
    rng = random.Random(2)
    wide = [rng.gauss(0, 1) for _ in range(200)] + [500.0]
    far = [round(rng.gauss(3, 2), 1) for _ in range(100)]
    same = [2.0] * 5
    data = [("wide", "x", v) for v in wide] + [("far", "x", v) for v in far] + [("same", "y", v) for v in same]
    data += [("lonely", "z", 1.0), ("wide", "x", None)]
    df = spark.createDataFrame(data, "type string, parameter string, value double")
    got = {}
    for r in density_curves(df, ["type", "parameter"], "value", ["parameter"], 64, block_rows).collect():
        got.setdefault(r.type, []).append((r.point, r.x, r.density))
    assert set(got) == {"wide", "far", "same"}
    for name, values in (("wide", wide), ("far", far), ("same", same)):
        rows = sorted(got[name])
        assert [p for p, _, _ in rows] == list(range(64))
        grid = np.linspace(min(wide + far), max(wide + far), 64) if name != "same" else np.full(64, 2.0)
        assert [x for _, x, _ in rows] == pytest.approx(list(grid))
        assert [d for _, _, d in rows] == pytest.approx(list(binned_kde(values, grid)), rel=1e-9, abs=1e-300)


def binned_kde(values, grid):
    """Mass split linearly between the nearest of as many cells as grid points, four bandwidths beyond the grid."""
    v = np.array(values)
    q = np.subtract(*np.quantile(v, [0.75, 0.25])) / 1.34
    sd = v.std(ddof=1)
    spread = min(sd, q) or sd or abs(v[0]) or 1.0
    bw = 0.9 * spread * len(v) ** -0.2
    cells = np.linspace(min(grid) - 4 * bw, max(grid) + 4 * bw, len(grid))
    mass = np.zeros(len(grid))
    for x in v:
        at = (x - cells[0]) / (cells[1] - cells[0])
        i = min(int(at), len(grid) - 2)
        mass[i] += 1 - (at - i)
        mass[i + 1] += at - i
    heights = np.array([(mass * np.exp(-0.5 * ((c - cells) / bw) ** 2)).sum() for c in cells])
    return np.interp(grid, cells, heights) / (len(v) * bw * math.sqrt(2 * math.pi))


@pytest.mark.parametrize("block_rows", [None, 50])
def test_density_is_near_the_exact_curve(spark, block_rows):
    rng = random.Random(4)
    values = [rng.gauss(0, 1) for _ in range(300)] + [rng.gauss(4, 0.5) for _ in range(200)]
    df = spark.createDataFrame([("a", v) for v in values], "k string, v double")
    rows = sorted(density_curves(df, ["k"], "v", block_rows=block_rows).collect(), key=lambda r: r.point)
    exact = kde(values, np.array([r.x for r in rows]))
    assert max(abs(r.density - e) for r, e in zip(rows, exact, strict=True)) < 1e-3


def test_density_rows_do_not_follow_the_input(spark):
    """Bandwidths are settled by one scan; the other splits each value in two, whatever the grid."""
    df = spark.range(2000).select(F.lit("a").alias("k"), F.randn(1).alias("v"))
    plan = density_curves(df, ["k"], "v", sizes=GroupSizes(2000, 2000))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 2000") == 1


def test_prior_and_posterior(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 4.0)], "condition_idx long, a double, b double")
    prior = AbcInput(df, {}, ("a", "b"), ())
    post = Posterior(df.where("condition_idx = 1"), ("a", "b"))
    got = sorted((r.type, r.parameter, r.value) for r in prior_and_posterior(post, prior).collect())
    assert got == [
        ("Posterior", "a", 1.0), ("Posterior", "b", 2.0),
        ("Prior", "a", 1.0), ("Prior", "a", 3.0), ("Prior", "b", 2.0), ("Prior", "b", 4.0),
    ]
    with pytest.warns(UserWarning, match="left out"):
        assert prior_and_posterior(post, AbcInput(df, {}, ("a",), ())).count() == 2
