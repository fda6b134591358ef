import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from trialkit.operators.trim import apply_trim, trim_cells, trim_thresholds

SCHEMA = "condition_idx long, rank_idx int, rt double"


def brute(values, trims=tuple(i / 100 for i in range(21)), penalty=0.02):
    """All cells of one group, by the definition."""
    x = np.sort(np.array(values))
    cells = {}
    for t in trims:
        cut = np.quantile(x, round(100 - 100 * t, 9) / 100)
        kept = x[x < cut]
        if len(kept) < 2:
            continue
        logs = np.log(kept)
        mu, sd, n = logs.mean(), logs.std(ddof=1), len(kept)
        if sd > 0:
            cdf = np.array([0.5 * math.erfc(-(v - mu) / sd / math.sqrt(2)) for v in logs])
            ks = max((cdf - np.arange(n) / n).max(), (np.arange(1, n + 1) / n - cdf).max())
        else:
            ks = None
        cells[t] = (mu, sd, ks, n, cut, None if ks is None else ks + penalty * t)
    return cells


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(1, 1, rng.lognormvariate(0, 0.4)) for _ in range(120)] + [(1, 1, 9.0)] * 4
    data += [(1, 2, round(rng.lognormvariate(0, 1), 1) + 0.1) for _ in range(300)]  # many ties
    data += [(2, 1, 0.7)]  # one row: no trim keeps two
    data += [(3, 1, 2.0)] * 30  # all equal: nothing lies below the cut
    data += [(4, 1, 1.0)] * 10 + [(4, 1, 5.0)]  # one repeated time left below the cut: no spread
    data += [(5, 1, x) for x in (None, float("nan"), 0.0, -1.0, math.inf, 0.5, 0.6, 0.8)]
    data += [(None, 1, rng.random() + 0.1) for _ in range(40)]
    return spark.createDataFrame(data, SCHEMA)


def groups_of(rows):
    out = {}
    for r in rows.collect():
        if r.rt is not None and 0 < r.rt < math.inf:
            out.setdefault((r.condition_idx, r.rank_idx), []).append(r.rt)
    return out


@pytest.mark.parametrize("block_rows", [None, 5])
def test_cells(rows, block_rows):
    got = {((r.condition_idx, r.rank_idx), r.trim): r for r in trim_cells(rows, block_rows=block_rows).collect()}
    want = {(g, t): c for g, v in groups_of(rows).items() for t, c in brute(v).items()}
    assert set(got) == set(want)
    assert (2, 1) not in {g for g, _ in got} and (3, 1) not in {g for g, _ in got}
    for key, (mu, sd, ks, n, cut, score) in want.items():
        r = got[key]
        assert r.n_used == n and r.q_lower == 0.0
        assert (r.mu_hat, r.sigma_hat, r.q_upper) == pytest.approx((mu, sd, cut), abs=1e-12)
        if ks is None:
            assert r.ks_statistic is None and r.score is None
        else:
            assert (r.ks_statistic, r.score) == pytest.approx((ks, score), abs=1e-12)


@pytest.mark.parametrize("block_rows", [None, 5])
def test_best(rows, block_rows):
    got = {(r.condition_idx, r.rank_idx): r for r in trim_thresholds(rows, block_rows=block_rows).collect()}
    for g, values in groups_of(rows).items():
        cells = brute(values)
        if not cells:
            assert g not in got
            continue
        # without a score the lowest trim stands
        best = min(cells, key=lambda t: (cells[t][5] is None, cells[t][5] or 0.0, t))
        assert got[g].trim == best and got[g].n_used == cells[best][3]


def test_grid_and_penalty(rows):
    got = trim_thresholds(rows.where("condition_idx = 1 and rank_idx = 1"), trims=[0.0, 0.1, 0.15], penalty=0.5).collect()
    cells = brute(groups_of(rows)[(1, 1)], (0.0, 0.1, 0.15), 0.5)
    best = min(cells, key=lambda t: (cells[t][5], t))
    assert [r.trim for r in got] == [best] and got[0].score == pytest.approx(cells[best][5])


def test_small_groups_take_one_shuffle(rows):
    plan = plan_of(trim_thresholds(rows))
    assert plan.count("Exchange") == 1 and "Python" not in plan


def test_apply(spark):
    rows = spark.createDataFrame([(1, 1, x) for x in (0.0, 1.0, 2.0, 3.0)] + [(2, 1, 1.0), (3, 1, 1.0), (None, 1, 1.5)], SCHEMA)
    bounds = spark.createDataFrame(
        [(1, 1, 0.1, 0.0, 2.0, 50, 9.9), (2, 1, 0.0, 0.0, 5.0, 3, 9.9), (None, 1, 0.2, 0.0, 2.0, 50, 9.9)],
        "condition_idx long, rank_idx int, trim double, q_lower double, q_upper double, n_used long, mu_hat double",
    )
    out = apply_trim(rows, bounds)
    assert out.columns == ["condition_idx", "rank_idx", "trim", "q_lower", "q_upper", "rt"]
    got = sorted(((r.condition_idx or 0, r.rt) for r in out.collect()))
    # both ends belong; a group without bounds vanishes; NULL conditions match each other
    assert got == [(0, 1.5), (1, 0.0), (1, 1.0), (1, 2.0), (2, 1.0)]
    assert {r.condition_idx for r in apply_trim(rows, bounds, min_n_used=10).collect()} == {1, None}


def test_bounds_take_few_rounds_and_ends_settle_small_cells(spark, monkeypatch):
    from trialkit.operators import selection, trim

    draws = spark.range(3000).select(
        (F.col("id") % 30).alias("condition_idx"), F.lit(1).alias("rank_idx"), F.exp(F.randn(5)).alias("rt")
    )
    rows = spark.createDataFrame(draws.collect(), draws.schema)
    plain = sorted(trim.trim_cells(rows).collect())
    written = []
    materialise = trim.materialise
    for module in (trim, selection):
        monkeypatch.setattr(module, "materialise", lambda df: written.append(df.columns) or materialise(df))
    by_bounds = sorted(trim.trim_cells(rows, block_rows=50).collect())
    # two rounds of selection, and one of the bounds after the first
    assert sum("__spot" in c or "__count" in c for c in written) == 2
    assert sum(c[-1] == "open" for c in written) == 1
    assert len(plain) == len(by_bounds) == 30 * 21
    for a, b in zip(plain, by_bounds):
        assert a[:3] == b[:3] and a["n_used"] == b["n_used"] and a["q_upper"] == b["q_upper"]
        assert a["ks_statistic"] == pytest.approx(b["ks_statistic"], rel=1e-9)
    # wide cells are cut step by step
    monkeypatch.setattr(trim, "CELL_ROWS", 1)
    monkeypatch.setattr(selection, "CELL_ROWS", 1)
    stepped = sorted(trim.trim_cells(rows, block_rows=50).collect())
    assert [r[:-1] for r in stepped] == [r[:-1] for r in by_bounds] and sum(c[-1] == "open" for c in written) > 2
