import math
import random

import pytest
from pyspark.sql import functions as F

from trialkit.operators import neighbours
from trialkit.operators.inference import AbcInput, abc_cross_validate
from trialkit.operators.neighbours import candidate_pairs

STATS = ("a", "b", "c")


def brute(rows, targets, wanted):
    out = {}
    for name, t, scale in targets:
        away = sorted(
            (math.sqrt(sum(((r[1 + i] - t[s]) / scale[s]) ** 2 for i, s in enumerate(STATS))), r[0]) for r in rows if r[0] != name
        )
        out[name] = away[:wanted]
    return out


@pytest.mark.parametrize("kind", ["clusters", "line", "equal"])
def test_no_neighbour_is_lost_and_few_are_compared(spark, kind):
    rng = random.Random(kind)
    spots = [[rng.uniform(-50, 50) for _ in STATS] for _ in range(30)]

    def row(k):
        if kind == "clusters":
            return [rng.gauss(x, 1) for x in spots[k % 30]]
        if kind == "line":
            return [k / 10, k / 5, rng.random()]
        return [float(k % 3), 0.0, 0.0]

    rows = [(k, *row(k)) for k in range(3000)]
    chosen = rng.sample(rows, 1000)
    scale = {"a": 1.5, "b": 0.7, "c": 2.0}
    targets = [(r[0], dict(zip(STATS, r[1:])), {s: c * rng.choice([1, 1.01]) for s, c in scale.items()}) for r in chosen]
    wanted = 15
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    goals = spark.createDataFrame(
        [(n, *[t[s] for s in STATS], *[c[s] for s in STATS]) for n, t, c in targets],
        "holdout long, t0 double, t1 double, t2 double, c0 double, c1 double, c2 double",
    )
    d = F.sqrt(sum((((F.col(s) - F.col(f"t{i}")) / F.col(f"c{i}")) ** 2 for i, s in enumerate(STATS)), F.lit(0.0)))
    pairs = candidate_pairs(df, "id", STATS, targets, goals, d, wanted).select("holdout", "id", d.alias("d")).collect()
    got = {}
    for r in pairs:
        got.setdefault(r.holdout, []).append((r.d, r.id))
    for name, near in brute(rows, targets[:200], wanted).items():
        mine = sorted(got[name])
        assert [i for _, i in mine[:wanted]] == [i for _, i in near] or kind == "equal"
        assert [x for x, _ in mine[:wanted]] == pytest.approx([x for x, _ in near])
    assert len({(r.holdout, r.id) for r in pairs}) == len(pairs)
    if kind != "equal":
        assert len(pairs) < 0.15 * len(rows) * len(targets)


@pytest.mark.parametrize("method", ["rejection", "loclinear"])
def test_cross_validation_is_the_same(spark, method):
    rng = random.Random(5)
    rows = [(k, rng.random(), rng.gauss(0, 1), rng.expovariate(1), rng.choice([1.0, 2.0])) for k in range(300)]
    rows += [(900, 0.5, None, 1.0, 1.0), (901, 0.5, 1.0, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "condition_idx long, p double, a double, b double, c double")
    data = AbcInput(df, {s: 0.0 for s in STATS}, ("p",), STATS)
    results = []
    for pruned in (True, False):
        out = abc_cross_validate(data, 60, [0.02, 0.1], method=method, pruned=pruned).collect()
        results.append(sorted((r.tol, r.holdout, round(r.true, 9), round(r.estimate, 9)) for r in out))
    assert results[0] == results[1] and len(results[0]) == 120


def test_infinite_statistics_lose_no_row(spark):
    rows = [(k, float(k), 0.0, 0.0) for k in range(20)] + [(50, math.inf, 0.0, 0.0), (51, -math.inf, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    one = {s: 1.0 for s in STATS}
    targets = [(3, {"a": 3.0, "b": 0.0, "c": 0.0}, one), (50, {"a": math.inf, "b": 0.0, "c": 0.0}, one)]
    goals = spark.createDataFrame([(3, 3.0), (50, math.inf)], "holdout long, t double")
    pairs = candidate_pairs(df, "id", STATS, targets, goals, F.abs(F.col("a") - F.col("t")), 30).collect()
    assert len(pairs) == 2 * 21


def test_pivots_are_far_apart():
    points = [[0.0], [1.0], [10.0], [4.0], [4.0]]
    assert neighbours._far_apart(points, 3) == [[0.0], [10.0], [4.0]]
    assert neighbours._far_apart([[2.0]] * 5, 3) == [[2.0]]
