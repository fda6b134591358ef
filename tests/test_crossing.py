import pytest
from pyspark.sql import functions as F

from trialkit.operators.crossing import first_crossing, race


def steps(spark, series):
    data = [(s, float(t), float(x)) for s, xs in series.items() for t, x in enumerate(xs, 1)]
    return spark.createDataFrame(data, "series string, t double, step double")


@pytest.mark.parametrize("block_rows", [None, 2])
def test_bounds_and_choice(spark, block_rows):
    df = steps(
        spark,
        {"never": [1, -1, 1], "hit": [1, 2, 5], "down": [-1, -2, 9], "later": [1, 1, 1, 1, 1, 1, 1, 1, 1, 1], "back": [3, -9]},
    )
    got = first_crossing(df, series=["series"], time="t", step="step", upper=3.0, lower=-3.0, block_rows=block_rows)
    assert {r.series: (r.t, r.choice) for r in got.collect()} == {
        "hit": (2.0, 1), "down": (2.0, -1), "later": (3.0, 1), "back": (1.0, 1),
    }


@pytest.mark.parametrize("block_rows", [None, 10])
def test_constant_drift_crosses_at_its_closed_form(spark, block_rows):
    # ndt + A / V with dt = 0.01
    rates = {1: 1.0, 2: 0.5, 3: 0.25}
    df = spark.range(1, 1001).select((F.col("id") * 0.01).alias("t"), F.explode(F.array(*map(F.lit, rates))).alias("item"))
    rate = F.element_at(F.create_map(*[F.lit(x) for kv in rates.items() for x in kv]), F.col("item"))
    hits = first_crossing(df.withColumn("trial", F.lit(1)), series=["trial", "item"], time="t", step=rate * 0.01, upper=0.995, block_rows=block_rows)
    for r in hits.withColumn("t", F.col("t") + 0.3).collect():
        assert r.t == pytest.approx(0.3 + 1.0 / rates[r["item"]], abs=0.011)


def test_upper_bound_wins(spark):
    got = first_crossing(steps(spark, {"a": [0.0]}), series=["series"], time="t", step="step", upper=0.0, lower=0.0).collect()
    assert [(r.t, r.choice) for r in got] == [(1.0, 1)]


def test_bounds_from_columns(spark):
    df = steps(spark, {"a": [1, 1, 1], "b": [1, 1, 1]}).withColumn("bound", F.when(F.col("series") == "a", 2.0).otherwise(3.0))
    got = first_crossing(df, series=["series"], time="t", step="step", upper=F.col("bound")).collect()
    assert {r.series: r.t for r in got} == {"a": 2.0, "b": 3.0}


def test_race(spark):
    hits = spark.createDataFrame(
        [(1, 3, 0.4), (1, 1, 0.4), (1, 2, 0.1), (1, 4, 1.0), (2, 1, 2.0)], "trial long, item int, t double"
    )
    got = race(hits, trial=["trial"], item="item", max_time=1.0).collect()
    assert sorted((r.trial, r.rank_idx, r["item"]) for r in got) == [(1, 1, 2), (1, 2, 1), (1, 3, 3)]
    got = race(hits, trial=["trial"], item="item", max_reached=2).collect()
    assert sorted((r.trial, r.rank_idx, r["item"]) for r in got) == [(1, 1, 2), (1, 2, 1), (2, 1, 1)]
