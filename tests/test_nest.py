import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from trialkit.functions.columns import uniform
from trialkit.operators.nest import condition_range, count_responses, design_table, flatten_results, to_long

SCHEMA = """condition_idx long, model string,
  cond_params struct<condition_idx: array<long>, drift: array<double>>,
  result array<struct<item_idx: array<int>, rt: array<double>, `.item_params`: array<double>>>"""


def trial(items, times):
    return (items, times, [0.0])


@pytest.fixture(scope="module")
def nested(spark):
    rows = [
        (1, "m", ([101, 101], [0.5, 0.7]), [trial([2, 1], [0.3, 0.4]), trial([], [])]),
        (2, "m", ([102], [0.9]), [trial([], [])]),
        (3, "m", ([103, 103], [1.1, 1.3]), [trial([1], [0.2]), trial([3, 2, 1], [0.1, 0.2, 0.3])]),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_flatten(nested):
    flat = flatten_results(nested)
    assert flat.columns == ["model", "condition_idx", "trial_idx", "rank_idx", "item_idx", "rt", "drift"]
    got = sorted((r.condition_idx, r.trial_idx, r.rank_idx, r.item_idx, r.rt, r.drift) for r in flat.collect())
    assert got == [
        (101, 1, 1, 2, 0.3, 0.5), (101, 1, 2, 1, 0.4, 0.5),
        (103, 1, 1, 1, 0.2, 1.1),
        (103, 2, 1, 3, 0.1, 1.3), (103, 2, 2, 2, 0.2, 1.3), (103, 2, 3, 1, 0.3, 1.3),
    ]
    assert "Exchange" not in plan_of(flat)


def test_parameters_in_a_map(nested):
    as_map = nested.withColumn("cond_params", F.create_map(F.lit("drift"), F.col("cond_params.drift")))
    with pytest.raises(TypeError):
        flatten_results(as_map)
    flat = flatten_results(as_map, param_names=["drift", "absent"])
    got = sorted((r.condition_idx, r.trial_idx, r.rank_idx, r.drift, r.absent) for r in flat.collect())
    assert got[0] == (1, 1, 1, 0.5, None) and got[-1] == (3, 2, 3, 1.3, None)


def test_counts(nested):
    got = {r.condition_idx: r.n for r in nested.select("condition_idx", count_responses(nested).alias("n")).collect()}
    assert got == {1: 2, 2: 0, 3: 4}
    assert flatten_results(nested).count() == 6


def test_design(spark):
    table = design_table(
        condition_range(spark, 4),
        condition_formulas=[("v_0", uniform("v", "condition_idx", low=0.01, high=0.02))],
        n_trials=3,
        trial_formulas=[("shift", uniform("s", "condition_idx", "trial_idx"))],
        n_items=5,
        item_formulas=[("v", F.col("v_0") * F.col("item_idx"))],
    )
    assert table.count() == 60 and "Exchange" not in plan_of(table)
    assert table.where("v_0 between 0.01 and 0.02").count() == 60
    assert table.groupBy("condition_idx").agg(F.countDistinct("v_0").alias("n")).where("n = 1").count() == 4
    assert table.select("condition_idx", "trial_idx", "shift").distinct().count() == 12
    assert design_table(condition_range(spark, 3), n_trials=1, n_items=1).columns == ["condition_idx", "trial_idx", "item_idx"]


def test_to_long(spark):
    df = spark.createDataFrame([(1, 2, 3.5)], "id int, a int, `b.c` double")
    got = {(r.id, r.parameter, r.value) for r in to_long(df, ["id"], ["a", "b.c"]).collect()}
    assert got == {(1, "a", 2.0), (1, "b.c", 3.5)}


def test_variants_of_several_models_flatten_without_names(spark, tmp_path):
    from trialkit.operators.nest import as_variant, parameter_types

    trials = "array<struct<item_idx:array<int>,rt:array<double>>>"
    schema = f"condition_idx long, model string, cond_params %s, result {trials}"
    two = [([1, 2], [0.1, 0.2]), ([], []), ([3], [0.5])]
    a = spark.createDataFrame([(1, "a", ([1.5, 2.5, 3.5], [1, 2, 3]), two)], schema % "struct<drift:array<double>,n:array<int>>")
    b = spark.createDataFrame(
        [(2, "b", {"it's \"a\" name": ["x", "y", "z"], "condition_idx": ["7", "8", "9"]}, two)], schema % "map<string,array<string>>"
    )
    c = spark.createDataFrame([(3, "c", (0.25, [True, None, False]), two)], schema % "struct<drift:double,flag:array<boolean>>")
    d = spark.createDataFrame([(4, "d", None, two)], schema % "struct<drift:double>")
    for df in (a, b, c, d):
        as_variant(df).write.mode("append").parquet(str(tmp_path / "models"))
    df = spark.read.parquet(str(tmp_path / "models"))
    assert parameter_types(df) == {
        "condition_idx": ("string", True),
        "drift": ("double", True),
        "flag": ("boolean", True),
        "it's \"a\" name": ("string", True),
        "n": ("double", True),
    }
    flat = flatten_results(df.where("model <> 'c'"))
    assert flat.columns == ["model", "condition_idx", "trial_idx", "rank_idx", "item_idx", "rt", "drift", "it's \"a\" name", "n"]
    rows = {(r.model, r.trial_idx, r.rank_idx): r for r in flat.collect()}
    assert len(rows) == 9
    assert [rows["a", t, k].drift for t, k in ((1, 1), (1, 2), (3, 1))] == [1.5, 1.5, 3.5]
    assert rows["a", 3, 1].n == 3.0 and rows["a", 3, 1]["it's \"a\" name"] is None
    assert rows["b", 3, 1]["it's \"a\" name"] == "z" and rows["b", 3, 1].drift is None
    assert rows["b", 3, 1].condition_idx == "9"
    assert rows["d", 1, 1].drift is None
    # one value for all trials beside values by trial
    every = {(r.model, r.trial_idx, r.rank_idx): r for r in flatten_results(df).collect()}
    assert len(every) == 12
    assert [every[m, 3, 1].drift for m in "abcd"] == [3.5, None, 0.25, None]
    assert [every["c", t, 1].flag for t in (1, 3)] == [True, False]
    one = flatten_results(df.where("model = 'c'"), param_names=["drift", "absent"]).collect()
    assert [(r.drift, r.absent) for r in one] == [(0.25, None)] * 3
