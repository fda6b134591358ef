import math

import pytest
from pyspark.sql import functions as F

from trialkit.functions.columns import (
    complete_cases,
    finite_rows,
    is_finite,
    normal,
    recycle,
    require_columns,
    uniform,
    valid_time,
    with_formulas,
    with_normal_cdf,
)
from trialkit.sources.results import chunk_column

VALUES = [(0, 1.5), (1, None), (2, float("nan")), (3, 0.0), (4, -1.0), (5, math.inf), (6, -math.inf)]


def test_valid_and_finite(spark):
    df = spark.createDataFrame(VALUES, "i int, x double")
    assert [r.i for r in df.where(valid_time("x")).collect()] == [0]
    assert sorted(r.i for r in df.where(is_finite("x")).collect()) == [0, 3, 4]
    # the negation works too: the tests never give NULL
    assert sorted(r.i for r in df.where(~is_finite("x")).collect()) == [1, 2, 5, 6]
    assert sorted(r.i for r in complete_cases(df).collect()) == [0, 3, 4, 5, 6]
    assert sorted(r.i for r in finite_rows(df, ["x", "i"]).collect()) == [0, 3, 4]


def test_formulas(spark):
    df = spark.range(7)
    assert [r.a for r in with_formulas(df, [("a", 5)]).collect()] == [5] * 7
    row = with_formulas(spark.range(1), [("a", 1), ("b", F.col("a") + 2), ("a", F.col("b") * 10)]).first()
    assert (row.a, row.b) == (30, 3)
    assert with_formulas(spark.range(1), [("x", 1), ("id", 9)]).columns == ["id", "x"]


def test_recycle(spark):
    df = spark.range(1, 7)
    assert [r[0] for r in df.select(recycle([1.0, 2.0, 3.0], "id", 6)).collect()] == [1, 2, 3, 1, 2, 3]
    assert [r[0] for r in df.select(recycle([4.0], "id", 6)).collect()] == [4] * 6
    with pytest.raises(ValueError):
        recycle([1.0, 2.0, 3.0, 4.0], "id", 6)


def test_draws_do_not_depend_on_partitions(spark):
    draws = [uniform("s", "id", low=2.0, high=3.0).alias("u"), normal("s", "id").alias("n")]
    a = spark.range(500, numPartitions=1).select("id", *draws).orderBy("id").collect()
    b = spark.range(500, numPartitions=7).repartition(3).select("id", *draws).orderBy("id").collect()
    assert a == b
    assert all(2 < r.u < 3 for r in a)
    assert abs(sum(r.n for r in a) / 500) < 0.15
    assert len({r.u for r in a}) == 500


def test_normal_cdf(spark):
    zs = [x / 8 for x in range(-320, 321)] + [-7.0710678, 7.0710679]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    for row in with_normal_cdf(df, "z", "p").collect():
        assert row.p == pytest.approx(0.5 * math.erfc(-row.z / math.sqrt(2)), abs=4e-16)


def test_chunks_and_column_check(spark):
    got = [r[0] for r in spark.range(1, 8).select(chunk_column(3, "id")).collect()]
    assert got == [1, 1, 1, 2, 2, 2, 3]
    with pytest.raises(ValueError, match="missing columns: z.*available columns: id"):
        require_columns(spark.range(1), ["id", "z"])
