import math

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from trialkit.functions import stats as S
from trialkit.operators.summarise import SummaryTable, bind_rows, summarise, summarise_by


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        (1, 1.0, 10.0),
        (1, 1.0, 20.0),
        (1, 2.0, 30.0),
        (2, 1.0, 5.0),
        (2, None, 7.0),
        (None, 2.0, 9.0),
    ]
    return spark.createDataFrame(data, "condition_idx long, item_idx double, rt double")


def as_dict(table, key="condition_idx"):
    return {r[key]: r.asDict() for r in table.df.collect()}


def test_names(rows):
    table = summarise(
        m=S.mean("rt"),
        q=S.quantiles("rt", [0.1, 0.5, 0.975]),
        one=S.quantiles("rt", [0.1]),
        v=S.vector([F.min("rt"), F.max("rt")]),
        w=S.vector({"lo": F.min("rt"), "": F.max("rt")}),
        u=S.vector([F.min("rt")]),
        x=S.vector({"lo": F.min("rt")}, as_list=True),
        y=S.vector([F.min("rt")], as_list=True),
    )(rows)
    assert table.df.columns == [
        "condition_idx", "m", "q_10%", "q_50%", "q_97.5%", "one", "v_X1", "v_X2", "w_X1", "w_X2", "u", "x_lo", "y_X1",
    ]
    got = as_dict(table)
    assert got[1]["q_50%"] == 20.0 and got[1]["one"] == pytest.approx(12.0)
    assert set(got) == {1, 2, None}


def test_pivot(rows):
    table = summarise(by=["condition_idx", "item_idx"], m=S.mean("rt"), n=S.count())(rows)
    # groups read in key order, NULL last; a double holding an integer reads as one
    assert table.df.columns == [
        "condition_idx",
        "m_item_idx_1", "m_item_idx_2", "m_item_idx_NA",
        "n_item_idx_1", "n_item_idx_2", "n_item_idx_NA",
    ]
    got = as_dict(table)
    assert got[1]["m_item_idx_1"] == 15.0 and got[1]["m_item_idx_NA"] is None
    assert got[2]["n_item_idx_NA"] == 1 and got[2]["m_item_idx_2"] is None
    assert got[None]["m_item_idx_2"] == 9.0


def test_pivot_order_is_first_appearance(spark):
    df = spark.createDataFrame([(1, "b", 1.0), (2, "a", 2.0), (2, "b", 3.0)], "condition_idx long, item string, rt double")
    table = summarise(by=["condition_idx", "item"], m=S.mean("rt"))(df)
    assert table.df.columns == ["condition_idx", "item_b", "item_a"]


def test_lone_value_column_has_no_prefix(rows):
    table = summarise(by=["condition_idx", "item_idx"], m=S.mean("rt"))(rows)
    assert table.df.columns == ["condition_idx", "item_idx_1", "item_idx_2", "item_idx_NA"]


def test_subset_check():
    with pytest.raises(ValueError, match="not in by: item"):
        summarise(by=["condition_idx"], wider_by=["item"], m=S.count())


def test_empty_input_keeps_its_columns(rows):
    table = summarise(m=S.mean("rt"), q=S.median("rt"))(rows.limit(0))
    assert table.df.columns == ["condition_idx", "m", "q"] and table.df.count() == 0


def test_spec_addition_and_listing(rows):
    spec = summarise(m=S.mean("rt")) + summarise(by=["condition_idx", "item_idx"], m=S.mean("rt")) + summarise(m=S.sd("rt"))
    assert "3 operation(s)" in repr(spec) and "by=[condition_idx, item_idx]" in repr(spec)
    table = spec(rows)
    assert table.df.columns == ["condition_idx", "m.x", "item_idx_1", "item_idx_2", "item_idx_NA", "m.y"]
    # applying them one by one and joining the tables gives the same
    step = [summarise(m=S.mean("rt"))(rows), summarise(by=["condition_idx", "item_idx"], m=S.mean("rt"))(rows)]
    joined = step[0] + step[1] + summarise(m=S.sd("rt"))(rows)
    assert joined.df.columns == table.df.columns
    key = lambda r: (r[0] is None, r[0])
    assert sorted(joined.df.collect(), key=key) == sorted(table.df.collect(), key=key)


def test_operations_with_equal_groups_share_one_aggregation(rows):
    table = (summarise(m=S.mean("rt")) + summarise(s=S.sd("rt")))(rows)
    assert plan_of(table.df).count("Exchange") == 1


def test_join(spark):
    a = SummaryTable(spark.createDataFrame([(1, 1.0), (None, 2.0)], "k long, x double"), ("k",))
    b = SummaryTable(spark.createDataFrame([(2, 5.0), (None, 6.0)], "k long, x double"), ("k",))
    got = {r.k: (r["x.x"], r["x.y"]) for r in (a + b).df.collect()}
    assert got == {1: (1.0, None), 2: (None, 5.0), None: (2.0, 6.0)}
    empty = SummaryTable(a.df.limit(0), ("k",))
    assert {(r.k, r["x.x"]) for r in (a + empty).df.collect()} == {(1, 1.0), (None, 2.0)}
    with pytest.raises(ValueError, match="different keys"):
        a + SummaryTable(b.df.withColumnRenamed("k", "j"), ("j",))


def test_global(rows):
    table = (
        summarise(by=None, wider_by=None, n=S.count(), q=S.median("rt"))
        + summarise(by="item_idx", wider_by=None, m=F.max("rt"))
    )(rows)
    assert table.key == ()
    assert [tuple(r) for r in table.df.collect()] == [(6, 9.5, 20.0, 30.0, 7.0)]
    pair = summarise(by=None, wider_by=None, n=S.count())(rows) + summarise(by=None, wider_by=None, n=S.count())(rows)
    assert pair.df.columns == ["n.x", "n.y"] and pair.df.count() == 1


def test_line_and_aic(spark):
    data = [("line", float(x), 2.0 * x + 1.0) for x in range(5)]
    data += [("flat", 3.0, 1.0), ("flat", 3.0, 5.0), ("one", 1.0, 4.0), ("gap", 1.0, None), ("gap", 2.0, 3.0), ("gap", 4.0, 7.0)]
    data += [("free", float(x), y) for x, y in enumerate([1.0, 4.0, 2.0, 8.0, 3.0])]
    df = spark.createDataFrame(data, "condition_idx string, x double, y double")
    got = as_dict(summarise(c=S.lm("y", "x"), aic=S.gaussian_aic("y", "x"))(df))
    assert (got["line"]["c_(Intercept)"], got["line"]["c_x"]) == pytest.approx((1.0, 2.0))
    assert got["flat"]["c_(Intercept)"] == 3.0 and got["flat"]["c_x"] is None
    assert got["one"]["c_(Intercept)"] == 4.0
    assert (got["gap"]["c_(Intercept)"], got["gap"]["c_x"]) == pytest.approx((-1.0, 2.0))
    xs, ys = range(5), [1.0, 4.0, 2.0, 8.0, 3.0]
    sxx, mx, my = 10.0, 2.0, 3.6
    slope = sum((x - mx) * (y - my) for x, y in zip(xs, ys)) / sxx
    rss = sum((y - my - slope * (x - mx)) ** 2 for x, y in zip(xs, ys))
    assert got["free"]["aic"] == pytest.approx(5 * (math.log(2 * math.pi * rss / 5) + 1) + 6)
    # one coefficient less where x is constant
    assert got["flat"]["aic"] == pytest.approx(2 * (math.log(2 * math.pi * 8.0 / 2) + 1) + 4)


def test_strict_and_missing(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (2, 1.0), (2, float("nan")), (3, 2.0), (3, 4.0)], "condition_idx int, rt double")
    got = as_dict(
        summarise(a=S.mean("rt"), b=S.mean("rt", strict=True), c=S.sd("rt"), d=S.median("rt"), e=S.median("rt", strict=True))(df)
    )
    assert [got[k]["a"] for k in (1, 2, 3)] == [1.0, 1.0, 3.0]
    assert [got[k]["b"] for k in (1, 2, 3)] == [None, None, 3.0]
    assert [got[k]["e"] for k in (1, 2, 3)] == [None, None, 3.0]
    assert got[1]["c"] is None and got[1]["d"] == 1.0


def test_first_share_omission(spark):
    df = spark.createDataFrame([(1, 2, 1, 5.0), (1, 1, 2, 6.0), (1, 1, 1, 7.0)], "condition_idx int, t int, r int, rt double")
    got = as_dict(summarise(f=S.first("rt", ["t", "r"]), s=S.share(F.col("rt") > 5), o=S.omission_rate(4))(df))
    assert (got[1]["f"], got[1]["s"], got[1]["o"]) == (7.0, pytest.approx(2 / 3), 0.25)


def test_big_groups_give_the_same(skewed):
    spec = summarise(by="k", wider_by="k", q=S.quantiles("v", [0.1, 0.5]), n=S.count(), m=S.mean("v")) + summarise(
        by=["k", "v"], wider_by="k", big=S.median("id")
    )
    df = skewed.withColumn("v", F.when(F.col("v") <= 2, F.col("v")).otherwise(3.0))
    df = df.withColumn("v", F.ceil("v"))
    small, big = spec(df), spec(df, block_rows=10)
    assert small.df.columns == big.df.columns
    key = lambda r: (r[0] is None, r[0])
    for a, b in zip(sorted(small.df.collect(), key=key), sorted(big.df.collect(), key=key)):
        assert a == b


def test_quantile_summary_moves_the_rows_once(rows):
    table = (summarise(q=S.median("rt")) + summarise(by=["condition_idx", "item_idx"], q=S.median("rt")))(rows)
    plan = plan_of(table.df)
    # both aggregations and the fold work on the partitioning by condition
    assert plan.count("REPARTITION_BY_COL") == 2 and plan.count("ENSURE_REQUIREMENTS") <= 1


def test_bind_rows_and_immediate_form(rows):
    a = summarise_by(rows, m=S.mean("rt")).df
    b = summarise_by(rows, n=S.count()).df
    got = bind_rows(a, b)
    assert got.columns == ["condition_idx", "m", "n"] and got.count() == 6


def test_labels_read_as_text(spark):
    df = spark.createDataFrame(
        [(1, True, 0.1 + 0.2, 1.0), (1, False, 2.0, 2.0), (1, None, 1.5e-7, 3.0), (1, True, 0.25, 4.0)],
        "condition_idx long, yes boolean, x double, rt double",
    )
    logical = summarise(by=["condition_idx", "yes"], m=S.mean("rt"))(df)
    assert set(logical.statistics) == {"yes_TRUE", "yes_FALSE", "yes_NA"}
    numbers = summarise(by=["condition_idx", "x"], m=S.mean("rt"))(df)
    assert set(numbers.statistics) == {"x_0.3", "x_2", "x_1.5e-07", "x_0.25"}


def test_given_pivot_values(spark):
    df = spark.range(50).select((F.col("id") % 3).alias("condition_idx"), (F.col("id") % 5).alias("item"), (F.col("id") * 1.0).alias("rt"))
    spec = summarise(by=["condition_idx", "item"], pivot_values=[3, 0, 9], m=S.mean("rt"))
    # more values than Spark's own limit are fine when they are given
    spark.conf.set("spark.sql.pivotMaxValues", "2")
    try:
        table = spec(df)
        with pytest.raises(ValueError, match="pivot_values"):
            summarise(by=["condition_idx", "item"], m=S.mean("rt"))(df)
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")
    assert table.df.columns == ["condition_idx", "item_3", "item_0", "item_9"]
    assert all(r["item_9"] is None and r["item_3"] is not None for r in table.df.collect())


def test_python_aggregates_beside_built_in_ones(rows):
    import pandas as pd

    @F.pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min()) if v.notna().any() else -1.0

    keys = ["condition_idx", "item_idx"]
    spec = summarise(by=keys, wider_by=keys, spread=spread("rt"), m=S.mean("rt"), q=S.median("rt"), low=F.min("rt"), high=F.max("rt"))
    got = spec(rows).df.collect()
    assert len(got) == rows.select(*keys).distinct().count()
    for r in got:
        if r["low"] is not None and r["low"] == r["low"] and r["high"] == r["high"]:
            assert r["spread"] == pytest.approx(r["high"] - r["low"])
    alone = summarise(by=None, wider_by=None, spread=spread("rt"), n=S.count())(rows).df.collect()
    assert len(alone) == 1 and alone[0]["n"] == rows.count()
