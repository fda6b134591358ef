import numpy as np
import pytest
from pyspark.sql import functions as F

from trialkit.operators.blocks import (
    Blocks,
    average_ranks,
    group_quantiles,
    group_sizes,
    order_statistics,
    row_numbers,
    running_sums,
)

FORCE = 10  # every group counts as big


def by_key(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.k, []).append(r)
    return groups


def test_group_sizes(skewed):
    sizes = group_sizes(skewed, ["k"])
    assert sizes.total == 3000 and sizes.largest > 1000
    assert group_sizes(skewed, []).largest == 3000
    assert group_sizes(skewed.limit(0), ["k"]).largest == 0


def test_a_big_group_is_spread_over_blocks(skewed):
    rows = skewed.where("k = 'hot'")
    blocks = Blocks.of(rows, ["k"], ["v", "id"], FORCE)
    counts = [r["count"] for r in blocks.rows.groupBy("__block").count().collect()]
    assert len(counts) >= 4 and max(counts) < rows.count() / 2


@pytest.mark.parametrize("block_rows", [None, FORCE])
def test_running_sums(skewed, block_rows):
    got = running_sums(skewed, ["k"], ["v", "id"], {"s": F.col("id"), "n": F.lit(1)}, block_rows).collect()
    assert len(got) == 3000
    for rows in by_key(got).values():
        total = 0
        for i, r in enumerate(sorted(rows, key=lambda r: (r.v, r.id)), 1):
            total += r.id
            assert (r.s, r.n) == (total, i)


@pytest.mark.parametrize("block_rows", [None, FORCE])
def test_row_numbers_without_keys(skewed, block_rows):
    got = sorted(row_numbers(skewed, [], ["v", "id"], "place", block_rows).collect(), key=lambda r: (r.v, r.id))
    assert [r.place for r in got] == list(range(1, 3001))


@pytest.mark.parametrize("block_rows", [None, FORCE])
def test_quantiles(skewed, block_rows):
    probs = [0.0, 0.025, 0.1, 0.5, 1 / 3, 0.9, 1.0]
    got = {r.k: r for r in group_quantiles(skewed, ["k"], "v", probs, block_rows).collect()}
    groups = by_key(skewed.collect())
    assert set(got) == set(groups)
    for k, rows in groups.items():
        assert got[k].n == len(rows)
        assert got[k].q == pytest.approx(list(np.quantile([r.v for r in rows], probs)), rel=1e-12)


def test_both_quantile_plans_agree_to_the_last_bit(skewed):
    probs = [i / 100 for i in range(0, 101, 7)]
    a = sorted(map(str, group_quantiles(skewed, ["k"], "v", probs).collect()))
    assert a == sorted(map(str, group_quantiles(skewed, ["k"], "v", probs, FORCE).collect()))


def test_quantiles_skip_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("a", 3.0), ("b", None)], "k string, v double")
    for block_rows in (None, 1):
        got = group_quantiles(df, ["k"], "v", [0.5], block_rows).collect()
        assert [(r.k, r.n, r.q) for r in got] == [("a", 2, [2.0])]


@pytest.mark.parametrize("block_rows", [None, FORCE])
def test_order_statistics(skewed, block_rows):
    got = {r.k: r.x for r in order_statistics(skewed, ["k"], "v", [1, 7, 100], block_rows).collect()}
    for k, rows in by_key(skewed.collect()).items():
        values = sorted(r.v for r in rows)
        assert got[k] == [values[0], values[6], values[99]]


@pytest.mark.parametrize("block_rows", [None, FORCE])
def test_average_ranks(skewed, block_rows):
    got = average_ranks(skewed, ["k"], "v", "rank", block_rows).collect()
    assert len(got) == 3000
    for rows in by_key(got).values():
        values = [r.v for r in rows]
        for r in rows:
            below, equal = sum(v < r.v for v in values), sum(v == r.v for v in values)
            assert r["rank"] == below + (equal + 1) / 2


def test_results_do_not_depend_on_shuffle_partitions(spark, skewed):
    def run():
        return sorted(map(str, group_quantiles(skewed, ["k"], "v", [0.3, 0.6], FORCE).collect()))

    before = spark.conf.get("spark.sql.shuffle.partitions")
    eight = run()
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        assert run() == eight
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
