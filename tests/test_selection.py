import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from trialkit.operators import selection, trim
from trialkit.operators.blocks import Blocks, group_quantiles, order_statistics
from trialkit.operators.selection import ordered_bits, select_ranks


def pattern(x: float) -> int:
    bits = struct.unpack("q", struct.pack("d", abs(x)))[0]
    return -bits if x < 0 else bits


def test_bits_are_those_of_the_number(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 5e-324, -5e-324, math.inf, -math.inf, 1.7976931348623157e308, -1.7976931348623157e308]
    for e in range(-1074, 1024):
        p = math.ldexp(1.0, e)
        values += [p, math.nextafter(p, 0), -math.nextafter(p, math.inf)]
    values += [x for _ in range(3000) if not math.isnan(x := struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0])]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", ordered_bits("v").alias("b")).collect()
    assert len(rows) == len(values)
    assert [r for r in rows if r.b != pattern(r.v)] == []
    odd = spark.createDataFrame([(math.nan,), (None,)], "v double").select(ordered_bits("v").alias("b")).collect()
    assert [r.b for r in odd] == [None, None]


@pytest.fixture
def written(monkeypatch):
    """Sizes of the tables that selection and bounds write; ordering rows in blocks fails."""
    sizes = []
    for module in (selection, trim):
        plain = module.materialise

        def counted(df, plain=plain):
            out = plain(df)
            sizes.append(out.count())
            return out

        monkeypatch.setattr(module, "materialise", counted)
    monkeypatch.setattr(Blocks, "of", lambda *_, **__: pytest.fail("rows are put in order"))
    return sizes


def test_quantiles_equal_percentile_without_moving_rows(spark, written, monkeypatch):
    rng = random.Random(4)
    data = [("hot", rng.gauss(0, 1e3)) for _ in range(20_000)] + [("few", rng.choice([-1.5, 0.0, 2.0])) for _ in range(50)]
    data += [(None, math.inf), (None, -math.inf), (None, 3.0), ("hot", None), ("hot", math.nan), ("none", None)]
    df = spark.createDataFrame(data, "k string, v double")
    probs = [0.0, 0.025, 1 / 3, 0.5, 0.9, 0.999, 1.0]
    monkeypatch.setattr(type(df), "repartitionByRange", lambda *_: pytest.fail("range exchange"))
    got = {r.k: (r.n, [pattern(x) if not math.isnan(x) else None for x in r.q]) for r in group_quantiles(df, ["k"], "v", probs, 10).collect()}
    plain = df.where("v IS NOT NULL AND NOT isnan(v)").groupBy("k").agg(
        F.count("v").alias("n"), F.percentile("v", F.array(*[F.lit(p) for p in probs])).alias("q")
    )
    assert got == {r.k: (r.n, [pattern(x) if not math.isnan(x) else None for x in r.q]) for r in plain.collect()}
    # what is written follows the ranks, not the rows
    assert max(written) <= 3 * (2 * len(probs) + 1)


def test_ranks_outside_a_group(spark, written):
    df = spark.createDataFrame([("a", float(x)) for x in (3, 1, 2)] + [("b", 9.0)], "k string, v double")
    for block_rows in (None, 1):
        got = {r.k: r.x for r in order_statistics(df, ["k"], "v", [1, 3, 7], block_rows).collect()}
        assert got == {"a": [1.0, 3.0, None], "b": [9.0, None, None]}


def test_no_groups_and_no_rows(spark):
    df = spark.range(100).select((F.col("id") / 7 - 5).alias("v"))
    row = select_ranks(df, [], "v", lambda n: [F.lit(0), n - 1]).first()
    assert (row.n, row.x) == (100, [-5.0, 99 / 7 - 5])
    nothing = select_ranks(df.limit(0), [], "v", lambda n: [F.lit(0)]).first()
    assert (nothing.n, nothing.x) == (0, [None])


def test_bounds_explode_cells_not_rows(spark, written):
    """Big groups: the same distances as with every row, from tables that do not grow with the rows."""
    rng = random.Random(8)
    sizes = {}
    for n in (4_000, 40_000):
        data = [(1, 1, rng.lognormvariate(0, 0.5)) for _ in range(n)] + [(2, 1, rng.random() + 0.1) for _ in range(n)]
        data += [(3, 1, rng.random()) for _ in range(20)]
        df = spark.createDataFrame(data, "condition_idx long, rank_idx int, rt double").repartition(4)
        written.clear()
        got = {(r.condition_idx, r.trim): r for r in trim.trim_cells(df, block_rows=1000).collect()}
        sizes[n] = sum(written)
        for r in trim.trim_cells(df).collect():
            mine = got.pop((r.condition_idx, r.trim))
            assert (mine.n_used, mine.q_upper) == (r.n_used, r.q_upper)
            assert mine.ks_statistic == pytest.approx(r.ks_statistic, abs=1e-12)
        assert got == {}
    assert sizes[40_000] < 2 * sizes[4_000]
