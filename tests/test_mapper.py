from collections.abc import Iterator

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialkit.functions import stats as S
from trialkit.operators import mapper
from trialkit.operators.mapper import map_by_condition
from trialkit.operators.summarise import summarise
from trialkit.sources.checkpoints import materialise

SCHEMA = "condition_idx long, n long, total double"


@pytest.fixture(scope="module")
def rows(spark):
    # condition 0 holds most rows
    return spark.range(400).select(
        F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 4).cast("long").alias("condition_idx"),
        (F.col("id") / 3).alias("rt"),
        F.col("id").alias("trial_idx"),
    )


def sums(pdf: pd.DataFrame, factor: float = 1.0) -> pd.DataFrame:
    return pd.DataFrame(
        {"condition_idx": pdf["condition_idx"].head(1), "n": [len(pdf)], "total": [pdf["rt"].sum() * factor]}
    )


def merge(parts: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(
        {"condition_idx": parts["condition_idx"].head(1), "n": [parts["n"].sum()], "total": [parts["total"].sum()]}
    )


def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    n, total, key = 0, 0.0, None
    for pdf in batches:
        n, total, key = n + len(pdf), total + pdf["rt"].sum(), pdf["condition_idx"].iloc[0]
    yield pd.DataFrame({"condition_idx": [key], "n": [n], "total": [total]})


def read(df):
    return {r.condition_idx: (r.n, pytest.approx(r.total)) for r in df.collect()}


def test_native_equals_python(rows):
    spec = summarise(n=S.count(), total=F.sum("rt"))
    native = read(map_by_condition(rows, spec, combine=lambda t: t.df))
    assert set(native) == {0, 1, 2, 3}
    assert read(map_by_condition(rows, sums, schema=SCHEMA)) == native
    assert read(map_by_condition(rows, stream, schema=SCHEMA)) == native
    assert read(map_by_condition(rows, sums, schema=SCHEMA, merge=merge, block_rows=20)) == native


def test_pieces_are_bounded(rows):
    seen = map_by_condition(
        rows,
        lambda pdf: pd.DataFrame({"condition_idx": pdf["condition_idx"].head(1), "n": [len(pdf)]}),
        schema="condition_idx long, n long",
        merge=lambda parts: pd.DataFrame({"condition_idx": parts["condition_idx"].head(1), "n": [parts["n"].max()]}),
        block_rows=50,
    )
    assert max(r.n for r in seen.collect()) <= 50


def test_equal_rows_are_cut_into_pieces(spark):
    same = spark.range(1000).select(F.lit(1).cast("long").alias("condition_idx"), F.lit(2.5).alias("rt"))
    count = lambda pdf: pd.DataFrame({"condition_idx": [1], "n": [len(pdf)]})
    listed = lambda parts: pd.DataFrame({"condition_idx": [1], "n": [len(parts) * 1000 + parts["n"].max()]})
    out = map_by_condition(same, count, schema="condition_idx long, n long", merge=listed, block_rows=50)
    assert out.first().n == 20 * 1000 + 50


def test_many_rows_change_nothing(spark):
    """Beyond the block size all forms still give what the spec gives."""
    many = spark.range(260_000).select(
        F.when(F.col("id") < 255_000, 0).otherwise(1).cast("long").alias("condition_idx"), (F.col("id") % 1000 / 8).alias("rt")
    )
    spec = summarise(n=S.count(), total=F.sum("rt"))
    native = read(map_by_condition(many, spec, combine=lambda t: t.df))
    assert read(map_by_condition(many, sums, schema=SCHEMA)) == native
    assert read(map_by_condition(many, stream, schema=SCHEMA)) == native
    assert read(map_by_condition(many, sums, schema=SCHEMA, merge=merge)) == native
    assert read(map_by_condition(many, stream, schema=SCHEMA, merge=merge)) == native


def test_arguments_and_combiner(rows):
    doubled = map_by_condition(rows, sums, 2.0, schema=SCHEMA)
    named = map_by_condition(rows, sums, factor=2.0, schema=SCHEMA, combine=lambda df: df.agg(F.sum("total")).first()[0])
    assert named == pytest.approx(sum(r.total for r in doubled.collect()))


def test_refusals(rows):
    with pytest.raises(TypeError):
        map_by_condition(rows, 3, schema=SCHEMA)
    with pytest.raises(ValueError, match="schema"):
        map_by_condition(rows, sums)


def joined(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """Associative, but not commutative: the order of the conditions shows."""
    assert len(a) == len(b) == 1
    return pd.DataFrame({"condition_idx": [a.condition_idx[0]], "text": [a.text[0] + b.text[0]], "n": [a.n[0] + b.n[0]]})


def one_line(rows: pd.DataFrame) -> pd.DataFrame:
    c = rows.condition_idx.iloc[0]
    return pd.DataFrame({"condition_idx": [c], "text": [f"{c if pd.notna(c) else 'x'} "], "n": [len(rows)]})


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 40])
def test_associative_results_merge_in_a_tree(spark, n, monkeypatch):
    from trialkit.operators import mapper

    levels = []
    plain = mapper.materialise
    monkeypatch.setattr(mapper, "materialise", lambda df: levels.append(df.columns) or plain(df))
    df = spark.range(n * 5).select((F.col("id") % max(n, 1)).alias("condition_idx"), F.lit(1.0).alias("rt")).repartition(4)
    schema = "condition_idx bigint, text string, n long"
    out = map_by_condition(df, one_line, schema=schema, combine=joined, associative=True, fan_in=3)
    assert out.columns == ["condition_idx", "text", "n"]
    rows = out.collect()
    if n == 0:
        assert rows == []
        return
    assert [tuple(r) for r in rows] == [(0, "".join(f"{c} " for c in range(n)), 5 * n)]
    # two tables, and one for each level of a tree of three
    assert len(levels) == 2 + sum(3**k < n for k in range(10))


def test_associative_with_a_missing_condition_and_pieces(spark):
    df = spark.createDataFrame([(None, 1.0), (2, 1.0), (1, 1.0), (1, 1.0)], "condition_idx long, rt double")
    schema = "condition_idx bigint, text string, n long"

    def whole(parts: pd.DataFrame) -> pd.DataFrame:
        return parts.iloc[:1].assign(n=parts["n"].sum())

    out = map_by_condition(df, one_line, schema=schema, merge=whole, block_rows=1, combine=joined, associative=True, fan_in=2)
    assert [(r.text, r.n) for r in out.collect()] == [("x 1.0 2.0 ", 4)] or [(r.text, r.n) for r in out.collect()] == [("x 1 2 ", 4)]
    with pytest.raises(ValueError, match="two results"):
        map_by_condition(df, one_line, schema=schema, combine=joined, associative=True, fan_in=1)


def test_equal_rows_and_maps_are_spread(spark):
    """Equal rows do not meet in one piece, nor in one range of the order; a map is no hindrance."""
    df = spark.range(4000).select(F.lit(1).cast("long").alias("condition_idx"), F.lit(2.0).alias("rt"), F.create_map(F.lit("a"), F.lit(1)).alias("m"))

    def size(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"condition_idx": [1], "n": [len(rows)]})

    out = map_by_condition(df, size, schema="condition_idx bigint, n long", merge=lambda parts: parts, block_rows=500).collect()
    assert [r.n for r in out] == [500] * 8
    from trialkit.operators.blocks import Blocks

    seen = []
    with pytest.MonkeyPatch.context() as patch:
        plain = Blocks.of.__func__
        patch.setattr(Blocks, "of", classmethod(lambda cls, *a, **k: seen.append(plain(cls, *a, **k)) or seen[-1]))
        map_by_condition(df, size, schema="condition_idx bigint, n long", merge=lambda parts: parts, block_rows=500)
    assert max(r["count"] for r in seen[0].rows.groupBy("__block").count().collect()) < 1500


def test_small_results_go_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(mapper, "CALLS", 40)
    some = spark.range(400).select((F.col("id") % 200).alias("condition_idx"), (F.col("id") * 1.0).alias("rt"))
    whole = map_by_condition(some, sums, schema=SCHEMA, merge=merge, block_rows=1)
    placed = whole.select("*", F.spark_partition_id().alias("task")).collect()
    assert len({r["task"] for r in placed}) > 2
    assert sorted((r["condition_idx"], r["n"]) for r in placed) == [(k, 2) for k in range(200)]


def test_merged_results_go_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(mapper, "CALLS", 40)
    some = spark.range(400).select((F.col("id") % 200).alias("condition_idx"), (F.col("id") * 1.0).alias("rt"))
    levels = []

    def kept(df):
        levels.append((df.columns, df.select(F.spark_partition_id()).distinct().count()))
        return materialise(df)

    monkeypatch.setattr(mapper, "materialise", kept)
    total = map_by_condition(some, sums, schema=SCHEMA, combine=lambda a, b: a + b, associative=True, fan_in=2)
    assert [tuple(r) for r in total.collect()] == [(sum(range(200)), 400, sum(range(400)))]
    tasks = [n for names, n in levels if mapper.SLOT in names and "total" in names]
    assert tasks[0] > 2 and tasks[-1] == 1
