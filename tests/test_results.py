import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from trialkit.sources.checkpoints import scratch_folder
from trialkit.sources.results import CONDITIONS, DATASET, Folder, ResultSet, as_results, chunk_column, dense_codes


@pytest.fixture
def rows(spark):
    return spark.range(1, 21).select(
        F.col("id").alias("condition_idx"), (F.col("id") * 1.5).alias("rt"), chunk_column(6, "id").alias("chunk_idx")
    )


def test_round_trip(spark, rows):
    store = ResultSet.create(spark, scratch_folder(spark, "rs"), {"n": 20})
    store.append(rows.where("condition_idx <= 10"))
    store.append(rows.where("condition_idx > 10"))
    store.write_conditions(rows.drop("rt"))
    with pytest.raises(FileNotFoundError, match="no manifest"):
        ResultSet.load(spark, store.path)
    store.finish()
    again = ResultSet.load(spark, store.path)
    assert again.settings == {"n": 20}
    assert sorted(map(tuple, again.dataset().select(rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    assert [r[0] for r in again.chunks().collect()] == [1, 2, 3, 4]
    assert again.conditions().count() == 20
    chunk = again.chunk(2)
    assert sorted(r.condition_idx for r in chunk.collect()) == [7, 8, 9, 10, 11, 12]
    assert "PartitionFilters: [isnotnull(chunk_idx" in plan_of(chunk)


def test_folder_checks_come_in_order(spark, rows):
    path = scratch_folder(spark, "rs")
    with pytest.raises(FileNotFoundError, match="does not exist"):
        ResultSet.load(spark, path)
    store = ResultSet.create(spark, path)
    folder = Folder(spark, path)
    assert folder.exists(CONDITIONS) and folder.exists(DATASET)
    with pytest.raises(FileExistsError):
        ResultSet.create(spark, path)
    other = scratch_folder(spark, "rs")
    Folder(spark, other).make("x")
    Folder(spark, other).write_text("manifest.json", "{}")
    with pytest.raises(FileNotFoundError, match="no result table"):
        ResultSet.load(spark, other)
    Folder(spark, store.path).write_text("manifest.json", "{}")
    with pytest.raises(ValueError, match="not a result manifest"):
        ResultSet.load(spark, store.path)
    with pytest.raises(ValueError, match="missing columns: chunk_idx"):
        store.append(rows.drop("chunk_idx"))


def stops_at(monkeypatch, method):
    def stop(*_, **__):
        raise RuntimeError("stopped")

    monkeypatch.setattr(ResultSet if hasattr(ResultSet, method) else Folder, method, stop)


@pytest.mark.parametrize("where", ["_record", "move", "before"])
def test_a_stopped_commit_is_done_again(spark, rows, monkeypatch, where):
    store = ResultSet.create(spark, scratch_folder(spark, "rs"))
    assert store.commit(rows.where("chunk_idx = 1")) == [1]
    with monkeypatch.context() as patch:
        if where == "before":
            store.append(rows.where("chunk_idx in (2, 3) and rt < 20"))  # half-published chunks
        else:
            stops_at(patch, where)
            with pytest.raises(RuntimeError, match="stopped"):
                store.commit(rows.where("chunk_idx <= 3"))
    assert store.committed() == {1: 6}
    with pytest.raises(ValueError, match=r"chunks \[2, 3\] are not as committed"):
        store.finish()
    again = ResultSet.resume(spark, store.path, {"n": 1})
    assert sorted({r.chunk_idx for r in again.missing(rows).collect()}) == [2, 3, 4]
    assert again.commit(rows) == [2, 3, 4]
    assert again.commit(rows) == []
    assert again.finish().committed() == {1: 6, 2: 6, 3: 6, 4: 2}
    done = ResultSet.load(spark, store.path)
    assert done.settings == {"n": 1}
    assert sorted(map(tuple, done.dataset().select(rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(FileExistsError, match="finished"):
        ResultSet.resume(spark, store.path)
    assert not Folder(spark, store.path).exists("staging/")


def test_parameters_prune_chunks(spark, rows):
    store = ResultSet.create(spark, scratch_folder(spark, "rs"))
    store.commit(rows)
    store.write_conditions(
        rows.select("condition_idx", (F.col("condition_idx") / 2).alias("p"), F.when(F.col("condition_idx") != 9, F.lit("x")).alias("name"), "chunk_idx")
        .withColumn("q", F.when(F.col("condition_idx") == 8, F.lit(float("nan"))).when(F.col("condition_idx") != 9, F.col("p")))
    )
    store.finish()

    def found(bounds):
        return sorted(r.condition_idx for r in store.where_parameters(bounds).collect())

    assert found({}) == list(range(1, 21))
    assert found({"p": (3.5, 5.0)}) == [7, 8, 9, 10]
    assert found({"q": (3.5, None), "condition_idx": (None, 13)}) == [7, 10, 11, 12, 13]
    assert found({"p": (100, None)}) == []
    with pytest.raises(ValueError, match="missing columns: nope"):
        store.where_parameters({"nope": (1, 2)})
    plan = plan_of(store.where_parameters({"p": (3.5, 5.0)}))
    assert plan.count("dynamicpruning") >= 2
    # chunks beyond the bounds are not read: they may hold anything
    folder = Folder(spark, store.path)
    for table in (DATASET, CONDITIONS):
        for chunk in (1, 3, 4):
            for name in folder.names(f"{table}/chunk_idx={chunk}"):
                folder.write_text(f"{table}/chunk_idx={chunk}/{name}", "no parquet")
    store = ResultSet.load(spark, store.path)
    reader = spark.read.schema(rows.schema)
    assert reader.parquet(folder.child(DATASET)).where("chunk_idx = 2").count() == 6
    with pytest.raises(Exception, match="(?i)parquet"):
        reader.parquet(folder.child(DATASET)).where("chunk_idx <= 2 and rt > 0").collect()
    store_dataset = reader.parquet(folder.child(DATASET))
    conditions = spark.read.schema("condition_idx long, p double, name string, q double, chunk_idx int").parquet(folder.child(CONDITIONS))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ResultSet, "dataset", lambda self: store_dataset)
        patch.setattr(ResultSet, "conditions", lambda self: conditions)
        assert found({"p": (3.5, 5.0)}) == [7, 8, 9, 10]


def test_observed_data(spark):
    df = spark.createDataFrame([("7", 1, 2, 0.9), ("7", 1, 1, 0.4), ("7", 2, 3, 0.1)], "s string, t int, i int, sec double")
    got = as_results(df, condition="s", trial="t", item="i", rt="sec", model="obs", params={"age": F.lit(30)})
    assert got.columns == ["condition_idx", "trial_idx", "item_idx", "rt", "model", "age", "rank_idx"]
    assert sorted((r.trial_idx, r.rank_idx, r.item_idx) for r in got.collect()) == [(1, 1, 1), (1, 2, 2), (2, 1, 3)]
    with pytest.raises(ValueError, match="missing columns: nope"):
        as_results(df, condition="nope", trial="t", item="i", rt="sec")


def test_dense_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "x string")
    got = {r.x: r.code for r in dense_codes(df, "x", "code").collect()}
    # a missing value has no code and moves no other
    assert got == {"a": 1, "b": 2, None: None}


def test_materialised_table(spark):
    from trialkit.sources import checkpoints

    df = spark.range(5).select(F.col("id").alias("a (x)"), F.when(F.col("id") > 2, F.col("id")).alias("b"))
    out = checkpoints.materialise(df)
    assert out.schema == df.schema
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))
    path = checkpoints._written[-1][1]
    assert Folder(spark, path).exists()
    # only this table is given up; others may still be read
    kept, checkpoints._written[:] = checkpoints._written[:-1], checkpoints._written[-1:]
    checkpoints.discard(spark)
    checkpoints._written[:] = kept
    assert not Folder(spark, path).exists()


def test_every_scratch_folder_is_removed(spark):
    from trialkit.sources import checkpoints

    before = list(checkpoints._written)
    checkpoints._written[:] = []
    store = ResultSet.create(spark, scratch_folder(spark, "rs"))
    checkpoints.discard(spark)
    assert not Folder(spark, store.path).exists() and checkpoints._written == []
    checkpoints._written[:] = before


def test_ranks_with_given_sizes_count_nothing(spark):
    from trialkit.operators.blocks import GroupSizes

    df = spark.createDataFrame([(1, 1, 2, 0.5), (1, 1, 1, 0.7), (1, 2, 1, 0.1)], "c long, t long, i int, rt double")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("ranks with sizes", "ranks")
    ranked = as_results(df, condition="c", trial="t", item="i", rt="rt", sizes=GroupSizes(3, 2))
    started = list(tracker.getJobIdsForGroup("ranks with sizes"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not started
    assert sorted((r.trial_idx, r.item_idx, r.rank_idx) for r in ranked.collect()) == [(1, 1, 2), (1, 2, 1), (2, 1, 1)]


def test_staged_rows_are_not_cut_by_chunks(spark, monkeypatch):
    store = ResultSet.create(spark, scratch_folder(spark, "staged"))
    seen, plain = [], ResultSet._record

    def record(folder, counts):
        (name,) = folder.names("staging")
        seen.extend(n for n in folder.names(f"staging/{name}") if n.startswith("chunk_idx="))
        plain(folder, counts)

    monkeypatch.setattr(ResultSet, "_record", staticmethod(record))
    rows = spark.range(40).select((F.col("id") % 4).cast("int").alias("chunk_idx"), (F.col("id") * 0.5).alias("rt"))
    assert store.commit(rows) == [0, 1, 2, 3] and store.commit(rows) == [] and seen == []
    assert sorted(tuple(r) for r in store.dataset().select("chunk_idx", "rt").collect()) == sorted(tuple(r) for r in rows.collect())
    assert not Folder(spark, store.path).exists("staging")
