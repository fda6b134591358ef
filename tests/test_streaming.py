import pytest
from pyspark.sql import functions as F

from trialkit.functions import stats as S
from trialkit.operators.summarise import summarise
from trialkit.operators.trim import apply_trim, trim_thresholds
from trialkit.sources.checkpoints import scratch_folder
from trialkit.sources.results import Folder
from trialkit.streaming.summary import KeyedTable, keep_summary
from trialkit.streaming.trim import append_stream, read_results_stream, trim_stream


def test_stream_equals_batch(spark):
    rows = spark.range(600).select(
        (F.col("id") % 5).alias("condition_idx"),
        F.lit(1).alias("rank_idx"),
        F.when(F.col("id") % 50 == 0, F.lit(float("nan"))).otherwise(F.exp(F.sin("id"))).alias("rt"),
    )
    source, out, log = (scratch_folder(spark, n) for n in ("in", "out", "log"))
    rows.repartition(6).write.parquet(source)
    bounds = trim_thresholds(rows)
    stream = read_results_stream(spark, source, rows.schema, files_per_batch=2)
    append_stream(trim_stream(stream, bounds), out, log).awaitTermination()
    got = spark.read.parquet(out)
    want = apply_trim(rows.where(~F.isnan("rt")), bounds)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # nothing new to read: a restart adds no rows
    append_stream(trim_stream(read_results_stream(spark, source, rows.schema), bounds), out, log).awaitTermination()
    assert spark.read.parquet(out).count() == want.count()


def test_running_summary(spark):
    source = scratch_folder(spark, "in")
    rows = spark.range(100).select((F.col("id") % 3).alias("condition_idx"), (F.col("id") * 1.0).alias("rt"))
    rows.repartition(4).write.parquet(source)
    stream = read_results_stream(spark, source, rows.schema, 1)
    summary = summarise(m=S.mean("rt"), s=S.sd("rt"))(stream).df
    query = summary.writeStream.outputMode("complete").format("memory").queryName("running").start()
    query.processAllAvailable()
    query.stop()
    got = {r.condition_idx: (r.m, round(r.s, 9)) for r in spark.table("running").collect()}
    want = rows.groupBy("condition_idx").agg(F.avg("rt").alias("m"), F.stddev_samp("rt").alias("s"))
    assert got == {r.condition_idx: (r.m, round(r.s, 9)) for r in want.collect()}


def files(spark, n):
    """A folder of ``n`` files, and their rows."""
    path = scratch_folder(spark, "in")
    for k in range(n):
        rows = [(i % 7 if i % 5 else None, float(i * (k + 1))) for i in range(k, 40 + k)]
        spark.createDataFrame(rows, "k long, v double").coalesce(1).write.mode("append").parquet(path)
    return path


def kept(spark, path, out, log, buckets=4):
    stream = read_results_stream(spark, path, "k long, v double", files_per_batch=1)
    table = stream.groupBy("k").agg(F.count("v").alias("n"), F.sum("v").alias("total"))
    return keep_summary(table, ["k"], out, log, buckets)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def whole(spark, path):
    return rows_of(spark.read.parquet(path).groupBy("k").agg(F.count("v").alias("n"), F.sum("v").alias("total")))


def test_kept_summary_over_several_batches_and_a_restart(spark):
    path = files(spark, 3)
    out, log = scratch_folder(spark, "out"), scratch_folder(spark, "log")
    query = kept(spark, path, out, log)
    query.awaitTermination()
    table = KeyedTable(spark, out, ["k"])
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 3 and table.version == 2
    assert rows_of(table.read()) == whole(spark, path)
    old = table.read()
    spark.createDataFrame([(3, 1000.0)], "k long, v double").write.mode("append").parquet(path)
    before = rows_of(old)
    kept(spark, path, out, log).awaitTermination()
    # a reader that began before sees its version, a new one the next
    assert rows_of(old) == before != whole(spark, path)
    assert rows_of(KeyedTable(spark, out, ["k"]).read()) == whole(spark, path)


def test_only_touched_buckets_are_written(spark):
    table = KeyedTable(spark, scratch_folder(spark, "table"), ["k"], buckets=8)
    rows = spark.range(50).select(F.col("id").alias("k"), F.lit(0).alias("v"))
    assert table.upsert(rows, 0)
    one = spark.createDataFrame([(7, 1)], "k long, v int")
    assert table.upsert(one, 1)
    assert len([n for n in Folder(spark, table.path).names("data/1") if n.startswith("__bucket=")]) == 1
    assert {r.k: r.v for r in table.read().collect()} == {k: int(k == 7) for k in range(50)}
    # played again it changes nothing, and an empty batch is a version as well
    assert not table.upsert(one.withColumn("v", F.lit(9)), 1)
    assert table.upsert(one.limit(0), 2) and table.version == 2
    assert {r.k: r.v for r in table.read().collect()} == {k: int(k == 7) for k in range(50)}


def test_a_batch_that_stopped_is_played_again(spark, monkeypatch):
    table = KeyedTable(spark, scratch_folder(spark, "table"), ["a", "b"], buckets=3)
    first = spark.createDataFrame([("x", None, 1), (None, None, 2), ("y", 5, 3)], "a string, b int, v int")
    table.upsert(first, 0)
    second = spark.createDataFrame([("x", None, 10), ("z", None, 4)], "a string, b int, v int")
    with monkeypatch.context() as patch:
        patch.setattr(KeyedTable, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError, match="stopped"):
            table.upsert(second, 1)
    assert rows_of(table.read()) == rows_of(first)
    assert table.upsert(second, 1)
    assert sorted(r.v for r in table.read().collect()) == [2, 3, 4, 10]
    for batch in range(2, 9):
        table.upsert(second.withColumn("v", F.lit(batch)), batch)
    folder = Folder(spark, table.path)
    # only what the newest versions name is kept
    assert len([n for n in folder.names("versions") if n.endswith(".json")]) == 3
    assert len(folder.names("data")) <= 4
    assert sorted(r.v for r in table.read().collect()) == [2, 3, 8, 8]


def test_no_version_yet(spark):
    with pytest.raises(FileNotFoundError, match="no version"):
        KeyedTable(spark, scratch_folder(spark, "none"), ["k"]).read()


def test_streamed_files_grow_in_number_with_the_rows(spark, tmp_path, monkeypatch):
    from trialkit.plans import queries

    lines = spark.range(400).select(
        (F.col("id") % 150).alias("l_orderkey"), (F.col("id") % 9).alias("l_suppkey"),
        (F.col("id") % 7 + 1).cast("int").alias("l_linenumber"), (F.col("id") * 1.5).alias("l_extendedprice"),
    )
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    files = []
    plain = queries.read_results_stream

    def read(spark, path, schema, files_per_batch):
        files.append((len(spark.read.schema(schema).parquet(path).inputFiles()), files_per_batch))
        return plain(spark, path, schema, files_per_batch)

    monkeypatch.setattr(queries, "read_results_stream", read)
    before = sorted(queries.summary_kept(spark, str(tmp_path)).collect())
    monkeypatch.setattr(queries, "STREAM_FILE_ROWS", 40)
    after = sorted(queries.summary_kept(spark, str(tmp_path)).collect())
    assert files == [(4, 1), (12, 3)] and before == after and len(after) == 63
