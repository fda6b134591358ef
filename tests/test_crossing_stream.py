import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from trialkit.operators.crossing import first_crossing, race
from trialkit.sources.checkpoints import scratch_folder
from trialkit.streaming.crossing import race_stream, state_store
from trialkit.streaming.trim import append_stream, read_results_stream

SCHEMA = "trial long, item string, at timestamp, no long, step double"
START = dt.datetime(2024, 1, 1)


def steps(seed, n=300):
    """Steps of a few trials, in the order of their times; some times are shared."""
    rng = random.Random(seed)
    times = sorted(rng.randrange(0, 4000) / 2 for _ in range(n))
    return [
        (rng.choice([1, 2, None]), rng.choice("abc"), START + dt.timedelta(seconds=t), k, rng.choice([1.0, 2.0, -1.0, None]))
        for k, t in enumerate(times)
    ]


def put(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, late):
    return race_stream(
        read_results_stream(spark, path, spark.createDataFrame([], SCHEMA).schema, files_per_batch=1),
        trial=["trial"], item="item", time="at", step="step", order="no", upper=6, lower=-3, late=late, max_reached=2,
    )


def run(spark, path, out, log, late="60 seconds"):
    with state_store(spark):
        query = append_stream(stream(spark, path, late), out, log)
        query.awaitTermination()
    return query


def found(rows):
    return sorted(((r.trial, r["item"], r.t, r.choice, r.rank_idx) for r in rows), key=str)


def batch(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("us", F.unix_micros("at")).fillna({"step": 0.0})
    hits = first_crossing(df, series=["trial", "item"], time="us", order=["no"], step="step", upper=6, lower=-3)
    return found(race(hits, trial=["trial"], item="item", max_reached=2).collect())


CLOSE = [(99, "a", START + dt.timedelta(days=9), 0, 0.0)]


def test_late_rows_and_a_restart_give_the_batch_result(spark):
    rows = steps(1)
    rng = random.Random(2)
    # up to 50 seconds late
    arrival = sorted(rows, key=lambda r: r[2] + dt.timedelta(seconds=rng.random() * 50))
    path, out, log = (scratch_folder(spark, n) for n in ("in", "out", "log"))
    put(spark, path, arrival[:80])
    put(spark, path, arrival[80:150])
    first = run(spark, path, out, log)
    assert len([p for p in first.recentProgress if p["numInputRows"]]) == 2
    some = found(spark.read.parquet(out).collect())
    put(spark, path, arrival[150:260])
    put(spark, path, arrival[260:])
    put(spark, path, CLOSE)
    run(spark, path, out, log)
    everything = found(spark.read.parquet(out).collect())
    # what was given out first was final
    assert set(some) <= set(everything)
    assert everything == batch(spark, rows) and len(everything) >= 4


@pytest.mark.parametrize("late", ["0 seconds", "10 seconds"])
def test_what_is_too_late_is_dropped(spark, late):
    path, out, log = (scratch_folder(spark, n) for n in ("in", "out", "log"))
    at = lambda s: START + dt.timedelta(seconds=s)
    put(spark, path, [(1, "a", at(0), 0, 5.0), (1, "a", at(100), 1, 0.0)])
    put(spark, path, [(2, "a", at(100), 2, 0.0)])
    put(spark, path, [(1, "a", at(95), 3, 1.0)])
    put(spark, path, CLOSE)
    run(spark, path, out, log, late)
    # five seconds late: in its place with ten seconds' grace, gone without
    assert len(found(spark.read.schema(stream(spark, path, late).schema).parquet(out).collect())) == (1 if late == "10 seconds" else 0)


class Value:
    """A state variable that counts what is written to it."""

    def __init__(self):
        self.held, self.writes = [], 0

    def appendValue(self, row):
        self.held.append(row)
        self.writes += 1

    def put(self, rows):
        self.held = list(rows)
        self.writes += 1

    def get(self):
        return iter(self.held)

    def clear(self):
        self.held = []


def test_steps_of_a_batch_are_one_value_of_the_state():
    from types import SimpleNamespace as Space

    import pandas as pd
    from pyspark.sql import types as T

    from trialkit.streaming.crossing import _Race

    race, timers, sums = _Race(["trial"], T.StringType(), True, None, None), [], {}
    race.handle, race.pending = Space(registerTimer=timers.append), Value()
    race.sums = Space(getValue=sums.get, updateValue=lambda k, v: sums.update({k: v}), containsKey=lambda k: k in sums)
    race.reached = Space(exists=lambda: False, update=lambda row: None)
    names = ["trial", "us", "item", "tie", "step", "high", "low"]
    rows = pd.DataFrame([(1, 1000 * k, "a", k, 1.0, 30.0, None) for k in range(50)], columns=names)
    assert list(race.handleInputRows((1,), iter([rows[:25], rows[25:]]), None)) == []
    assert race.pending.writes == 1 and timers == [1]
    at = Space(getCurrentWatermarkInMs=lambda: 40)
    (found,) = race.handleExpiredTimer((1,), at, None)
    assert found.values.tolist() == [[1, "a", 29_000, 1, 1]]
    assert race.pending.writes == 2 and timers == [1, 41] and sums[("a",)] == (30.0, True)
    # a second timer of the same watermark finds nothing to do
    assert list(race.handleExpiredTimer((1,), at, None)) == []
    assert race.pending.writes == 2 and timers == [1, 41]
