"""First crossings and races over a stream of steps that may arrive late and out of order.

Steps wait in state until the watermark has passed them; then no earlier one can come, and they are added in the order
of their times. What is given out is final, and the same as over the whole table, however the stream is cut into
micro-batches and wherever it was stopped and started again.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from trialkit.functions.columns import as_column, named, require_columns

# Spark reads the processor in a process of the driver as well, which has none of the files sent to the workers: it
# goes there as it is, not by the name of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The state of this operator needs a store with several state variables for each key.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"




@contextmanager
def state_store(spark: SparkSession):
    """Start queries over :func:`race_stream` in here: the store is part of a query's settings when it starts."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, STORE)
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Microseconds, item, tie, step, upper and lower bound: the last columns of the rows that come to the state.
STEP_FIELDS = 6


class _Race(StatefulProcessor):
    """Running sums of the items of one trial. Times are whole microseconds."""

    def __init__(self, keys: Sequence[str], item: T.DataType, lower: bool, max_us: int | None, max_reached: int | None):
        self.keys, self.item, self.lower = list(keys), item, lower
        self.max_us, self.max_reached = max_us, max_reached

    def init(self, handle) -> None:
        self.handle = handle
        # the steps of a micro-batch are one value: each value costs a call to the store, however small it is
        self.pending = handle.getListState("pending", T.StructType([T.StructField("steps", T.BinaryType())]))
        self.sums = handle.getMapState("sums", T.StructType([T.StructField("item", self.item)]), "total double, done boolean")
        self.reached = handle.getValueState("reached", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for part in rows:
            # by place: the frame does not keep all names
            own = part.iloc[:, -STEP_FIELDS:]
            new += [tuple(None if pd.isna(v) else v for v in r) for r in own.itertuples(index=False, name=None)]
        if new:
            self.pending.appendValue((pickle.dumps([self._plain(r) for r in new]),))
            # once the watermark is beyond the first of them there is something to do
            self.handle.registerTimer(min(r[0] for r in new) // 1000 + 1)
        return iter(())

    @staticmethod
    def _plain(row):
        return tuple(v.item() if hasattr(v, "item") else v for v in row)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        ready, wait = [], []
        for (steps,) in self.pending.get():
            for row in pickle.loads(steps):
                (ready if row[0] < upto else wait).append(row)
        if not ready:
            # another timer of this trial came first; the first step that waits has one of its own
            return
        if wait:
            self.pending.put([(pickle.dumps(wait),)])
            self.handle.registerTimer(min(r[0] for r in wait) // 1000 + 1)
        else:
            self.pending.clear()
        found = self._crossings(sorted(ready, key=lambda r: (r[0], r[2], str(r[1]))))
        out = pd.DataFrame(found, columns=["item", "us", "choice", "rank"])
        for i, name in enumerate(self.keys):
            out.insert(i, name, [key[i]] * len(found))
        if len(out):
            yield out

    def _crossings(self, steps: list[tuple]) -> list[tuple]:
        sums: dict = {}
        hits: list[tuple] = []
        for us, item, _, step, high, low in steps:
            if item not in sums:
                held = self.sums.getValue((item,)) or (0.0, False)
                sums[item] = [held[0], held[1]]
            total = sums[item]
            if total[1] or step is None:
                continue
            total[0] += step
            up, down = high is not None and total[0] >= high, low is not None and total[0] <= low
            if up or down:
                total[1] = True
                if self.max_us is None or us < self.max_us:
                    hits.append((us, item, 1 if up else -1))
        for item, (total, done) in sums.items():
            self.sums.updateValue((item,), (total, done))
        n = self.reached.get()[0] if self.reached.exists() else 0
        out = []
        for us, item, choice in sorted(hits):
            n += 1
            if self.max_reached is None or n <= self.max_reached:
                out.append((item, us, choice, n))
        if hits:
            self.reached.update((n,))
        return out

    def close(self) -> None:
        pass


def race_stream(
    steps: DataFrame,
    *,
    trial: Sequence[str],
    item: str,
    time: str,
    step: Column | str,
    upper: Column | float,
    lower: Column | float | None = None,
    order: str | None = None,
    max_time: int | None = None,
    max_reached: int | None = None,
    late: str = "0 seconds",
) -> DataFrame:
    """Per trial and item of a stream, the first time its running sum reaches a bound, ranked within the trial.

    Gives ``trial``, ``item``, ``t`` (microseconds since 1970), ``choice`` (+1 for ``upper``, −1 for ``lower``, the
    upper one winning) and ``rank_idx`` by time, then item. ``time`` is a timestamp; ``order``, an integer, tells
    steps at one time apart. A step may be ``late`` against the newest one of the whole stream: it is put in its
    place; what is later still is dropped. A crossing is given out once the watermark has passed it. One at or after
    ``max_time`` (microseconds) did not happen; only the first ``max_reached`` of a trial are given.

    Sums are doubles and take the steps of an item in their order, so they are those of the whole table. State is what
    waits for the watermark, and one sum per item. Needs the state store :data:`STORE`.
    """
    require_columns(steps, [*trial, item, time, *([order] if order else [])])
    bound = lambda b: F.lit(b) if not isinstance(b, Column) else b
    none = F.lit(None).cast("double")
    rows = steps.select(
        *[named(c) for c in trial],
        named(time).alias("__time"),
        F.unix_micros(named(time)).alias("__us"),
        named(item).alias("__item"),
        (named(order).cast("bigint") if order else F.lit(0).cast("bigint")).alias("__tie"),
        as_column(step).cast("double").alias("__step"),
        bound(upper).cast("double").alias("__high"),
        (none if lower is None else bound(lower).cast("double")).alias("__low"),
    ).withWatermark("__time", late)
    kinds = [steps.schema[c] for c in trial]
    schema = T.StructType(
        [
            *[T.StructField(f.name, f.dataType) for f in kinds],
            T.StructField("item", steps.schema[item].dataType),
            T.StructField("us", T.LongType()),
            T.StructField("choice", T.IntegerType()),
            T.StructField("rank", T.IntegerType()),
        ]
    )
    race = _Race(list(trial), steps.schema[item].dataType, lower is not None, max_time, max_reached)
    found = rows.groupBy(*[named(c) for c in trial]).transformWithStateInPandas(
        statefulProcessor=race, outputStructType=schema, outputMode="append", timeMode="EventTime"
    )
    return found.withColumnsRenamed({"item": item, "us": "t", "rank": "rank_idx"})
