"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialkit.sources.checkpoints import scratch_folder

#: Bytes of text that the array code inside a task works on at once.
CHUNK_BYTES = 2_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as Parquet to the shared folder and read on from there.

    Later steps then see fixed rows, whatever executors are lost, and read only the columns they use. The
    compression is one that works in heap memory: buffers outside it stay until the JVM clears its heap.
    """
    path = scratch_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def forget(*tables: DataFrame | None) -> None:
    """Remove stored tables from which everything that follows has been stored in turn."""
    for table in tables:
        if table is not None:
            spark = table.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have yet, whatever its case rule."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where lambdas inside use it many times."""
    return F.transform(F.array(value), body)[0]


def total(values: Column, kind: str = "bigint") -> Column:
    """Sum of an array's elements; 0 if it is empty."""
    return F.aggregate(values, F.lit(0).cast(kind), lambda acc, x: acc + x.cast(kind))


def text_chunks(texts: pa.Array, limit: int = CHUNK_BYTES):
    """Cut a column of texts into runs of about ``limit`` bytes.

    Yields the first row, the UTF-8 bytes of the run and the offsets of its texts. NULL is an empty text.
    A text longer than the limit is a run of its own.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def numbered(rows: DataFrame, order: list[str], out: str, name: str) -> DataFrame:
    """Number all rows 0, 1, … by ``order``, which should be free of ties, without gathering them.

    The rows are range-partitioned, numbered within their partition, and shifted by the counts of the
    partitions before it: one row per partition. The rows are written once, so the numbers are fixed.
    """
    place, part = fresh(rows, "place", "part")
    shift = 33  # monotonically_increasing_id keeps the partition above this bit, the position below it
    keys = [F.col(f"`{c}`") for c in order]
    spread = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stored(spread.withColumn(place, F.monotonically_increasing_id()), name)
    placed = placed.withColumn(part, F.shiftright(place, shift))
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    joined = placed.join(starts.withColumnRenamed("start", out), part)
    within = F.col(place).bitwiseAND(F.lit((1 << shift) - 1))
    return joined.withColumn(out, F.col(out) + within).drop(place, part)
