"""Trimming and summaries over a stream of result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from trialkit.functions.columns import valid_time
from trialkit.operators.trim import apply_trim


def read_results_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Result files as they arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def trim_stream(stream: DataFrame, thresholds: DataFrame, min_n_used: int = 0) -> DataFrame:
    """Valid rows within the static bounds of their group. Stateless: each batch stands alone."""
    return apply_trim(stream.where(valid_time("rt")), thresholds, min_n_used)


def append_stream(stream: DataFrame, path: str, checkpoint: str, partition: str | None = None) -> StreamingQuery:
    """Write everything available as Parquet, then stop; a restart goes on where it left off."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    if partition is not None:
        writer = writer.partitionBy(partition)
    return writer.trigger(availableNow=True).start(path)


def replace_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep a Parquet table at the newest state of a running summary: each batch replaces it as a whole."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(path)

    writer = stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(write).trigger(availableNow=True).start()
