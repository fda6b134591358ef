"""Token-id files: documents in id order, as compressed, checksummed blocks of ids.

Documents are range-partitioned by id, so a partition is a run of them; its ids are cut into blocks of whole
documents, each coded on its own (``id_coder``). Spark writes the blocks as rows of a Parquet table, so the
files go wherever Spark can write and a lost task is written again. Reading needs a block only, and gives
the place of a document among all ids from the sizes of the blocks before it: one row per block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialkit.llm.id_coder import decode_block, encode_block
from trialkit.llm.tokens import RUN, read_tokenizer, text_runs, token_ids

#: Ids after which a block is closed; a document is never cut.
BLOCK_IDS = 2_000_000


def write_ids(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    alphabet: int,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = 0,
    pieces: str = "spaces",
    block_ids: int = BLOCK_IDS,
) -> None:
    """Encode all documents and write them in ascending ``doc_id`` order (NULL first) to ``path``.

    A NULL or empty text is its end id alone. Rows with equal ids follow each other, ordered by a hash of
    their text. Other columns are not read. An empty table gives files without rows. Columns: ``part`` and
    ``block``, by which blocks are in order; ``n_ids``; ``doc_ids`` and ``sizes`` of its documents; ``data``.
    """
    chosen = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), docs[f"`{text}`"].alias("text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = chosen.repartitionByRange(*keys).sortWithinPartitions(*keys)
    spec = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))
    kind = chosen.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("block", T.IntegerType()),
            T.StructField("n_ids", T.LongType()),
            T.StructField("doc_ids", T.ArrayType(kind)),
            T.StructField("sizes", T.ArrayType(T.LongType())),
            T.StructField("data", T.BinaryType()),
        ]
    )
    end = np.array([end_id], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_ids(spec.value, pieces, special=True)
        part, block = TaskContext.get().partitionId(), 0
        names: list = []
        found: list[bytes] = []
        waiting = 0
        name_type = None

        def closed() -> pa.RecordBatch:
            nonlocal block, waiting
            ids = np.frombuffer(b"".join(found), "<u4")
            row = [[part], [block], [len(ids)], [names], [[len(x) // 4 for x in found]], [encode_block(ids, alphabet)]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(name_type), pa.list_(pa.int64()), pa.binary()]
            done = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], schema.names)
            names.clear()
            found.clear()
            block, waiting = block + 1, 0
            return done

        for batch in batches:
            name_type = batch.schema.field(0).type
            own, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, run in text_runs(texts, RUN):
                for i, ids in enumerate(tokens.encode(run), first):
                    names.append(own[i])
                    found.append(ids + end)
                    waiting += len(ids) // 4 + 1
                    if waiting >= block_ids:
                        yield closed()
        if found:
            yield closed()

    blocks = ordered.mapInArrow(work, schema)
    # the blocks are compressed already, and nothing but whole columns is read
    blocks.write.option("compression", "uncompressed").parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Read the files back: ``doc_id, start, n_tokens, ids_crc32`` by document, on request its ``ids``.

    A damaged block fails the job.
    """
    blocks = spark.read.parquet(path)
    kind = blocks.schema["doc_ids"].dataType.elementType
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("block", T.IntegerType()),
            T.StructField("doc_id", kind),
            T.StructField("within", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )
    if with_ids:
        schema = schema.add("ids", T.BinaryType())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block, names, sizes, data in zip(*batch.columns, strict=True):
                raw = memoryview(decode_block(data.as_py()).tobytes())
                n = np.array(sizes.as_py(), np.int64)
                ends = np.cumsum(n)
                bodies = [raw[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                rows = len(n)
                columns = [
                    pa.array(np.full(rows, part.as_py(), np.int32)),
                    pa.array(np.full(rows, block.as_py(), np.int32)),
                    names.values,
                    pa.array(ends - n),
                    pa.array(n),
                    pa.array([zlib.crc32(x) for x in bodies], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([x.tobytes() for x in bodies], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    docs = blocks.select("part", "block", "doc_ids", "sizes", "data").mapInArrow(work, schema)
    sizes = blocks.select("part", "block", "n_ids")
    before = lambda by: by.rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)).alias("from"))
    inside = F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("part").orderBy("block"))), F.lit(0))
    starts = sizes.withColumn("inside", inside).join(parts, F.col("part") == F.col("p"))
    starts = starts.select("part", "block", (F.col("from") + F.col("inside")).alias("base"))
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    return docs.join(starts, ["part", "block"]).withColumn("start", F.col("base") + F.col("within")).select(*names)
