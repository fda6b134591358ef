"""The long result table: one row per recorded response, kept as partitioned Parquet."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialkit.functions.columns import as_column, is_missing, named, require_columns
from trialkit.operators.blocks import GroupSizes, row_numbers

MANIFEST = "manifest.json"
DATASET = "dataset"
CONDITIONS = "conditions"
CHUNK = "chunk_idx"
CONDITION = "condition_idx"
#: Numbered files, each with the rows of the chunks that one commit published.
COMMITS = "commits"
STAGING = "staging"
#: Per chunk of conditions, the least and the greatest value of each parameter.
RANGES = "ranges"


def chunk_column(conditions_per_chunk: int, condition: Column | str = "condition_idx") -> Column:
    """Chunk of a 1-based condition number."""
    return F.ceil(as_column(condition) / F.lit(conditions_per_chunk)).cast("int")


def as_results(
    df: DataFrame,
    *,
    condition: Column | str,
    trial: Column | str,
    item: Column | str,
    rt: Column | str,
    rank: Column | str | None = None,
    choice: Column | str | None = None,
    model: str | None = None,
    params: Mapping[str, Column | str] | None = None,
    tie_break: Sequence[Column | str] = (),
    block_rows: int | None = None,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Observed data in the shape of a result table.

    Without ``rank`` the responses of a trial are ranked by time, then item, then ``tie_break``; these
    together must tell the rows of a trial apart. ``sizes`` of the trials saves counting them.
    """
    for name in (condition, trial, item, rt, rank, choice, *(params or {}).values()):
        if isinstance(name, str):
            require_columns(df, [name])
    columns = [
        as_column(condition).cast("bigint").alias("condition_idx"),
        as_column(trial).cast("bigint").alias("trial_idx"),
        as_column(item).cast("int").alias("item_idx"),
        as_column(rt).cast("double").alias("rt"),
    ]
    if model is not None:
        columns.append(F.lit(model).alias("model"))
    if choice is not None:
        columns.append(as_column(choice).cast("int").alias("choice"))
    columns += [as_column(c).alias(n) for n, c in (params or {}).items()]
    if rank is not None:
        return df.select(*columns, as_column(rank).cast("int").alias("rank_idx"))
    ties = [as_column(c).alias(f"__tie{i}") for i, c in enumerate(tie_break)]
    wide = df.select(*columns, *ties)
    order = ["rt", "item_idx", *[f"__tie{i}" for i in range(len(ties))]]
    ranked = row_numbers(wide, ["condition_idx", "trial_idx"], order, "rank_idx", block_rows, sizes)
    return ranked.withColumn("rank_idx", F.col("rank_idx").cast("int")).drop(*[f"__tie{i}" for i in range(len(ties))])


class Folder:
    """A folder on whatever file system its address names."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.path = path

    def child(self, name: str) -> str:
        return f"{self.path.rstrip('/')}/{name}"

    def _at(self, name: str | None):
        return self._path if name is None else self._jvm.org.apache.hadoop.fs.Path(self._path, name)

    def exists(self, name: str | None = None) -> bool:
        return self._fs.exists(self._at(name))

    def is_empty(self) -> bool:
        return len(self._fs.listStatus(self._path)) == 0

    def names(self, name: str) -> list[str]:
        if not self.exists(name):
            return []
        return sorted(status.getPath().getName() for status in self._fs.listStatus(self._at(name)))

    def move(self, name: str, to: str) -> bool:
        """False if ``to`` is taken."""
        return not self.exists(to) and self._fs.rename(self._at(name), self._at(to))

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def make(self, name: str) -> None:
        self._fs.mkdirs(self._at(name))

    def write_text(self, name: str, text: str) -> None:
        out = self._fs.create(self._at(name), True)
        try:
            out.write(bytearray(text, "utf-8"))
        finally:
            out.close()

    def read_text(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()


@dataclass(frozen=True)
class ResultSet:
    """A folder with the result table, the condition parameters and a manifest.

    The manifest is written last: a folder without one is an unfinished run, which :meth:`resume` opens again.
    Whole chunks go in by :meth:`commit`, which may be called again after any failure: what was published is
    recorded, and what was not recorded is replaced. :meth:`append` adds rows as they are, each time it is called.
    """

    spark: SparkSession
    path: str
    settings: Mapping[str, object] = field(default_factory=dict)

    @classmethod
    def create(cls, spark: SparkSession, path: str, settings: Mapping[str, object] | None = None) -> ResultSet:
        folder = Folder(spark, path)
        if folder.exists() and not folder.is_empty():
            raise FileExistsError(f"result folder must be empty: {path}")
        folder.make(CONDITIONS)
        folder.make(DATASET)
        return cls(spark, path, dict(settings or {}))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ResultSet:
        folder = Folder(spark, path)
        if not folder.exists():
            raise FileNotFoundError(f"result folder does not exist: {path}")
        if not folder.exists(MANIFEST):
            raise FileNotFoundError(f"no manifest in {path}: the run that wrote it did not finish")
        if not folder.exists(DATASET):
            raise FileNotFoundError(f"no result table in {path}: the folder is incomplete")
        manifest = json.loads(folder.read_text(MANIFEST))
        if not isinstance(manifest, dict) or manifest.get("kind") != "result set":
            raise ValueError(f"not a result manifest: {folder.child(MANIFEST)}")
        return cls(spark, path, manifest.get("settings", {}))

    @classmethod
    def resume(cls, spark: SparkSession, path: str, settings: Mapping[str, object] | None = None) -> ResultSet:
        """An unfinished run, to go on with its missing chunks."""
        folder = Folder(spark, path)
        if not folder.exists(DATASET):
            raise FileNotFoundError(f"no result table in {path}: nothing to resume")
        if folder.exists(MANIFEST):
            raise FileExistsError(f"the run in {path} is finished")
        return cls(spark, path, dict(settings or {}))

    def committed(self) -> dict[int, int]:
        """Rows of each chunk that is published and recorded."""
        folder = Folder(self.spark, self.path)
        out: dict[int, int] = {}
        for name in folder.names(COMMITS):
            if name.endswith(".json"):
                out.update({int(k): n for k, n in json.loads(folder.read_text(f"{COMMITS}/{name}")).items()})
        return out

    def missing(self, rows: DataFrame) -> DataFrame:
        """The rows whose chunks are not committed yet."""
        require_columns(rows, [CHUNK])
        done = self.committed()
        if not done:
            return rows
        known = self.spark.createDataFrame([(k,) for k in done], f"{CHUNK} int")
        return rows.join(known, CHUNK, "left_anti").select(*[named(c) for c in rows.columns])

    def commit(self, rows: DataFrame) -> list[int]:
        """Publish whole chunks, each once: the chunks of ``rows`` that are not committed yet. Gives their numbers.

        The rows are computed once, into a staging folder. From there they replace what a stopped run may have
        left of these chunks; then the chunks are recorded with their counts, in one file that appears as a whole.
        Stopped at any point, the same call again gives every row once. One writer at a time.
        """
        folder = Folder(self.spark, self.path)
        folder.remove(STAGING)  # of a run that was stopped
        staged = f"{STAGING}/{uuid.uuid4().hex}"
        require_columns(rows, [CHUNK])
        # plain files: the rows are cut by chunks once, on their way into the table
        self.missing(rows).write.parquet(folder.child(staged))
        fresh = self.spark.read.schema(rows.schema).parquet(folder.child(staged))
        counts = {r[CHUNK]: r["n"] for r in fresh.groupBy(CHUNK).agg(F.count(F.lit(1)).alias("n")).collect()}
        if not counts:
            folder.remove(STAGING)
            return []
        if None in counts:
            raise ValueError(f"rows without {CHUNK}")
        out = fresh.hint("rebalance", named(CHUNK)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy(CHUNK).parquet(folder.child(DATASET))
        self._record(folder, counts)
        folder.remove(STAGING)
        return sorted(counts)

    @staticmethod
    def _record(folder: Folder, counts: Mapping[int, int]) -> None:
        # the name ends in .json only once the file is complete
        draft = f"{COMMITS}/{uuid.uuid4().hex}.draft"
        folder.write_text(draft, json.dumps({str(k): n for k, n in sorted(counts.items())}))
        taken = [n for n in folder.names(COMMITS) if n.endswith(".json")]
        if not folder.move(draft, f"{COMMITS}/{len(taken):08d}.json"):
            raise FileExistsError(f"another writer commits to {folder.path}")

    def _write(self, df: DataFrame, name: str) -> None:
        require_columns(df, [CHUNK])
        # Rebalancing gathers a chunk into few files and splits a chunk that is too big for one task.
        balanced = df.hint("rebalance", named(CHUNK))
        balanced.write.mode("append").partitionBy(CHUNK).parquet(Folder(self.spark, self.path).child(name))

    def append(self, rows: DataFrame) -> None:
        self._write(rows, DATASET)

    def write_conditions(self, conditions: DataFrame) -> None:
        self._write(conditions, CONDITIONS)

    def finish(self) -> ResultSet:
        """Write the ranges of the parameters and, last, the manifest.

        Where chunks were committed, the table must hold just these, with their counts.
        """
        folder = Folder(self.spark, self.path)
        done = self.committed()
        if done:
            rows = self.dataset().groupBy(CHUNK).agg(F.count(F.lit(1)).alias("n")).collect()
            found = {r[CHUNK]: r["n"] for r in rows}
            if found != done:
                wrong = sorted(k for k in {*found, *done} if found.get(k) != done.get(k))
                raise ValueError(f"chunks {wrong[:10]} are not as committed")
        if any(name.startswith(f"{CHUNK}=") for name in folder.names(CONDITIONS)):
            self._write_ranges(folder)
        manifest = {"kind": "result set", "settings": dict(self.settings)}
        if done:
            manifest["chunks"] = {str(k): n for k, n in sorted(done.items())}
        folder.write_text(MANIFEST, json.dumps(manifest, sort_keys=True))
        return self

    def _write_ranges(self, folder: Folder) -> None:
        conditions = self.conditions()
        kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
        ends = []
        for name, kind in conditions.dtypes:
            if name != CHUNK and (kind in kinds or kind.startswith("decimal")):
                # a missing value lies in no bounds, so it widens no range
                value = F.when(~is_missing(named(name)), named(name))
                ends.append(F.struct(F.min(value).alias("low"), F.max(value).alias("high")).alias(name))
        if ends:
            # one row per chunk
            conditions.groupBy(CHUNK).agg(*ends).coalesce(1).write.mode("overwrite").parquet(folder.child(RANGES))

    def where_parameters(self, bounds: Mapping[str, tuple[object, object]]) -> DataFrame:
        """Rows of the conditions whose parameters lie within ``bounds``, ends included; None leaves an end open.

        The ranges tell which chunks can hold such conditions; only the folders of these are read, from the
        conditions and from the results. A missing parameter lies in no bounds.
        """
        folder = Folder(self.spark, self.path)
        conditions = self.conditions()
        require_columns(conditions, [CONDITION, *bounds])
        wanted, possible = [], []
        ranged = self.spark.read.parquet(folder.child(RANGES)) if folder.exists(RANGES) else None
        for name, (low, high) in bounds.items():
            wanted.append(~is_missing(named(name).cast("double")))
            if ranged is not None and name in ranged.columns:
                possible.append(named(name)["low"].isNotNull())
            if low is not None:
                wanted.append(named(name) >= F.lit(low))
                possible.append(named(name)["high"] >= F.lit(low))
            if high is not None:
                wanted.append(named(name) <= F.lit(high))
                possible.append(named(name)["low"] <= F.lit(high))
        picked, rows = conditions, self.dataset()
        if ranged is not None and possible and set(bounds) <= set(ranged.columns):
            chunks = ranged.where(reduce(lambda a, b: a & b, possible)).select(CHUNK)
            picked, rows = (df.join(chunks, CHUNK, "left_semi") for df in (picked, rows))
        if wanted:
            picked = picked.where(reduce(lambda a, b: a & b, wanted))
        out = rows.join(picked.select(CHUNK, CONDITION), [CHUNK, CONDITION], "left_semi")
        return out.select(*[named(c) for c in self.dataset().columns])

    def dataset(self) -> DataFrame:
        return self.spark.read.parquet(Folder(self.spark, self.path).child(DATASET))

    def conditions(self) -> DataFrame:
        return self.spark.read.parquet(Folder(self.spark, self.path).child(CONDITIONS))

    def chunk(self, number: int) -> DataFrame:
        """One chunk; the filter prunes the scan to its folder."""
        return self.dataset().where(F.col(CHUNK) == number)

    def chunks(self) -> DataFrame:
        """Chunk numbers in order; a query on the partition column alone reads no data pages."""
        return self.dataset().select(CHUNK).distinct().orderBy(CHUNK)


def dense_codes(df: DataFrame, column: str, out: str) -> DataFrame:
    """Number the distinct values 1, 2, … in order and join the numbers back; NULL has no code."""
    values = df.where(named(column).isNotNull()).select(named(column).alias("__value")).distinct()
    coded = row_numbers(values, [], ["__value"], out)
    return df.join(coded, named(column) == F.col("__value"), "left").drop("__value")
