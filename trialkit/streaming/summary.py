"""A table of running summaries that changes only where a micro-batch changed it.

Groups live in buckets by the hash of their key. A batch rewrites the buckets of the groups it changed, into a folder
of its own number, and then publishes a new list of the folders that make up the table, as one file that appears as
a whole. A reader follows one list and sees one version; a batch that is played again finds its list and does nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from trialkit.functions.columns import named, require_columns
from trialkit.operators.joins import join_on_keys
from trialkit.sources.results import Folder

LISTS = "versions"
DATA = "data"
BUCKET = "__bucket"
#: Buckets of a table; fixed when its first version is written.
BUCKETS = 64
#: Lists whose files are kept, for readers that still follow them.
KEPT = 3


class KeyedTable:
    """A table with one row per key, in versions."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = BUCKETS, kept: int = KEPT):
        if kept < 1:
            raise ValueError("at least the newest version must be kept")
        self.spark, self.path, self.keys, self.kept = spark, path, list(keys), kept
        self._folder = Folder(spark, path)
        newest = self._newest()
        self.buckets = newest["buckets"] if newest else buckets

    def _versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._folder.names(LISTS) if n.endswith(".json"))

    def _list(self, version: int) -> dict:
        return json.loads(self._folder.read_text(f"{LISTS}/{version}.json"))

    def _newest(self) -> dict | None:
        versions = self._versions()
        return self._list(versions[-1]) if versions else None

    @property
    def version(self) -> int | None:
        """Number of the newest batch that is published."""
        versions = self._versions()
        return versions[-1] if versions else None

    def _rows(self, found: dict, only: set[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(found["schema"])
        paths = [
            self._folder.child(f"{DATA}/{version}/{BUCKET}={bucket}")
            for bucket, version in found["places"].items()
            if only is None or bucket in only
        ]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """The newest version; it stays as it is while later ones are written."""
        found = self._newest()
        if found is None:
            raise FileNotFoundError(f"no version of the table in {self.path}")
        return self._rows(found)

    def upsert(self, changed: DataFrame, batch: int) -> bool:
        """Replace the rows of the keys in ``changed``, once per ``batch``; False if that is published already.

        Batches come in order. ``changed`` has one row per key; NULL keys match each other.
        """
        require_columns(changed, self.keys)
        newest = self._newest()
        if newest is not None and batch <= newest["batch"]:
            return False
        place = F.pmod(F.xxhash64(*[named(k) for k in self.keys]), F.lit(self.buckets)).cast("int")
        # a batch is read twice: for its buckets, and to be written
        changed = changed.persist()
        try:
            touched = {str(r[0]) for r in changed.select(place).distinct().collect()}
            places = dict(newest["places"]) if newest else {}
            after = changed
            old = touched & set(places)
            if old:
                before = self._rows(newest, old)
                mark = changed.select(*[named(k) for k in self.keys], F.lit(True).alias("__new"))
                kept = join_on_keys(before, mark, self.keys, "left").where(F.col("__new").isNull()).drop("__new")
                after = kept.unionByName(changed)
            out = after.withColumn(BUCKET, place).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET)
            out.parquet(self._folder.child(f"{DATA}/{batch}"))
        finally:
            changed.unpersist()
        places.update({bucket: batch for bucket in touched})
        found = {"batch": batch, "buckets": self.buckets, "places": places, "schema": json.loads(changed.schema.json())}
        self._publish(batch, found)
        self._clean()
        return True

    def _publish(self, batch: int, found: dict) -> None:
        draft = f"{LISTS}/{uuid.uuid4().hex}.draft"
        self._folder.write_text(draft, json.dumps(found))
        if not self._folder.move(draft, f"{LISTS}/{batch}.json"):
            raise FileExistsError(f"another writer published batch {batch} of {self.path}")

    def _clean(self) -> None:
        """Remove lists beyond the newest few, and folders that none of these names."""
        versions = self._versions()
        for version in versions[: -self.kept]:
            self._folder.remove(f"{LISTS}/{version}.json")
        used = {str(v) for version in versions[-self.kept :] for v in self._list(version)["places"].values()}
        for name in self._folder.names(DATA):
            if name not in used:
                self._folder.remove(f"{DATA}/{name}")


def keep_summary(
    stream: DataFrame, keys: Sequence[str], path: str, checkpoint: str, buckets: int = BUCKETS
) -> StreamingQuery:
    """Keep a table at the newest state of a running summary, by what each micro-batch changed.

    Takes everything available, then stops; a restart goes on where it left off. :class:`KeyedTable` reads it.
    """
    spark, names = stream.sparkSession, list(keys)

    def write(rows: DataFrame, batch: int) -> None:
        KeyedTable(spark, path, names, buckets).upsert(rows, batch)

    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(write).trigger(availableNow=True).start()
