"""Summaries of a result set that grows by chunks, from stored states that merge.

For every chunk and group a row of moments is kept (counts, means, sums of squares and products about the mean, ends)
and, for quantiles, the counted values. A summary merges these rows and reads no result; a new chunk is read once,
by itself.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialkit.functions import stats as S
from trialkit.functions.columns import named, require_columns
from trialkit.operators.blocks import GroupSizes, running_sums
from trialkit.operators.joins import join_on_keys
from trialkit.operators.selection import quantile_ranks
from trialkit.operators.summarise import SummaryTable
from trialkit.sources.checkpoints import materialise
from trialkit.sources.results import CHUNK, Folder, ResultSet

MOMENTS = "moments"
VALUES = "values"


@dataclass(frozen=True)
class SummaryStates:
    """States of a summary ``by`` groups, in a folder of their own.

    ``moments`` are columns to give ``<c>_mean``, ``<c>_sd``, ``<c>_min`` and ``<c>_max`` of; ``lines`` name pairs
    (y, x) to fit y ~ x to; ``quantiles`` are probabilities per column. Missing values (NULL, NaN) are skipped, as in
    :func:`~trialkit.operators.summarise.summarise`. The counted values of a group are at most its rows, and far
    fewer where values repeat.
    """

    spark: SparkSession
    path: str
    by: tuple[str, ...]
    moments: tuple[str, ...] = ()
    lines: Mapping[str, tuple[str, str]] | None = None
    quantiles: Mapping[str, Sequence[float]] | None = None

    def _at(self, name: str) -> str:
        return Folder(self.spark, self.path).child(name)

    def chunks(self) -> set[int]:
        """Chunks whose states are complete; the moments are written last."""
        names = Folder(self.spark, self.path).names(MOMENTS)
        return {int(n.removeprefix(f"{CHUNK}=")) for n in names if n.startswith(f"{CHUNK}=")}

    def add(self, rows: DataFrame) -> None:
        """Store the states of whole chunks; those of a chunk that is there already are replaced."""
        lines, quantiles = dict(self.lines or {}), dict(self.quantiles or {})
        require_columns(rows, [CHUNK, *self.by, *self.moments, *quantiles, *[c for pair in lines.values() for c in pair]])
        group = [named(c) for c in (CHUNK, *self.by)]
        if quantiles:
            entries = [
                F.struct(F.lit(c).alias("name"), S.present(named(c).cast("double")).alias("value")) for c in quantiles
            ]
            long = rows.select(*group, F.explode(F.array(*entries)).alias("__e")).select(*group, "__e.*")
            counted = long.where("value IS NOT NULL").groupBy(*group, "name", "value").agg(F.count(F.lit(1)).alias("times"))
            self._write(counted, VALUES)
        parts: list[Column] = [F.count(F.lit(1)).alias("n")]
        for i, c in enumerate(self.moments):
            x = S.present(named(c).cast("double"))
            parts += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), (F.var_pop(x) * F.count(x)).alias(f"s{i}")]
            parts += [F.min(x).alias(f"low{i}"), F.max(x).alias(f"high{i}")]
        for i, (y, x) in enumerate(lines.values()):
            both = S.present(named(y).cast("double")).isNotNull() & S.present(named(x).cast("double")).isNotNull()
            yy, xx = F.when(both, named(y).cast("double")), F.when(both, named(x).cast("double"))
            parts += [F.count(xx).alias(f"ln{i}"), F.avg(xx).alias(f"lx{i}"), F.avg(yy).alias(f"ly{i}")]
            parts += [F.regr_sxx(yy, xx).alias(f"lxx{i}"), F.regr_syy(yy, xx).alias(f"lyy{i}"), F.regr_sxy(yy, xx).alias(f"lxy{i}")]
        self._write(rows.groupBy(*group).agg(*parts), MOMENTS)

    def _write(self, states: DataFrame, name: str) -> None:
        out = states.hint("rebalance", named(CHUNK)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy(CHUNK).parquet(self._at(name))

    def update(self, results: ResultSet) -> list[int]:
        """Store the states of committed chunks that have none yet; only their folders are read."""
        new = sorted(set(results.committed()) - self.chunks())
        if new:
            self.add(results.dataset().where(F.col(CHUNK).isin(new)))
        return new

    def read(self) -> SummaryTable:
        """The summary over all chunks: keys, ``n``, and what was asked for, one row per group."""
        keys = list(self.by)
        group = [named(k) for k in keys]
        states = self.spark.read.parquet(self._at(MOMENTS))
        spots, lines = range(len(self.moments)), list((self.lines or {}).items())
        means = [_mean(f"m{i}", f"n{i}") for i in spots]
        means += [_mean(f"{c}{i}", f"ln{i}") for i in range(len(lines)) for c in ("lx", "ly")]
        whole = states.groupBy(*group).agg(F.sum("n").alias("n"), *means)
        centred = join_on_keys(states.drop("n"), whole.withColumnsRenamed({f"m{i}": f"M{i}_" for i in spots} | {
            f"{c}{i}": f"L{c}{i}_" for i in range(len(lines)) for c in ("lx", "ly")
        }), keys)
        sums: list[Column] = [F.max("n").alias("n")]
        out: list[Column] = [*group, F.col("n")]
        for i, c in enumerate(self.moments):
            away = F.col(f"m{i}") - F.col(f"M{i}_")
            sums += [F.sum(f"n{i}").alias(f"n{i}"), F.max(f"M{i}_").alias(f"m{i}")]
            sums += [F.sum(F.col(f"s{i}") + F.col(f"n{i}") * away * away).alias(f"s{i}")]
            sums += [F.min(f"low{i}").alias(f"low{i}"), F.max(f"high{i}").alias(f"high{i}")]
            sd = F.when(F.col(f"n{i}") > 1, F.sqrt(F.col(f"s{i}") / (F.col(f"n{i}") - 1)))
            out += [F.col(f"m{i}").alias(f"{c}_mean"), sd.alias(f"{c}_sd")]
            out += [F.col(f"low{i}").alias(f"{c}_min"), F.col(f"high{i}").alias(f"{c}_max")]
        for i, (name, (_, x)) in enumerate(lines):
            away_x, away_y = F.col(f"lx{i}") - F.col(f"Llx{i}_"), F.col(f"ly{i}") - F.col(f"Lly{i}_")
            n = F.col(f"ln{i}")
            sums += [F.sum(n).alias(f"ln{i}"), F.max(f"Llx{i}_").alias(f"lx{i}"), F.max(f"Lly{i}_").alias(f"ly{i}")]
            sums += [F.sum(F.col(f"lxx{i}") + n * away_x * away_x).alias(f"lxx{i}")]
            sums += [F.sum(F.col(f"lyy{i}") + n * away_y * away_y).alias(f"lyy{i}")]
            sums += [F.sum(F.col(f"lxy{i}") + n * away_x * away_y).alias(f"lxy{i}")]
            out += _line(name, x, i)
        merged = centred.groupBy(*group).agg(*sums).select(*out)
        for c, probs in (self.quantiles or {}).items():
            suffixes = S.quantiles(c, probs).suffixes()
            names = [c + "_quantiles" + ("" if s is None else f"_{s}") for s in suffixes]
            merged = join_on_keys(merged, self._quantiles(c, [float(p) for p in probs], names), keys, "left")
        return SummaryTable(merged, tuple(keys))

    def _quantiles(self, column: str, probs: list[float], names: list[str]) -> DataFrame:
        keys = list(self.by)
        group = [named(k) for k in keys]
        # a chunk without moments was not finished
        done = F.col(CHUNK).isin(sorted(self.chunks()))
        counted = self.spark.read.parquet(self._at(VALUES)).where(done & (F.col("name") == column))
        # the values of all chunks, many small files, are read once
        counted = materialise(counted.groupBy(*group, "value").agg(F.sum("times").alias("__w")))
        whole = counted.groupBy(*group).agg(F.sum("__w").alias("__n"), F.count(F.lit(1)).alias("__rows"))
        total, largest = whole.agg(F.sum("__rows"), F.max("__rows")).first()
        sizes = GroupSizes(total or 0, largest or 0)
        placed = running_sums(counted, keys, ["value"], {"__le": F.col("__w")}, sizes=sizes)
        placed = join_on_keys(placed, whole.drop("__rows"), keys)
        picks: list[Column] = []
        for i, ends in enumerate(quantile_ranks(F.col("__n"), probs)):
            for side, rank in zip(("lo", "hi"), ends, strict=True):
                covers = (F.col("__le") - F.col("__w") <= rank) & (rank < F.col("__le"))
                picks.append(F.max(F.when(covers, F.col("value"))).alias(f"__{side}{i}"))
        best = placed.groupBy(*group).agg(F.max("__n").alias("__n"), *picks)
        out = []
        for i, (p, name) in enumerate(zip(probs, names, strict=True)):
            h = (F.col("__n") - 1) * F.lit(p)
            lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
            between = (F.floor(h) + 1 - h) * lo + (h - F.floor(h)) * hi
            out.append(F.when((lo == hi) | (h == F.floor(h)), lo).otherwise(between).alias(name))
        return best.select(*group, *out)


def _mean(mean: str, count: str) -> Column:
    return F.try_divide(F.sum(F.col(count) * F.col(mean)), F.sum(count)).alias(mean)


def _line(name: str, x: str, i: int) -> list[Column]:
    """Coefficients and AIC of a line from its merged sums, by the rules of the direct summary."""
    n, sxx, syy, sxy = (F.col(f"{c}{i}") for c in ("ln", "lxx", "lyy", "lxy"))
    moves = sxx > 0
    slope = F.when(moves, F.try_divide(sxy, sxx))
    rss = F.greatest(F.when(moves, syy - F.try_divide(sxy * sxy, sxx)).otherwise(syy), F.lit(0.0))
    deviance = F.when(rss > 0, F.log(F.try_divide(2 * math.pi * rss, n))).otherwise(F.lit(-math.inf))
    aic = F.when(n > 0, n * (deviance + 1.0) + F.when(moves, F.lit(6.0)).otherwise(F.lit(4.0)))
    intercept = F.when(moves, F.col(f"ly{i}") - slope * F.col(f"lx{i}")).otherwise(F.col(f"ly{i}"))
    return [intercept.alias(f"{name}_(Intercept)"), slope.alias(f"{name}_{x}"), aic.alias(f"{name}_aic")]
