"""Ordered work inside groups of any size.

Ranks, running sums and exact quantiles need the rows of a group in order. While every group is small
a window per group does it. Once one group outgrows ``BLOCK_ROWS`` the rows are range-partitioned by
(group, order), which cuts a big group into many *blocks*; a window per block plus the totals of the
blocks before it gives the same numbers, and no task ever holds a whole group.

The choice is made from one counted number (the size of the biggest group), never guessed. A caller that
knows the sizes, say from another operator of the same chain, hands them over and nothing is counted.

Counts, ranks and quantiles are the same to the last bit either way. Running sums of doubles add in another
order within blocks, so their last bits may differ between the two.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialkit.functions.columns import named
from trialkit.operators.joins import join_on_keys, solid_keys
from trialkit.operators.selection import select_quantiles, select_ranks
from trialkit.sources.checkpoints import materialise

#: Largest group handled as one unit; a quantile buffer of this size takes a few dozen MB.
BLOCK_ROWS = 250_000
#: Blocks of fewer rows are not worth a task, even where ``block_rows`` asks for smaller ones.
SHORTEST_BLOCK = 10_000
#: A big group is cut into a few blocks even so.
FEWEST_BLOCKS = 8

BLOCK = "__block"


@dataclass(frozen=True)
class GroupSizes:
    """Rows in all and in the biggest group."""

    total: int
    largest: int

    def beyond(self, block_rows: int | None) -> bool:
        return self.largest > (BLOCK_ROWS if block_rows is None else block_rows)


def group_sizes(rows: DataFrame, keys: Sequence[str]) -> GroupSizes:
    """Count the groups. Counts combine before the shuffle; two numbers reach the driver."""
    if not keys:
        n = rows.count()
        return GroupSizes(n, n)
    sizes = rows.groupBy(*[named(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    total, largest = sizes.agg(F.sum("n"), F.max("n")).first()
    return GroupSizes(total or 0, largest or 0)


class Blocks:
    """Rows tagged with the block they belong to."""

    def __init__(self, rows: DataFrame, keys: Sequence[str], order: Sequence[str], split: bool):
        self.rows, self.keys, self.order, self.split = rows, list(keys), list(order), split

    @classmethod
    def of(
        cls,
        rows: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        block_rows: int | None = None,
        sizes: GroupSizes | None = None,
    ) -> Blocks:
        """``sizes`` (of ``rows`` or of a table with at least its rows) saves the count."""
        sizes = sizes or group_sizes(rows, keys)
        if not sizes.beyond(block_rows):
            return cls(rows.withColumn(BLOCK, F.lit(0)), keys, order, False)
        limit = BLOCK_ROWS if block_rows is None else block_rows
        # the number of blocks follows the rows alone, so a block never outgrows its limit
        parts = max(FEWEST_BLOCKS, math.ceil(sizes.total / max(limit, SHORTEST_BLOCK)))
        ranged = rows.repartitionByRange(parts, *[named(c) for c in [*keys, *order]])
        # A block number is only as stable as the range bounds behind it, so it is written down
        # before anything is computed from it: a lost executor cannot renumber the blocks.
        return cls(materialise(ranged.withColumn(BLOCK, F.spark_partition_id())), keys, order, True)

    @property
    def unit(self) -> list[str]:
        """Columns by which the rows are spread: no task gets more than one block of a group."""
        return [*self.keys, BLOCK]

    def _cells(self) -> list[Column]:
        # With one block per group the block column is constant; leaving it out keeps the
        # partitioning on the keys alone, which later steps on the same keys reuse.
        return [named(c) for c in (self.unit if self.split else self.keys)]

    def running(self, sums: Mapping[str, Column], totals: Mapping[str, str] | None = None) -> DataFrame:
        """Add, for each entry, the sum over the rows of the group up to and including this one.

        ``totals`` maps further output names to entries of ``sums``: their sum over the whole group.
        """
        totals = dict(totals or {})
        within = Window.partitionBy(*self._cells()).orderBy(*[named(c) for c in self.order])
        upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        if not self.split:
            # the full frame shares the sort of the running one
            full = within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            return self.rows.withColumns(
                {
                    **{name: F.sum(v).over(upto) for name, v in sums.items()},
                    **{name: F.sum(sums[src]).over(full) for name, src in totals.items()},
                }
            )
        inside = self.rows.withColumns({name: F.sum(v).over(upto) for name, v in sums.items()})
        return self._shifted(inside, self._starts(sums, totals), sums)

    def _starts(self, sums: Mapping[str, Column], totals: Mapping[str, str]) -> DataFrame:
        """Per block of a group: the sums over the blocks before it (``__b_…``), and group totals.

        One row per block of a group.
        """
        cells = self.rows.groupBy(*self._cells()).agg(*[F.sum(v).alias(f"__t_{n}") for n, v in sums.items()])
        group = Window.partitionBy(*[named(k) for k in self.keys])
        before = group.orderBy(named(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
        return cells.select(
            *self._cells(),
            *[named(f"__t_{n}") for n in sums],
            *[F.coalesce(F.sum(named(f"__t_{n}")).over(before), F.lit(0)).alias(f"__b_{n}") for n in sums],
            *[F.sum(named(f"__t_{src}")).over(group).alias(out) for out, src in totals.items()],
        )

    def _shifted(self, inside: DataFrame, starts: DataFrame, sums: Mapping[str, Column]) -> DataFrame:
        joined = join_on_keys(inside, starts.drop(*[f"__t_{n}" for n in sums]), self.unit)
        return joined.withColumns({n: named(n) + named(f"__b_{n}") for n in sums}).drop(*[f"__b_{n}" for n in sums])

    def attach(self, df: DataFrame, per_group: DataFrame) -> DataFrame:
        """Join one row per group to ``df`` (rows carrying the block column) block by block."""
        if not self.split:
            return join_on_keys(df, per_group, self.keys)
        cells = self.rows.select(*self._cells()).distinct()
        return join_on_keys(df, join_on_keys(cells, per_group, self.keys), self.unit)


def row_numbers(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str,
    block_rows: int | None = None,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Number the rows of each group 1, 2, … by ``order``, which must be free of ties."""
    return running_sums(rows, keys, order, {out: F.lit(1).cast("bigint")}, block_rows, sizes)


def running_sums(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column],
    block_rows: int | None = None,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Add sums over the rows of the group up to and including this one, by a tie-free ``order``."""
    solid, inner, back = solid_keys(rows, keys)
    done = Blocks.of(solid, inner, order, block_rows, sizes).running(sums)
    rest = [named(c) for c in rows.columns if c not in keys]
    return done.select(*back, *rest, *[named(n) for n in sums])


def average_ranks(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    out: str,
    block_rows: int | None = None,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Rank of each value in its group, ties sharing their mean rank.

    The join back is plain, so adaptive execution splits the rows of a value that fills a group.
    """
    ranked = running_sums(_counted(rows, keys, value), keys, [value], {"__le": F.col("__w")}, block_rows, sizes)
    ranks = ranked.select(
        *[named(k) for k in [*keys, value]],
        (F.col("__le") - F.col("__w") + (F.col("__w") + 1) / 2.0).alias(out),
    )
    return join_on_keys(rows, ranks, [*keys, value])


def _counted(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values with their count ``__w``: a value that fills a group is one row."""
    return rows.groupBy(*[named(k) for k in [*keys, value]]).agg(F.count(F.lit(1)).alias("__w"))


def group_quantiles(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    block_rows: int | None = None,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Exact type-7 quantiles of the non-missing values of each group: keys, ``n``, ``q``.

    Groups beyond ``block_rows`` are not put in order: the ranks are found by counting (see
    :mod:`trialkit.operators.selection`).
    """
    present = rows.select(*[named(k) for k in keys], named(value).cast("double").alias(value))
    present = present.where(named(value).isNotNull() & ~F.isnan(named(value)))
    sizes = sizes or group_sizes(present, keys)
    if not sizes.beyond(block_rows):
        return present.groupBy(*[named(k) for k in keys]).agg(
            F.count(F.lit(1)).alias("n"),
            F.percentile(named(value), F.array(*[F.lit(float(p)) for p in probs])).alias("q"),
        )
    solid, inner, back = solid_keys(present, keys)
    return select_quantiles(solid, inner, value, probs).select(*back, "n", "q")


def order_statistics(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: Sequence[int],
    block_rows: int | None = None,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """The ``ranks``-th smallest values (1-based) of each group: keys and ``x``, one element per rank."""
    present = rows.select(*[named(k) for k in keys], named(value).cast("double").alias(value))
    present = present.where(named(value).isNotNull() & ~F.isnan(named(value)))
    sizes = sizes or group_sizes(present, keys)
    if not sizes.beyond(block_rows):
        ordered = F.sort_array(F.collect_list(named(value)))
        small = present.groupBy(*[named(k) for k in keys]).agg(ordered.alias("x"))
        return small.select(*[named(k) for k in keys], F.array(*[F.get("x", F.lit(k - 1)) for k in ranks]).alias("x"))
    solid, inner, back = solid_keys(present, keys)
    return select_ranks(solid, inner, value, lambda n: [F.lit(k - 1) for k in ranks]).select(*back, "x")
