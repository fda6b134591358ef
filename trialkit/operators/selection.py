"""Exact order statistics in groups of any size, by radix selection.

Doubles become 64-bit integers in the same order. Rows are counted by group and the first 16 bits, which combines
before the shuffle; the counts tell which cell holds a wanted rank. Only rows of these cells are counted again, by
the next 16 bits, or by all of them where cells have few rows, until a cell holds one value. No row is sorted, moved or written: each round reads the rows and
shuffles counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialkit.functions.columns import as_column, named
from trialkit.operators.joins import join_on_keys
from trialkit.sources.checkpoints import materialise

#: Low bits left out of account, round by round.
SHIFTS = (48, 32, 16, 0)
#: Rows of a cell that are told apart by all bits at once: they make no more cells than a round does.
CELL_ROWS = 2**16

_TINY = 2.0**-1022
_FRACTION = 2.0**52


def ordered_bits(value: Column | str) -> Column:
    """A bigint that orders doubles as they are, different for different values; −0 counts as 0.

    It is the sign and the IEEE-754 pattern of the magnitude, worked out by exact arithmetic: dividing by a power
    of two and scaling by one lose nothing. NaN has none.
    """
    x = as_column(value).cast("double")
    size = F.abs(x)
    power = F.least(F.floor(F.log2(size)).cast("double"), F.lit(1023.0))
    share = size / F.pow(F.lit(2.0), power) - 1.0
    # Next to a power of two the logarithm may be off by one, which leaves a share below 0 or from 1 on. The least of
    # these three is the place from that power on as it should be, without a branch that would be computed twice.
    place = F.least(share, 2 * share, (1 + share) / 2)
    normal = (power + 1023).cast("bigint") * F.lit(1 << 52) + (place * F.lit(_FRACTION)).cast("bigint")
    bits = (
        F.when(size == 0, F.lit(0).cast("bigint"))
        .when(size == F.lit(math.inf), F.lit(2047 << 52))
        .when(size < F.lit(_TINY), (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("bigint"))
        .otherwise(normal)
    )
    return F.when(~F.isnan(x), F.when(x < 0, -bits).otherwise(bits))


def select_ranks(
    rows: DataFrame, keys: Sequence[str], value: str, ranks: Callable[[Column], Sequence[Column]]
) -> DataFrame:
    """The values at 0-based ranks of each group: keys, ``n``, and ``x``, an element per rank.

    ``ranks`` gives them from the size of the group; a rank outside it has NULL. Keys hold no NULL, nor does the
    value, which is a double and not NaN. What a round brings to one task are the cells of a group, at most 2**16.
    """
    group = [named(k) for k in keys]
    base = rows.select(*group, named(value).cast("double").alias("__x"), ordered_bits(value).alias("__bits"))
    # the number of ranks follows from the call alone
    size = len(ranks(F.lit(1)))
    found = []
    shift, done, left = SHIFTS[0], None, None
    while True:
        cells = _first_cells(base, keys, shift, ranks) if left is None else _finer_cells(base, keys, done, shift, left)
        spot = F.explode("__spots").alias("__spot")
        hits = cells.select(*group, "n", F.col("__part").alias("__cell"), "__before", "__count", "__low", "__high", spot)
        hits = hits.select("*", "__spot.*").withColumn("rank", F.col("rank") - F.col("__before"))
        hits = materialise(hits.drop("__spot", "__before"))
        # a cell of one value is that value, and the mark of a group needs none
        settled = (F.col("i") < 0) | (F.col("__low") == F.col("__high"))
        found.append(hits.where(settled))
        left = hits.where(~settled)
        most = left.agg(F.max("__count")).first()[0]
        if most is None:
            break
        shift, done = next_shift(SHIFTS, shift, most, CELL_ROWS), shift
    values = reduce(DataFrame.unionByName, found)
    # one entry per rank; array functions keep the code small, however many ranks there are
    entry = F.when(F.col("i") >= 0, F.struct("i", "__low"))
    picked = values.groupBy(*group).agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.map_from_entries(F.collect_list(entry)).alias("__at")
    )
    places = F.sequence(F.lit(0), F.lit(size - 1))
    return picked.select(*group, "n", F.transform(places, lambda i: F.try_element_at("__at", i)).alias("x"))


def next_shift(shifts: Sequence[int], shift: int, most: int, few: int) -> int:
    """The bits to leave out next, where the cells still of interest hold ``most`` rows: none, if these are ``few``."""
    return shifts[-1] if most <= few else shifts[shifts.index(shift) + 1]


def _counted(rows: DataFrame, within: Sequence[str], shift: int) -> DataFrame:
    """Cells with their count, the rows before them in ``within``, and their ends."""
    part = F.shiftright("__bits", shift).alias("__part")
    cells = rows.groupBy(*[named(k) for k in within], part).agg(
        F.count(F.lit(1)).alias("__count"), F.min("__x").alias("__low"), F.max("__x").alias("__high")
    )
    order = Window.partitionBy(*[named(k) for k in within]).orderBy("__part")
    before = F.sum("__count").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return cells.withColumn("__before", F.coalesce(before, F.lit(0)))


def _holding(cells: DataFrame, spots: Column) -> DataFrame:
    """Cells in which some of the wanted ranks lie, with these."""
    past = F.col("__before") + F.col("__count")
    here = F.filter(spots, lambda s: (s["rank"] >= F.col("__before")) & (s["rank"] < past))
    return cells.withColumn("__spots", here).where(F.size("__spots") > 0)


def _first_cells(base: DataFrame, keys: Sequence[str], shift: int, ranks: Callable[[Column], Sequence[Column]]) -> DataFrame:
    cells = _counted(base, keys, shift)
    cells = cells.withColumn("n", F.sum("__count").over(Window.partitionBy(*[named(k) for k in keys])))
    # the mark −1 stands in every group, also where no wanted rank does
    wanted = [(-1, F.lit(0)), *enumerate(ranks(F.col("n")))]
    return _holding(
        cells, F.array(*[F.struct(F.lit(i).alias("i"), k.cast("bigint").alias("rank")) for i, k in wanted])
    )


def _finer_cells(base: DataFrame, keys: Sequence[str], done: int, shift: int, left: DataFrame) -> DataFrame:
    within = [*keys, "__cell"]
    asked = left.groupBy(*[named(k) for k in within]).agg(
        F.max("n").alias("n"), F.collect_list(F.struct("i", "rank")).alias("__wanted")
    )
    rows = base.withColumn("__cell", F.shiftright("__bits", done))
    rows = join_on_keys(rows, asked.select(*[named(k) for k in within]), within)
    cells = join_on_keys(_counted(rows, within, shift), asked, within)
    return _holding(cells, F.col("__wanted")).drop("__cell", "__wanted")


def quantile_ranks(n: Column, probs: Sequence[float]) -> list[tuple[Column, Column]]:
    """0-based ranks on both sides of each type-7 quantile."""
    lower = [F.floor((n - 1) * F.lit(float(p))) for p in probs]
    return [(k, F.least(k + 1, n - 1)) for k in lower]


def select_quantiles(rows: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Type-7 quantiles of each group: keys, ``n`` and ``q``, an element per probability."""
    picked = select_ranks(rows, keys, value, lambda n: [k for pair in quantile_ranks(n, probs) for k in pair])

    def between(p: Column, i: Column) -> Column:
        h = (F.col("n") - 1) * p
        lo, hi = F.get("x", 2 * i), F.get("x", 2 * i + 1)
        # the same weights as the built-in percentile, so both agree to the last bit
        mixed = (F.floor(h) + 1 - h) * lo + (h - F.floor(h)) * hi
        return F.when((lo == hi) | (h == F.floor(h)), lo).otherwise(mixed)

    listed = F.array(*[F.lit(float(p)) for p in probs])
    return picked.select(*[named(k) for k in keys], "n", F.transform(listed, between).alias("q"))
