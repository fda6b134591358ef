"""First crossings of running sums, and races between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialkit.functions.columns import as_column, named, require_columns
from trialkit.operators.blocks import GroupSizes, row_numbers, running_sums


def first_crossing(
    df: DataFrame,
    *,
    series: Sequence[str],
    time: str,
    step: Column | str,
    upper: Column | float,
    lower: Column | float | None = None,
    order: Sequence[str] = (),
    block_rows: int | None = None,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Per series, the first time its running sum reaches ``upper`` or falls to ``lower``.

    Gives the series, the time, and ``choice``: +1 for the upper bound, −1 for the lower, the upper one
    winning if both are met. A series that never crosses has no row. ``order`` breaks ties in time.
    The running sum is built block by block, so a series of any length is shared out over tasks; the
    first crossing is then a minimum, which combines before the shuffle.
    """
    keys = list(series)
    require_columns(df, [*keys, time, *order])
    high = upper if isinstance(upper, Column) else F.lit(upper)
    # NULL bounds never bind
    low = F.lit(None).cast("double") if lower is None else (lower if isinstance(lower, Column) else F.lit(lower))
    steps = df.select(
        *[named(c) for c in dict.fromkeys([*keys, time, *order])],
        as_column(step).alias("__step"),
        high.alias("__high"),
        low.alias("__low"),
    )
    sums = running_sums(steps, keys, [time, *order], {"__sum": F.col("__step")}, block_rows, sizes)
    up = F.coalesce(F.col("__sum") >= F.col("__high"), F.lit(False))
    down = F.coalesce(F.col("__sum") <= F.col("__low"), F.lit(False))
    hits = sums.where(up | down)
    at = F.struct(*[named(c) for c in [time, *order]])
    choice = F.when(up, F.lit(1)).otherwise(F.lit(-1))
    first = hits.groupBy(*[named(k) for k in keys]).agg(
        F.min(named(time)).alias("t"), F.min_by(choice, at).alias("choice")
    )
    return first


def race(
    crossings: DataFrame,
    *,
    trial: Sequence[str],
    item: str,
    time: str = "t",
    max_time: Column | float | None = None,
    max_reached: int | None = None,
    block_rows: int | None = None,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Rank the crossings of each trial by time, then item.

    A crossing at or after ``max_time`` did not happen; only the first ``max_reached`` are kept.
    """
    require_columns(crossings, [*trial, item, time])
    if max_time is not None:
        limit = max_time if isinstance(max_time, Column) else F.lit(max_time)
        crossings = crossings.where(named(time) < limit)
    ranked = row_numbers(crossings, list(trial), [time, item], "rank_idx", block_rows, sizes)
    ranked = ranked.withColumn("rank_idx", F.col("rank_idx").cast("int"))
    return ranked if max_reached is None else ranked.where(F.col("rank_idx") <= max_reached)
