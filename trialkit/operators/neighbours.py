"""Nearest rows of many targets, by an exact pivot index.

Distances to a few pivots put every row into a cell. By the triangle inequality a target's own distances to the
pivots bound its distance to all rows of a cell, so cells are joined to targets by range, not rows. The nearest cells
that hold enough rows give a first cut; every cell whose bound is below it is compared, the others cannot matter.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialkit.functions.columns import named
from trialkit.operators.joins import join_on_keys
from trialkit.sources.checkpoints import materialise

#: Cells per doubling of a distance in which a cut is looked for.
CUT_CELLS = 64
#: Pivots, and slots for the distances to each of them: at most SLOTS ** PIVOTS cells.
PIVOTS = 4
SLOTS = 8
#: Bounds give way by this share, as distances have rounding errors.
SLACK = 1e-9


def distance_cell(distance: Column) -> Column:
    """Number of a distance on a log scale; 0 is below all others."""
    return F.when(distance > 0, F.floor(F.log2(distance) * CUT_CELLS)).otherwise(F.lit(-(2**31))).cast("bigint")


def cut_cells(measured: DataFrame, keys: Sequence[str], distance: str, wanted: int) -> DataFrame:
    """Per group, the cell ``__cut`` of the ``wanted``-th nearest row. Counts combine before the shuffle."""
    group = [named(k) for k in keys]
    counts = measured.groupBy(*group, distance_cell(named(distance)).alias("__cell")).agg(F.count(F.lit(1)).alias("__n"))
    # a few thousand cells per group at most, whatever the number of rows
    upto = Window.partitionBy(*group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("__n").over(upto), F.lit(0))
    cuts = counts.withColumn("__before", before).where(F.col("__before") < wanted)
    return cuts.groupBy(*group).agg(F.max("__cell").alias("__cut"))


def _far_apart(points: Sequence[Sequence[float]], n: int) -> list[Sequence[float]]:
    """Up to ``n`` of the points, each as far as possible from those before it."""
    chosen = [points[0]]
    away = [math.dist(p, points[0]) for p in points]
    while len(chosen) < n and max(away) > 0:
        k = max(range(len(points)), key=away.__getitem__)
        chosen.append(points[k])
        away = [min(a, math.dist(p, points[k])) for a, p in zip(away, points, strict=True)]
    return chosen


def _to_pivot(stats: Sequence[str], pivot: Sequence[float], scale: Sequence[float]) -> Column:
    terms = [(named(s) / F.lit(c) - F.lit(p)) for s, p, c in zip(stats, pivot, scale, strict=True)]
    return F.sqrt(reduce(lambda a, b: a + b, [t * t for t in terms]))


def candidate_pairs(
    rows: DataFrame,
    key: str,
    stats: Sequence[str],
    targets: Sequence[tuple[object, Mapping[str, float], Mapping[str, float]]],
    goals: DataFrame,
    distance: Column,
    wanted: int,
) -> DataFrame:
    """Rows of ``rows`` beside targets of ``goals``, at least each target's ``wanted`` nearest other rows.

    ``targets`` are (name, statistics, scales) of the rows of ``goals``, where the name is in column ``holdout``;
    ``distance`` is the distance of a pair, which scales each statistic by the target's own scale. A row whose
    ``key`` is the target's name is no neighbour. Nothing is left out that could be among the nearest: the result
    of putting these pairs in order is that of all pairs.
    """
    scale = [float(targets[0][2][s]) for s in stats]
    points = [[float(t[s]) / c for s, c in zip(stats, scale, strict=True)] for _, t, _ in targets]
    usable = [p for p in points if all(map(math.isfinite, p))]
    pivots = _far_apart(usable, PIVOTS) if usable else []
    if not pivots:
        return rows.crossJoin(F.broadcast(goals)).where(named(key) != F.col("holdout"))
    spots = range(len(pivots))
    placed = rows.withColumns({f"__v{i}": _to_pivot(stats, p, scale) for i, p in enumerate(pivots)})

    # slots of about equally many rows; any bounds give right cells
    shares = F.array(*[F.lit(k / SLOTS) for k in range(1, SLOTS)])
    bounds = placed.agg(*[F.percentile_approx(f"__v{i}", shares, F.lit(1000)) for i in spots]).first()
    slots = [F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds[i]]), _reached(f"__v{i}"))) for i in spots]
    number = reduce(lambda a, b: a * SLOTS + b, slots)
    placed = placed.withColumn("__slot", number)
    ends = [f(f"__v{i}").alias(f"__{n}{i}") for i in spots for n, f in (("low", F.min), ("high", F.max))]
    cells = placed.groupBy("__slot").agg(F.count(F.lit(1)).alias("__n"), *ends)

    lines = []
    for (name, _, own), point in zip(targets, points, strict=True):
        # how far the target's own scales stretch or shrink a distance of the index
        ratio = [c / float(own[s]) for s, c in zip(stats, scale, strict=True)]
        lines.append((name, min(ratio), *[math.dist(point, p) for p in pivots]))
    kind = goals.schema["holdout"].dataType.simpleString()
    schema = ", ".join([f"holdout {kind}", "__least double", *[f"__t{i} double" for i in spots]])
    asked = rows.sparkSession.createDataFrame(lines, schema)
    gaps = [F.greatest(F.lit(0.0), F.col(f"__low{i}") - F.col(f"__t{i}"), F.col(f"__t{i}") - F.col(f"__high{i}")) for i in spots]
    lower = reduce(F.greatest, gaps) * F.col("__least") * F.lit(1 - SLACK)
    # both sides are bounded by the call: targets, and cells of the index
    reach = asked.crossJoin(cells).withColumn("__lower", F.when(F.isnan(lower), F.lit(0.0)).otherwise(lower))
    reach = materialise(reach.select("holdout", "__slot", "__n", "__lower"))

    def beside(pairs: DataFrame) -> DataFrame:
        both = placed.join(pairs.select("holdout", "__slot"), "__slot").drop("__slot", *[f"__v{i}" for i in spots])
        return join_on_keys(both, goals, ["holdout"]).where(named(key) != F.col("holdout"))

    near = Window.partitionBy("holdout").orderBy("__lower", "__slot").rowsBetween(Window.unboundedPreceding, -1)
    # the target itself may be in a cell as well
    first = reach.withColumn("__before", F.coalesce(F.sum("__n").over(near), F.lit(0))).where(F.col("__before") < wanted + 1)
    cuts = cut_cells(beside(first).withColumn("__d", distance), ["holdout"], "__d", wanted)
    radius = F.pow(F.lit(2.0), (F.col("__cut").cast("double") + 1) / CUT_CELLS) * F.lit(1 + SLACK)
    left = join_on_keys(reach, cuts, ["holdout"], "left")
    return beside(left.where(F.col("__cut").isNull() | (F.col("__lower") <= radius)))


def _reached(value: str):
    return lambda bound: F.col(value) >= bound
