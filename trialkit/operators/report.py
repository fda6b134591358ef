"""Tables behind the reports: posterior summaries, recovery, pair correlation, histograms, densities."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialkit.functions import stats as S
from trialkit.functions.columns import is_finite, is_missing, named, require_columns
from trialkit.operators.blocks import GroupSizes, average_ranks, group_quantiles, group_sizes, join_on_keys
from trialkit.operators.inference import AbcInput, Posterior
from trialkit.operators.nest import to_long
from trialkit.operators.summarise import Expression, summarise
from trialkit.sources.checkpoints import materialise

# --- posterior summaries ---------------------------------------------------------------------


@dataclass(frozen=True)
class PosteriorSummary:
    df: DataFrame
    ci_level: float
    posterior: Posterior

    @property
    def n_samples(self) -> int:
        """Accepted conditions, usable or not."""
        return self.posterior.df.count()


def summarise_posterior(
    posterior: Posterior, ci_level: float = 0.95, block_rows: int | None = None, **custom: Expression
) -> PosteriorSummary:
    """Per parameter, over its finite values: mean, median, interval bounds and ``custom`` expressions.

    Custom expressions read the column ``value``; grouped-aggregate pandas UDFs may be among them. A
    parameter without finite values keeps a row.
    """
    tail = (1 - ci_level) / 2
    lower, upper = f"ci_lower_{tail:.3f}", f"ci_upper_{1 - tail:.3f}"
    long = to_long(posterior.values(), [], posterior.params)
    # masked, not filtered: the group of a parameter with nothing finite must survive
    long = long.withColumn("value", F.when(is_finite("value"), F.col("value")))
    spec = summarise(
        by="parameter",
        wider_by="parameter",
        mean=S.mean("value"),
        median=S.median("value"),
        **{lower: S.quantiles("value", [tail]), upper: S.quantiles("value", [1 - tail])},
        **custom,
    )
    table = spec(long, block_rows).df
    position = F.array_position(F.array(*[F.lit(p) for p in posterior.params]), F.col("parameter"))
    return PosteriorSummary(table.orderBy(position), ci_level, posterior)


# --- recovery --------------------------------------------------------------------------------


def residuals(cv: DataFrame) -> DataFrame:
    """Cross-validation rows with ``residual = estimate − true``."""
    require_columns(cv, ["tol", "parameter", "true", "estimate"])
    return cv.withColumn("residual", F.col("estimate") - F.col("true"))


def within_residual_quantile(
    rows: DataFrame, prob: float, keys: Sequence[str] = ("tol", "parameter"), block_rows: int | None = None
) -> DataFrame:
    """Rows whose absolute residual does not exceed that quantile of its group."""
    away = rows.withColumn("__away", F.abs("residual"))
    cut = group_quantiles(away, keys, "__away", [prob], block_rows)
    cut = cut.select(*[named(k) for k in keys], F.get("q", F.lit(0)).alias("__cut"))
    kept = join_on_keys(away, cut, keys).where(F.col("__away") <= F.col("__cut"))
    return kept.select(*[named(c) for c in rows.columns])


def _line(y: Column, x: Column) -> tuple[Column, Column, Column]:
    """Correlation, slope and intercept over complete pairs; NULL where there is no variation."""
    both = ~is_missing(x) & ~is_missing(y)
    xx, yy = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    sxx, syy = F.regr_sxx(yy, xx), F.regr_syy(yy, xx)
    moves = sxx > 0
    # the built-in correlation divides by zero, which is an error in ANSI mode
    r = F.try_divide(F.regr_sxy(yy, xx), F.sqrt(sxx) * F.sqrt(syy))
    return (
        F.when(moves & (syy > 0), r),
        F.when(moves, F.regr_slope(yy, xx)),
        F.when(moves, F.regr_intercept(yy, xx)).otherwise(F.avg(yy)),
    )


def recovery_table(cv: DataFrame, resid_tol: float | None = None, block_rows: int | None = None) -> DataFrame:
    """Per tolerance and parameter: correlation of true and estimated values and the fitted line."""
    rows = residuals(cv)
    if resid_tol is not None:
        rows = within_residual_quantile(rows, resid_tol, block_rows=block_rows)
    r, slope, intercept = _line(F.col("estimate"), F.col("true"))
    return rows.groupBy("tol", "parameter").agg(
        F.count(F.lit(1)).alias("n"), r.alias("r"), slope.alias("slope"), intercept.alias("intercept")
    )


def pair_correlation(cv: DataFrame, params: Sequence[str], block_rows: int | None = None) -> DataFrame:
    """Per tolerance and pair of parameters: Spearman correlation of the estimates and the fitted line.

    Held-out conditions with a non-finite estimate of any parameter are left out. Values and ranks of a condition
    travel as two arrays; their products are summed as one matrix per tolerance, so the plan is the same for any
    number of parameters, and all pairs are read off the sums.
    """
    require_columns(cv, ["tol", "holdout", "parameter", "estimate"])
    params = list(params)
    wanted = F.array(*[F.lit(p) for p in params])
    long = cv.where(F.array_contains(wanted, F.col("parameter")))
    long = long.groupBy("tol", "holdout", "parameter").agg(F.first("estimate").alias("value"))
    whole = long.where(is_finite("value")).groupBy("tol", "holdout").agg(F.count(F.lit(1)).alias("__n"))
    long = join_on_keys(long, whole.where(F.col("__n") == len(params)).drop("__n"), ["tol", "holdout"])
    ranked = average_ranks(long, ["tol", "parameter"], "value", "rank", block_rows)

    # products of what is left of a value once its mean is taken; a constant one leaves exactly nothing
    moves = F.min("value") < F.max("value")
    means = ranked.groupBy("tol", "parameter").agg(
        F.avg("value").alias("__mean"), F.avg("rank").alias("__middle"), moves.alias("__moves")
    )
    means = materialise(means)
    away = join_on_keys(ranked, means, ["tol", "parameter"])
    parts = [F.when(F.col("__moves"), F.col(c) - F.col(m)).otherwise(F.lit(0.0)) for c, m in (("value", "__mean"), ("rank", "__middle"))]
    entry = F.struct(F.array_position(wanted, F.col("parameter")).alias("i"), parts[0].alias("x"), parts[1].alias("r"))
    rows = away.groupBy("tol", "holdout").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    sums = _gram(rows.select("tol", F.col("e.x").alias("x"), F.col("e.r").alias("r")), len(params))
    listed = means.groupBy("tol").agg(
        F.sort_array(F.collect_list(F.struct(F.array_position(wanted, F.col("parameter")).alias("i"), "__mean"))).alias("m")
    )
    table = join_on_keys(sums, listed, ["tol"])

    k = len(params)
    at = lambda name, i, j: F.get(name, (i * k + j).cast("int"))

    def pair(i: Column, j: Column) -> Column:
        sxx, syy, sxy = at("xx", i, i), at("xx", j, j), at("xx", i, j)
        rxx, ryy, rxy = at("rr", i, i), at("rr", j, j), at("rr", i, j)
        slope = F.when(sxx > 0, F.try_divide(sxy, sxx))
        mean = lambda c: F.get("m", c.cast("int"))["__mean"]
        return F.struct(
            F.get(wanted, i.cast("int")).alias("p1"),
            F.get(wanted, j.cast("int")).alias("p2"),
            F.when((rxx > 0) & (ryy > 0), F.try_divide(rxy, F.sqrt(rxx) * F.sqrt(ryy))).alias("rho"),
            slope.alias("slope"),
            F.when(sxx > 0, mean(j) - slope * mean(i)).otherwise(mean(j)).alias("intercept"),
            F.col("n"),
        )

    # the upper half of the matrix, place by place
    places = F.filter(F.sequence(F.lit(0), F.lit(k * k - 1)), lambda p: F.floor(p / k) < F.pmod(p, F.lit(k)))
    pairs = F.transform(places, lambda p: pair(F.floor(p / k), F.pmod(p, F.lit(k))))
    return table.select("tol", F.explode(pairs).alias("pair")).select("tol", "pair.*")


def _gram(rows: DataFrame, k: int) -> DataFrame:
    """Per tolerance the sums of products of ``k`` values, ``xx``, and of their ranks, ``rr``, and the rows, ``n``."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[float, np.ndarray] = {}
        for part in batches:
            for tol, own in part.groupby("tol"):
                sums = [np.array([len(own)], float)]
                for name in ("x", "r"):
                    z = np.stack(own[name].to_numpy())
                    sums.append((z.T @ z).ravel())
                total[tol] = total.get(tol, 0.0) + np.concatenate(sums)
        yield pd.DataFrame({"tol": list(total), "sums": [v.tolist() for v in total.values()]})

    # one array per task and tolerance, added up element by element
    kind = rows.schema["tol"].dataType.simpleString()
    parts = rows.mapInPandas(partial, f"tol {kind}, sums array<double>")
    cells = parts.select("tol", F.posexplode("sums").alias("spot", "part")).groupBy("tol", "spot").agg(F.sum("part").alias("part"))
    flat = cells.groupBy("tol").agg(F.sort_array(F.collect_list(F.struct("spot", "part"))).alias("s"))
    flat = flat.select("tol", F.col("s.part").alias("s"))
    return flat.select(
        "tol",
        F.get("s", F.lit(0)).cast("bigint").alias("n"),
        F.slice("s", 2, k * k).alias("xx"),
        F.slice("s", 2 + k * k, k * k).alias("rr"),
    )


# --- histograms ------------------------------------------------------------------------------

# Fixed values of the rule for round breaks: bias towards larger units, the same for the step to five,
# shrinkage for a range without width, and the slack for values that lie on a break.
UNIT_BIAS = 1.5
UNIT_BIAS_FIVE = 2.75
SHRINK = 0.75
BREAK_SLACK = 1e-10
BIN_SLACK = 1e-7


def round_breaks(groups: DataFrame, low: str, high: str, bins: str) -> DataFrame:
    """Add ``unit``, ``first`` and ``last``: breaks at whole multiples of 1, 2 or 5 times a power of ten.

    About ``bins`` intervals that cover [low, high], chosen per row, so every group has its own.
    """
    lo, hi, n = named(low), named(high), named(bins)
    size = F.greatest(F.abs(lo), F.abs(hi))
    flat = (hi - lo) <= size * (1.0 + 1.0 / (1.0 + UNIT_BIAS)) * n * (3 * 2.0**-52)
    point = F.when(size == 0, F.lit(1.0)).when(size > 10, 9.0 + size / 10.0).otherwise(size) * SHRINK
    groups = groups.withColumn("__cell", F.when(flat, point).otherwise((hi - lo) / n))
    groups = groups.withColumn("__base", F.pow(F.lit(10.0), F.floor(F.log10("__cell"))))
    cell, base = F.col("__cell"), F.col("__base")
    # each step up is tried only if the one before it was taken
    two = 2 * base - cell < UNIT_BIAS * (cell - base)
    five = two & (5 * base - cell < UNIT_BIAS_FIVE * (cell - 2 * base))
    ten = five & (10 * base - cell < UNIT_BIAS * (cell - 5 * base))
    unit = F.when(ten, 10 * base).when(five, 5 * base).when(two, 2 * base).otherwise(base)
    groups = groups.withColumn("unit", unit)
    first = F.floor(lo / F.col("unit") + BREAK_SLACK)
    last = F.ceil(hi / F.col("unit") - BREAK_SLACK)
    groups = groups.withColumns({"__first": first, "__last": last})
    # one value on a break still gets a bin: the one below it, or above it left of zero
    alone = F.col("__first") >= F.col("__last")
    low_side = F.when(alone & (F.col("__first") >= 0), 1).otherwise(0)
    high_side = F.when(alone & (F.col("__first") < 0), 1).otherwise(0)
    return groups.withColumns({"first": F.col("__first") - low_side, "last": F.col("__last") + high_side}).drop(
        "__cell", "__base", "__first", "__last"
    )


def scaled_histogram(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Counts of finite values in right-closed bins with round breaks, and their share of the fullest bin.

    The number of bins follows Sturges' rule. Bounds and counts are two passes of partial aggregation; a
    group contributes a handful of rows to the second however large it is.
    """
    group = [named(k) for k in keys]
    rows = df.where(is_finite(value)).select(*group, named(value).cast("double").alias("__v"))
    ranges = rows.groupBy(*group).agg(
        F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.count(F.lit(1)).alias("__n")
    )
    ranges = ranges.withColumn("__bins", F.ceil(F.log2("__n") + 1))
    ranges = round_breaks(ranges, "__lo", "__hi", "__bins").select(*group, "unit", "first", "last")
    placed = join_on_keys(rows, ranges, keys)
    # a value a hair above a break still belongs to the bin that ends there
    spot = F.ceil((F.col("__v") - BIN_SLACK * F.col("unit")) / F.col("unit") - F.col("first"))
    counts = placed.groupBy(*group, F.greatest(spot, F.lit(1)).alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    frame = ranges.select(
        *group, "unit", "first", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("last") - F.col("first"))).alias("bin")
    )
    full = join_on_keys(frame, counts, [*keys, "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    most = F.max("count").over(Window.partitionBy(*group))
    return full.select(
        *group,
        "bin",
        ((F.col("first") + F.col("bin") - 1) * F.col("unit")).alias("left"),
        ((F.col("first") + F.col("bin")) * F.col("unit")).alias("right"),
        "count",
        F.when(most > 0, F.col("count") / most).otherwise(F.lit(0.0)).alias("scaled"),
    )


# --- densities -------------------------------------------------------------------------------


def prior_and_posterior(posterior: Posterior, prior: AbcInput | None = None) -> DataFrame:
    """Long table (type, parameter, value) of posterior values and, if given, prior ones."""
    out = to_long(posterior.values(), [], posterior.params).withColumn("type", F.lit("Posterior"))
    if prior is None:
        return out
    if len(prior.params) != len(posterior.params):
        warnings.warn("the prior has another number of parameters and is left out", stacklevel=2)
        return out
    renamed = prior.df.select(
        *[named(a).alias(b) for a, b in zip(prior.params, posterior.params, strict=True)]
    )
    before = to_long(renamed, [], posterior.params).withColumn("type", F.lit("Prior"))
    return out.unionByName(before)


# Fixed values of the normal-reference bandwidth, and how many bandwidths the cells reach beyond the grid.
BANDWIDTH_FACTOR = 0.9
BANDWIDTH_IQR = 1.34
MARGIN = 4.0


def density_curves(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    panel: Sequence[str] = (),
    points: int = 512,
    block_rows: int | None = None,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Gaussian kernel density of the finite values of each group on an even grid.

    Groups that share the ``panel`` keys (a subset of ``keys``; all of them by default) share a grid over
    their joint range. Groups of fewer than two values have no curve. Each value is split linearly between
    the two nearest of ``points`` cells, which reach four bandwidths beyond the grid; the kernel is summed
    over the cells and read off between them. What a group brings to that sum is its cells, however many
    rows it has. One pass takes the moments and quartiles, another fills the cells; ``sizes`` of the groups
    saves counting them first.
    """
    keys = list(keys)
    panel = [k for k in keys if k in panel] or keys
    group = [named(k) for k in keys]
    rows = df.where(is_finite(value)).select(*group, named(value).cast("double").alias("__v"))
    # one row per group, read by both sides below: written, so that the input is not read again for it
    curves = materialise(_bandwidths(rows, keys, panel, points, block_rows, sizes))
    low, delta = F.col("__low"), F.col("__delta")
    last = F.lit(points - 1)
    placed = join_on_keys(rows, curves.select(*group, "__low", "__delta"), keys)
    # without a range every value lies on the cell at its left
    spot = F.when(delta > 0, (F.col("__v") - low) / delta).otherwise(F.lit(0.0))
    placed = placed.withColumn("__at", F.least(F.floor(spot), last - 1).cast("int"))
    share = spot - F.col("__at")
    pair = F.array(
        F.struct(F.col("__at").alias("cell"), (1 - share).alias("mass")),
        F.struct((F.col("__at") + 1).alias("cell"), share.alias("mass")),
    )
    split = placed.select(*group, F.explode(pair).alias("part")).select(*group, "part.*")
    cells = split.groupBy(*group, "cell").agg(F.sum("mass").alias("mass"))
    # at most `points` cells of a group, so the array is bounded
    masses = cells.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("cell", "mass"))).alias("__cells"))
    full = join_on_keys(curves, masses, keys)

    def curve(at: Column) -> Column:
        """Density at a cell, from the masses of all cells."""
        z = lambda cell: (at - cell["cell"]) * delta / F.col("bandwidth")
        return F.aggregate(
            "__cells", F.lit(0.0), lambda total, c: total + c["mass"] * F.exp(z(c) * z(c) * -0.5)
        ) / (F.col("__n") * F.col("bandwidth") * math.sqrt(2 * math.pi))

    numbers = F.sequence(F.lit(0), last)
    full = full.withColumn("__curve", F.transform(numbers, lambda i: curve(i)))
    out = full.select(
        *group, "__from", "__step", "__low", "__delta", "__curve", "bandwidth", F.explode(numbers).alias("point")
    )
    x = F.col("__from") + F.col("point") * F.col("__step")
    at = F.when(delta > 0, (x - low) / delta).otherwise(F.lit(0.0))
    left = F.least(F.floor(at), last - 1).cast("int")
    between = at - left
    height = F.get("__curve", left) * (1 - between) + F.get("__curve", left + 1) * between
    return out.select(*group, "point", x.alias("x"), height.alias("density"), "bandwidth")


def _bandwidths(
    rows: DataFrame,
    keys: Sequence[str],
    panel: Sequence[str],
    points: int,
    block_rows: int | None,
    sizes: GroupSizes | None,
) -> DataFrame:
    """Per group of two values or more: count, grid, bandwidth and cells."""
    group = [named(k) for k in keys]
    sizes = sizes or group_sizes(rows, keys)
    moments = [
        F.count(F.lit(1)).alias("__n"),
        F.stddev_samp("__v").alias("__sd"),
        F.min("__v").alias("__min"),
        F.max("__v").alias("__max"),
    ]
    quarters = [0.25, 0.75]
    if sizes.beyond(block_rows):
        quartiles = group_quantiles(rows, keys, "__v", quarters, block_rows, sizes).drop("n")
        described = join_on_keys(rows.groupBy(*group).agg(*moments), quartiles, keys)
    else:
        described = rows.groupBy(*group).agg(*moments, F.percentile("__v", F.array(*map(F.lit, quarters))).alias("q"))
    edge = Window.partitionBy(*[named(k) for k in panel])
    curves = described.select(
        *group,
        "__n",
        "__sd",
        "__min",
        ((F.get("q", F.lit(1)) - F.get("q", F.lit(0))) / BANDWIDTH_IQR).alias("__iqr"),
        F.min("__min").over(edge).alias("__from"),
        F.max("__max").over(edge).alias("__to"),
    )
    spread = F.least("__sd", "__iqr")
    spread = F.when(spread > 0, spread).when(F.col("__sd") > 0, F.col("__sd"))
    spread = F.coalesce(spread, F.when(F.col("__min") != 0, F.abs("__min")), F.lit(1.0))
    curves = curves.where("__n >= 2").select(
        *group,
        "__n",
        "__from",
        "__to",
        ((F.col("__to") - F.col("__from")) / (points - 1)).alias("__step"),
        (BANDWIDTH_FACTOR * spread * F.pow(F.col("__n").cast("double"), F.lit(-0.2))).alias("bandwidth"),
    )
    low = F.col("__from") - MARGIN * F.col("bandwidth")
    high = F.col("__to") + MARGIN * F.col("bandwidth")
    return curves.withColumns({"__low": low, "__delta": (high - low) / (points - 1)}).drop("__to")
