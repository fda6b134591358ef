"""Lognormal trimming of response times per group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialkit.functions.columns import named, require_columns, valid_time, with_normal_cdf
from trialkit.operators.blocks import BLOCK_ROWS, GroupSizes, group_sizes
from trialkit.operators.joins import join_on_keys, solid_keys
from trialkit.operators.selection import next_shift, ordered_bits, select_quantiles
from trialkit.sources.checkpoints import materialise

# Trim grid 0, 0.01, …, 0.20 and the penalty per unit of trim.
DEFAULT_TRIMS = tuple(i / 100 for i in range(21))
DEFAULT_PENALTY = 0.02

GROUP = ("condition_idx", "rank_idx")

#: What belongs to a fit.
FIT = ("trim", "mu_hat", "sigma_hat", "n_used", "q_upper")
#: Low bits of a time left out of account where the distance is bounded, round by round.
BOUND_SHIFTS = (48, 40, 24, 0)
#: Rows of a cell that are told apart by all bits at once: they make no more cells than the first rounds do.
CELL_ROWS = 2**8
#: Bounds of cells are this much wider, as the normal distribution function has rounding errors.
SLACK = 1e-12


def trim_cells(
    df: DataFrame,
    trims: Sequence[float] = DEFAULT_TRIMS,
    penalty: float = DEFAULT_PENALTY,
    keys: Sequence[str] = GROUP,
    rt: str = "rt",
    block_rows: int | None = None,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Lognormal fit and Kolmogorov–Smirnov distance for every group and trim.

    The times of a group are ordered once. Every trim keeps a prefix of that order, so the position of a
    time in the group is also its position among the kept ones, and no trim sorts again. Groups that fit
    a task take one shuffle in all. Bigger ones are not put in order: their cuts are found by selection and the
    distance by bounds over cells of times, so what is shuffled are counts and sums.
    """
    require_columns(df, [*keys, rt])
    times = df.where(valid_time(rt)).select(*[named(k) for k in keys], named(rt).cast("double").alias("__x"))
    sizes = sizes or group_sizes(times, keys)
    if not sizes.beyond(block_rows):
        keys, back = list(keys), [named(k) for k in keys]
        cells = _cells_in_windows(times, trims, keys)
    else:
        times, keys, back = solid_keys(times, keys)
        limit = BLOCK_ROWS if block_rows is None else block_rows
        counts = times.groupBy(*[named(k) for k in keys]).agg(F.count(F.lit(1)).alias("__n"))
        counts = materialise(counts)
        n_few, n_big = counts.agg(F.count_if(F.col("__n") <= limit), F.count_if(F.col("__n") > limit)).first()
        if not n_few:
            cells = _cells_by_bounds(times, trims, keys)
        else:
            # the fewer groups tell the two kinds apart: written by themselves they are seen to be few, and the rows
            # need not be shuffled to meet them
            fewer = materialise(counts.where(F.col("__n") <= limit if n_few <= n_big else F.col("__n") > limit).drop("__n"))
            small, large = ("inner", "left_anti") if n_few <= n_big else ("left_anti", "inner")
            cells = _cells_by_bounds(join_on_keys(times, fewer, keys, large), trims, keys)
            cells = cells.unionByName(_cells_in_windows(join_on_keys(times, fewer, keys, small), trims, keys))
    return cells.select(
        *back,
        "trim",
        "mu_hat",
        "sigma_hat",
        "ks_statistic",
        "n_used",
        F.lit(0.0).alias("q_lower"),
        "q_upper",
        (F.col("ks_statistic") + F.lit(float(penalty)) * F.col("trim")).alias("score"),
    )


def _cells_in_windows(times: DataFrame, trims: Sequence[float], keys: list[str]) -> DataFrame:
    """One row per group and trim, for groups that fit a task: every row against every trim that keeps it."""
    rows = _fitted_in_windows(times, trims, keys)
    rows = rows.select(*[named(k) for k in keys], "__x", "__le", "__w", F.explode("fits").alias("fit"))
    rows = rows.select(*[named(k) for k in keys], "__x", "__le", "__w", "fit.*").where(F.col("__x") < F.col("q_upper"))
    rows = _with_cdf(rows, "__x", "__cdf")
    n = F.col("n_used")
    # equal times share one CDF value: the widest gaps sit at the first and the last of them
    gap = F.greatest(F.col("__cdf") - (F.col("__le") - F.col("__w")) / n, F.col("__le") / n - F.col("__cdf"))
    # the fit is the same on all rows of a cell, so it travels as a maximum
    return rows.groupBy(*[named(k) for k in keys], "trim").agg(
        F.max(F.when(F.col("sigma_hat") > 0, gap)).alias("ks_statistic"),
        *[F.max(c).alias(c) for c in FIT[1:]],
    )


def _with_cdf(rows: DataFrame, x: str, out: str) -> DataFrame:
    rows = rows.withColumn("__z", F.try_divide(F.log(x) - F.col("mu_hat"), F.col("sigma_hat")))
    return with_normal_cdf(rows, "__z", out).drop("__z")


def _probabilities(trims: Sequence[float]) -> list[float]:
    # 100·(1 − trim) is whole for the usual grid; dividing last keeps the probability exact
    return [round(100 - 100 * t, 9) / 100 for t in trims]


def _grid(trims: Sequence[float], cuts: str) -> Column:
    return F.array(
        *[
            F.struct(F.lit(float(t)).alias("trim"), F.get(cuts, F.lit(i)).alias("q_upper"))
            for i, t in enumerate(trims)
        ]
    )


def _mean_and_sd(centre: Column, n: Column, s1: Column, s2: Column, low: Column, high: Column) -> list[Column]:
    """Mean and sample sd from sums of (value − centre) and of its square."""
    spread = F.sqrt(F.greatest(s2 - s1 * s1 / n, F.lit(0.0)) / (n - 1))
    return [
        (centre + s1 / n).alias("mu_hat"),
        # one repeated time has no spread, whatever the rounding of the sums says
        F.when(low == high, F.lit(0.0)).otherwise(spread).alias("sigma_hat"),
    ]


def _fitted_in_windows(times: DataFrame, trims: Sequence[float], keys: list[str]) -> DataFrame:
    """Rows with their position and the fits of their group, all on one partitioning and one sort.

    Running sums are read off at the last row below each cut; those rows, at most one per trim, carry
    the fits, and a window over the group hands them to all of its rows.
    """
    window = Window.partitionBy(*[named(k) for k in keys]).orderBy("__x")
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    probs = F.array(*[F.lit(p) for p in _probabilities(trims)])
    rows = times.withColumns(
        {
            "__le": F.row_number().over(window).cast("bigint"),
            "__next": F.lead("__x").over(window),
            "__low": F.first("__x").over(whole),
            "__q": F.percentile("__x", probs).over(whole),
        }
    )
    # logs relative to the group's lowest time keep the running squares small
    rows = rows.withColumn("__y", F.log("__x") - F.log("__low"))
    rows = rows.withColumns({"__s1": F.sum("__y").over(upto), "__s2": F.sum(F.col("__y") * F.col("__y")).over(upto)})
    ends = [
        (F.col("__x") < F.get("__q", F.lit(i))) & (F.col("__next").isNull() | (F.get("__q", F.lit(i)) <= F.col("__next")))
        for i in range(len(trims))
    ]
    n = F.col("__le")
    moments = _mean_and_sd(F.log("__low"), n, F.col("__s1"), F.col("__s2"), F.col("__low"), F.col("__x"))
    entries = [
        F.when(
            end & (n >= 2),
            F.struct(F.lit(float(t)).alias("trim"), *moments, n.alias("n_used"), F.get("__q", F.lit(i)).alias("q_upper")),
        )
        for i, (t, end) in enumerate(zip(trims, ends, strict=True))
    ]
    here = F.when(reduce(lambda a, b: a | b, ends), F.array_compact(F.array(*entries)))
    rows = rows.withColumn("__here", here)
    return rows.select(
        *[named(k) for k in keys],
        "__x",
        "__le",
        F.lit(1).cast("bigint").alias("__w"),
        F.flatten(F.collect_list("__here").over(whole)).alias("fits"),
    )


def _cells_by_bounds(times: DataFrame, trims: Sequence[float], keys: list[str]) -> DataFrame:
    """One row per group and trim, for groups of any size: branch and bound over cells of times.

    Cuts are found by selection. Times are counted by group, band between cuts and leading bits, which combines
    before the shuffle; from the sums of these cells follow the fits, and from the counts below a cell and the
    distribution function at its ends how wide the gap in it can be at most, and is at least. Cells that cannot hold
    the widest gap are done. The others are counted again by more bits, until none is left: a cell of one time has
    its gap. What is exploded by trims are cells, never rows.
    """
    group = [named(k) for k in keys]
    cuts = select_quantiles(times, keys, "__x", _probabilities(trims))
    cuts = materialise(cuts.select(*group, "q", F.log(F.array_min("q")).alias("centre"), F.array_max("q").alias("top")))
    # cuts above a time; as an array function, since code for each of them would grow beyond what the JVM compiles
    band = F.size(F.filter("q", lambda cut: F.col("__x") < cut))
    base = times.withColumn("__bits", ordered_bits("__x"))
    rows = join_on_keys(base, cuts, keys).where(F.col("__x") < F.col("top"))
    rows = rows.select(*group, "__x", "__bits", band.alias("band"), (F.log("__x") - F.col("centre")).alias("y"))
    y = F.col("y")
    first = rows.groupBy(*group, "band", F.shiftright("__bits", BOUND_SHIFTS[0]).alias("__cell")).agg(
        F.count(F.lit(1)).alias("s0"),
        F.sum(y).alias("s1"),
        F.sum(y * y).alias("s2"),
        F.min("__x").alias("low"),
        F.max("__x").alias("high"),
    )
    first = materialise(first)
    upto = Window.partitionBy(*group).orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    cells = first.withColumn("before", F.coalesce(F.sum("s0").over(upto), F.lit(0)))
    fits = materialise(_best(join_on_keys(cells, _fits(first, cuts, trims, keys), keys), keys))
    # cells meet the best of all cells before they are listed, so the lists are of the few that can beat it
    known = fits.groupBy(*group).agg(F.collect_list(F.struct(*FIT, "best")).alias("fits"))
    state = materialise(_opened(fits, _held(join_on_keys(cells, known, keys), keys), keys))
    done = BOUND_SHIFTS[0]
    while done:
        left = state.select(*group, F.struct(*FIT, "best").alias("fit"), F.explode("open").alias("cell"))
        left = left.select(*group, "fit", "cell.*")
        most = left.agg(F.max("s0")).first()[0]
        if most is None:
            break
        shift = next_shift(BOUND_SHIFTS, done, most, CELL_ROWS)
        within = [*keys, "band", "__cell"]
        asked = left.groupBy(*[named(k) for k in within]).agg(
            F.max("before").alias("start"),
            F.min("low").alias("from"),
            F.max("high").alias("to"),
            F.collect_list("fit").alias("fits"),
        )
        asked = materialise(asked)
        # the bands of a cell lie side by side, so the ends of an open one tell its rows
        held = asked.select(*[named(k) for k in within], "from", "to")
        rows = join_on_keys(base.withColumn("__cell", F.shiftright("__bits", done)), held, [*keys, "__cell"])
        rows = rows.where(F.col("__x").between(F.col("from"), F.col("to")))
        parts = rows.groupBy(*[named(k) for k in within], F.shiftright("__bits", shift).alias("part")).agg(
            F.count(F.lit(1)).alias("s0"), F.min("__x").alias("low"), F.max("__x").alias("high")
        )
        upto = Window.partitionBy(*[named(k) for k in within]).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("inside", F.coalesce(F.sum("s0").over(upto), F.lit(0)))
        parts = join_on_keys(parts, asked.drop("from", "to"), within)
        cells = parts.withColumn("before", F.col("start") + F.col("inside")).withColumn("__cell", F.col("part"))
        cells = cells.select(*group, "band", "__cell", "low", "high", "s0", "before", "fits")
        more = materialise(_best(cells, keys).select(*group, "trim", F.col("best").alias("more")))
        fits = join_on_keys(state.drop("open"), more, [*keys, "trim"], "left")
        fits = fits.withColumn("best", F.greatest("best", "more")).drop("more")
        if not shift:
            return fits.select(*group, F.col("best").alias("ks_statistic"), *FIT)
        state = materialise(_opened(fits, _held(cells, keys), keys))
        done = shift
    return state.select(*group, F.col("best").alias("ks_statistic"), *FIT)


def _against(cells: DataFrame) -> DataFrame:
    """Every cell against each of its fits."""
    rows = cells.select(*[c for c in cells.columns if c != "fits"], F.explode("fits").alias("fit"))
    return rows.select("*", "fit.*").drop("fit").where(F.col("high") < F.col("q_upper"))


def _best(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Per group and trim: the fit and the widest gap at the ends of the cells, ``best``.

    One row at least lies at each end, and what is before and after it in the cell is known. The ends are rows, since
    code with the distribution function twice in an aggregate grows beyond what the JVM compiles.
    """
    before, upto = F.col("before"), F.col("before") + F.col("s0")
    ends = [(F.col("low"), before, before + 1), (F.col("high"), upto - 1, upto)]
    listed = F.array(*[F.struct(x.alias("at"), a.alias("below"), b.alias("upto")) for x, a, b in ends])
    rows = cells.select(*[named(k) for k in keys], "high", F.explode(listed).alias("end"), "fits")
    rows = _with_cdf(_against(rows.select(*[named(k) for k in keys], "high", "end.*", "fits")), "at", "__f")
    n = F.col("n_used")
    gap = F.greatest(F.col("__f") - F.col("below") / n, F.col("upto") / n - F.col("__f"))
    fit = [F.max(c).alias(c) for c in FIT[1:]]
    gap = F.max(F.when(F.col("sigma_hat") > 0, gap)).alias("best")
    return rows.groupBy(*[named(k) for k in keys], "trim").agg(*fit, gap)


def _held(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells whose inner rows, if there are any, may have a wider gap than the ``best`` of a trim; ``most`` bounds it."""
    inner = cells.where((F.col("low") < F.col("high")) & (F.col("s0") > 2))
    rows = _with_cdf(_with_cdf(_against(inner), "low", "__f_low"), "high", "__f_high")
    n, upto = F.col("n_used"), F.col("before") + F.col("s0")
    most = F.greatest(F.col("__f_high") - (F.col("before") + 1) / n, (upto - 1) / n - F.col("__f_low")) + SLACK
    rows = rows.withColumn("most", F.when(F.col("sigma_hat") > 0, most))
    cell = F.struct("band", "__cell", "before", "s0", "low", "high", "most", "best")
    # an element of an array: a condition on it is not worked out a second time, below
    rows = rows.select(*[named(k) for k in keys], "trim", F.explode(F.array(cell)).alias("cell"))
    return rows.where(F.col("cell.most") > F.col("cell.best"))


def _opened(fits: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``fits`` with the ``open`` cells, those among ``rows`` that may hold a wider gap than the best."""
    # a few dozen cells for each doubling of the time
    listed = rows.groupBy(*[named(k) for k in keys], "trim").agg(F.collect_list(F.col("cell").dropFields("best")).alias("open"))
    out = join_on_keys(fits, listed, [*keys, "trim"], "left")
    none = F.array().cast(listed.schema["open"].dataType)
    out = out.withColumn("open", F.coalesce("open", none))
    return out.withColumn("open", F.filter("open", lambda c: c["most"] > F.col("best")))


def _fits(bands: DataFrame, cuts: DataFrame, trims: Sequence[float], keys: list[str]) -> DataFrame:
    """Per group, the array of usable fits: trim, cut, rows kept, mean and sd of log time.

    ``bands`` holds sums of rows between two cuts, in any number of pieces; the sums of a trim are those below its
    cut. Log times are taken relative to the log of the group's lowest cut, which keeps the squares small and makes
    the sums safe to subtract.
    """
    group = [named(k) for k in keys]
    sums = [F.sum(c).alias(c) for c in ("s0", "s1", "s2")]
    ends = [F.min("low").alias("low"), F.max("high").alias("high")]
    # a group has few bands: by group, they need not move again once they are held against the cuts
    bands = bands.groupBy(*group, "band").agg(*sums, *ends).repartition(*group)
    placed = cuts.select(*group, "centre", _grid(trims, "q").alias("grid"))
    cells = (
        join_on_keys(bands, placed, keys)
        .select(*group, "centre", "s0", "s1", "s2", "low", "high", F.explode("grid").alias("cell"))
        .where(F.col("high") < F.col("cell.q_upper"))
        .groupBy(*group, F.col("cell.trim").alias("trim"))
        .agg(F.max("cell.q_upper").alias("q_upper"), F.max("centre").alias("centre"), *sums, *ends)
        .withColumnRenamed("s0", "n_used")
        .where("n_used >= 2")
    )
    moments = _mean_and_sd(*[F.col(c) for c in ("centre", "n_used", "s1", "s2", "low", "high")])
    fit = F.struct("trim", *moments, "n_used", "q_upper")
    # at most one entry per trim of the grid
    return cells.groupBy(*group).agg(F.collect_list(fit).alias("fits"))


def trim_thresholds(
    df: DataFrame,
    trims: Sequence[float] = DEFAULT_TRIMS,
    penalty: float = DEFAULT_PENALTY,
    keys: Sequence[str] = GROUP,
    rt: str = "rt",
    block_rows: int | None = None,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """The trim with the lowest score per group; the smaller trim wins a tie, missing scores lose."""
    cells = trim_cells(df, trims, penalty, keys, rt, block_rows, sizes)
    rank = F.struct(F.col("score").isNull(), "score", "trim")
    rest = [c for c in cells.columns if c not in keys]
    best = cells.groupBy(*[named(k) for k in keys]).agg(F.min_by(F.struct(*rest), rank).alias("best"))
    return best.select(*[named(k) for k in keys], "best.*")


def apply_trim(
    df: DataFrame, thresholds: DataFrame, min_n_used: int = 0, keys: Sequence[str] = GROUP, rt: str = "rt"
) -> DataFrame:
    """Rows within the bounds of their group, both ends included; groups without bounds vanish.

    Works on a streaming ``df`` with a static threshold table too.
    """
    require_columns(df, [*keys, rt])
    require_columns(thresholds, [*keys, "trim", "q_lower", "q_upper", "n_used"])
    bounds = thresholds.where(F.col("n_used") >= min_n_used)
    bounds = bounds.select(*[named(k) for k in keys], "trim", "q_lower", "q_upper")
    joined = join_on_keys(df, bounds, keys)
    kept = joined.where(named(rt).between(F.col("q_lower"), F.col("q_upper")))
    added = ["trim", "q_lower", "q_upper"]
    return kept.select(*[named(c) for c in [*keys, *added, *[c for c in df.columns if c not in keys]]])
