"""Tables for likelihood-free inference: aligned input, nearest-sample rejection, local-linear
adjustment and cross-validation."""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialkit.functions.columns import doubles, is_missing, named, require_columns, uniform
from trialkit.operators.blocks import (
    GroupSizes,
    group_quantiles,
    join_on_keys,
    order_statistics,
    row_numbers,
)
from trialkit.operators.neighbours import candidate_pairs, cut_cells, distance_cell
from trialkit.operators.nest import to_long
from trialkit.operators.summarise import SummaryTable
from trialkit.sources.checkpoints import materialise
from trialkit.sources.results import ResultSet

#: Held-out conditions from which an index of the others pays.
PRUNED_TARGETS = 50
# Fixed value: scales a median absolute deviation to the standard deviation of a normal variable.
MAD_SCALE = 1.4826


@dataclass(frozen=True)
class AbcInput:
    """One row per condition with its parameters and statistics, and the target statistics."""

    df: DataFrame
    target: Mapping[str, float | None]
    params: tuple[str, ...]
    stats: tuple[str, ...]
    key: str = "condition_idx"

    def complete(self) -> DataFrame:
        """Conditions that have every statistic."""
        return self.df.where(reduce(lambda a, b: a & b, [~is_missing(s) for s in self.stats]))


@dataclass(frozen=True)
class Posterior:
    """Accepted conditions; ``adjusted`` maps a parameter to its adjusted column, if there is one."""

    df: DataFrame
    params: tuple[str, ...]
    adjusted: Mapping[str, str] | None = None

    def values(self) -> DataFrame:
        """Adjusted values where there are any, raw ones otherwise, under the parameter names."""
        source = self.adjusted or {p: p for p in self.params}
        return self.df.select(*[named(source[p]).alias(p) for p in self.params])


# --- input -----------------------------------------------------------------------------------


def condition_params(df: DataFrame, params: Sequence[str], condition: str = "condition_idx") -> DataFrame:
    """One row per condition; a parameter that varies is taken from the first response."""
    order = [named(c) for c in ("trial_idx", "rank_idx") if c in df.columns]
    values = F.struct(*[named(p) for p in params])
    # with nothing to order by, the smallest combination of values is as good as any and repeatable
    first = F.min_by(values, F.struct(*order, values))
    return df.groupBy(named(condition)).agg(first.alias("__first")).select(named(condition), "__first.*")


def _summary(table: SummaryTable | DataFrame, condition: str, what: str) -> tuple[DataFrame, tuple[str, ...]]:
    if isinstance(table, SummaryTable):
        return table.df, table.key
    if not isinstance(table, DataFrame):
        raise TypeError(f"{what} must be a summary table or a DataFrame")
    warnings.warn(f"{what} names no key; taking {condition!r} as its key", stacklevel=3)
    return table, (condition,)


def _given_params(table: DataFrame, params: Sequence[str], condition: str, required: bool) -> DataFrame | None:
    """The parameters from a table of conditions; NULL if it lacks some and need not have them."""
    if required:
        require_columns(table, [condition, *params])
    elif any(c not in table.columns for c in (condition, *params)):
        return None
    return table.select(named(condition), *[named(p) for p in params])


def build_abc_input(
    results: ResultSet | DataFrame,
    summary: SummaryTable | DataFrame,
    target: SummaryTable | DataFrame,
    params: Sequence[str],
    condition: str = "condition_idx",
    conditions: DataFrame | None = None,
) -> AbcInput:
    """Line up the parameters and the statistics of the conditions present in both tables.

    The statistics are all columns of ``summary`` outside its key. Of ``target`` the first row by key
    counts. The parameters come from ``conditions``, one row per condition, or from a result set's own table
    of conditions, if it holds them; otherwise they are taken from the responses.
    """
    params = tuple(params)
    if not params:
        raise ValueError("name at least one parameter")
    given = conditions
    if given is None and isinstance(results, ResultSet):
        given = results.conditions()
    given = None if given is None else _given_params(given, params, condition, conditions is not None)
    if given is None:
        rows = results.dataset() if isinstance(results, ResultSet) else results
        require_columns(rows, [condition, *params])
        given = condition_params(rows, params, condition)
    table, key = _summary(summary, condition, "summary")
    require_columns(table, [condition])
    stats = tuple(c for c in table.columns if c not in key)
    if not stats:
        raise ValueError(f"no statistics: all columns ({', '.join(table.columns)}) belong to the key")
    clash = set(stats) & set(params)
    if clash:
        raise ValueError(f"parameters and statistics share names: {', '.join(sorted(clash))}")
    if not (isinstance(summary, SummaryTable) and tuple(key) == (condition,)):
        # a summary made here has one row per key; others are looked at
        twice = table.groupBy(named(condition)).count().where("count > 1")
        if not twice.isEmpty():
            raise ValueError(f"summary has several rows for one {condition}")

    goal, goal_key = _summary(target, condition, "target")
    goal_stats = [c for c in goal.columns if c not in goal_key]
    missing = [s for s in stats if s not in goal_stats]
    extra = [s for s in goal_stats if s not in stats]
    if missing:
        raise ValueError(f"target lacks statistics: {', '.join(missing)}")
    if extra:
        warnings.warn(f"target has further columns, which are left out: {', '.join(extra)}", stacklevel=2)
    order = [named(k) for k in goal_key if k in goal.columns]
    first = goal.orderBy(*order) if order else goal
    values = first.select(*doubles(first, stats)).limit(1).collect()
    if not values:
        raise ValueError("target has no row")

    chosen = table.select(named(condition), *doubles(table, stats))
    aligned = join_on_keys(given, chosen, [condition])
    # One row per condition from here on. Every fit reads it several times, so it is written once rather
    # than summarised from the responses again by each job.
    return AbcInput(materialise(aligned), dict(zip(stats, values[0], strict=True)), params, stats, condition)


# --- rejection -------------------------------------------------------------------------------


def _medians(df: DataFrame, columns: Sequence[str], n: int, block_rows: int | None) -> dict[str, float]:
    """Median of each column; one number per column comes back."""
    sizes = GroupSizes(n * len(columns), n)
    if not sizes.beyond(block_rows):
        row = df.agg(*[F.percentile(named(c), F.lit(0.5)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
        return dict(zip(columns, row, strict=True))
    long = to_long(df, [], columns, "name", "value")
    rows = group_quantiles(long, ["name"], "value", [0.5], block_rows, sizes).collect()
    return {r["name"]: r["q"][0] for r in rows}


def scales(df: DataFrame, stats: Sequence[str], n: int, block_rows: int | None = None) -> dict[str, float]:
    """What to divide each statistic of the ``n`` rows by: its scaled MAD, or 1 where that is zero."""
    centre = _medians(df, stats, n, block_rows)
    away = df.select(*[F.abs(named(s) - F.lit(centre[s])).alias(s) for s in stats])
    mads = _medians(away, stats, n, block_rows)
    return {s: (MAD_SCALE * m if m else 1.0) for s, m in mads.items()}


def distance(target: Mapping[str, float], scale: Mapping[str, float]) -> Column:
    """Euclidean distance to the target over scaled statistics."""
    terms = [F.pow((named(s) - F.lit(target[s])) / F.lit(scale[s]), F.lit(2.0)) for s in target]
    return F.sqrt(reduce(lambda a, b: a + b, terms))


def _nearest(measured: DataFrame, keys: Sequence[str], distance_column: str, wanted: int) -> DataFrame:
    """Rows that can be among the ``wanted`` nearest of their group: all up to the cell with the last one.

    Distances are counted in cells of a log scale, which combines before the shuffle; only what is below
    the cut is ever put in order. Ties are in one cell, so none is lost.
    """
    cuts = cut_cells(measured, keys, distance_column, wanted)
    placed = measured.withColumn("__cell", distance_cell(named(distance_column)))
    return join_on_keys(placed, cuts, keys).where("__cell <= __cut").drop("__cell", "__cut")


@dataclass(frozen=True)
class _Accepted:
    df: DataFrame
    scale: Mapping[str, float]


def _accept(data: AbcInput, tol: float, block_rows: int | None) -> _Accepted:
    if not 0 < tol <= 1:
        raise ValueError("the tolerance must lie in (0, 1]")
    absent = [s for s, v in data.target.items() if v is None or math.isnan(v)]
    if absent:
        raise ValueError(f"target lacks values: {', '.join(absent)}")
    complete = data.complete()
    # incomplete conditions count towards the number to accept but are never accepted
    total, usable = data.df.agg(
        F.count(F.lit(1)),
        F.count_if(reduce(lambda a, b: a & b, [~is_missing(s) for s in data.stats])),
    ).first()
    if usable == 0:
        raise ValueError("no condition has all statistics")
    scale = scales(complete, data.stats, usable, block_rows)
    measured = complete.withColumn("distance", distance(data.target, scale))
    wanted = min(math.ceil(total * tol), usable)
    # Few rows beyond the accepted ones remain below the cut. They are written down: fits and reports all
    # start here, and the optimizer would otherwise carry the distance, an equation over all statistics,
    # through every later projection of them.
    near = materialise(_nearest(measured, [], "distance", wanted))
    placed = row_numbers(near, [], ["distance", data.key], "__place", block_rows)
    return _Accepted(placed.where(F.col("__place") <= wanted).drop("__place"), scale)


def abc_rejection(data: AbcInput, tol: float, block_rows: int | None = None) -> Posterior:
    """Keep the ``ceil(n · tol)`` conditions nearest to the target; ties go to the lower condition."""
    return Posterior(_accept(data, tol, block_rows).df, data.params)


# --- local-linear adjustment -----------------------------------------------------------------


def _solve(gram: np.ndarray, moment: np.ndarray) -> np.ndarray:
    """Least-squares coefficients from the sums of products; columns are put on one scale first."""
    size = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    scaled = gram / np.outer(size, size)
    return (np.linalg.pinv(scaled, rcond=1e-12, hermitian=True) @ (moment / size[:, None])) / size[:, None]


#: Up to this many columns their products are summed as expressions; more would outgrow generated code.
PRODUCT_COLUMNS = 12


def _moments(df: DataFrame, vector: str, weight: str, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Weighted sums of products of the elements of an array column, their plain sums, and the row count.

    What reaches the driver has the size of the array squared, whatever the number of rows.
    """
    if size <= PRODUCT_COLUMNS:
        z = [F.get(F.col(vector), F.lit(i)) for i in range(size)]
        products = [F.sum(F.col(weight) * z[i] * z[j]) for i in range(size) for j in range(i + 1)]
        row = df.agg(*products, *[F.sum(c) for c in z], F.count(F.lit(1))).first()
        gram = np.zeros((size, size))
        gram[np.tril_indices(size)] = np.array(row[: len(products)], dtype=float)
        gram = gram + np.tril(gram, -1).T
        return gram, np.array(row[len(products) : -1], dtype=float), row[-1]

    def partial(batches):
        total = np.zeros(size * size + size + 1)
        for rows in batches:
            if len(rows):
                z = np.stack(rows[vector].to_numpy())
                w = rows[weight].to_numpy(dtype=float)
                total += np.concatenate([((z * w[:, None]).T @ z).ravel(), z.sum(axis=0), [len(rows)]])
        yield pd.DataFrame({"sums": [total.tolist()]})

    # one array per task, added up element by element
    spread = df.select(vector, weight).mapInPandas(partial, "sums array<double>")
    spread = spread.select(F.posexplode("sums").alias("spot", "part"))
    sums = spread.groupBy("spot").agg(F.sum("part").alias("part")).orderBy("spot").collect()
    flat = np.array([r["part"] for r in sums])
    return flat[: size * size].reshape(size, size), flat[size * size : -1], int(flat[-1])


def _dot(vector: str, coefficients: np.ndarray) -> Column:
    """Product of an array column and fixed coefficients, as one expression over one column."""
    terms = F.zip_with(F.col(vector), F.array(*[F.lit(float(c)) for c in coefficients]), lambda a, b: a * b)
    return F.aggregate(terms, F.lit(0.0), lambda total, term: total + term)


def abc_local_linear(
    data: AbcInput,
    tol: float,
    transforms: Mapping[str, str] | Sequence[str] | None = None,
    heteroscedastic: bool = True,
    block_rows: int | None = None,
) -> Posterior:
    """Rejection, then a weighted linear regression of the parameters on the statistics.

    Accepted conditions weigh ``1 − (d / d_max)²``. An adjusted value is the prediction at the target plus
    the residual; with ``heteroscedastic`` the residual is rescaled by a second regression, of its log
    square. ``transforms`` gives ``log`` or ``none`` per parameter. Only sums of products, of the size of
    the number of statistics squared, reach the driver.
    """
    if transforms is None:
        transforms = {}
    elif not isinstance(transforms, Mapping):
        transforms = dict(zip(data.params, transforms, strict=True))
    unknown = set(transforms.values()) - {"log", "none"}
    if unknown:
        raise ValueError(f"unknown transforms: {', '.join(sorted(unknown))}")
    accepted = _accept(data, tol, block_rows)
    kept = accepted.df

    logged = [p for p in data.params if transforms.get(p, "none") == "log"]
    bounds = kept.agg(
        F.max("distance").alias("d_max"),
        *[F.min(F.when(named(p) > 0, named(p))).alias(f"floor_{i}") for i, p in enumerate(logged)],
    ).first()
    floors = {p: bounds[f"floor_{i}"] for i, p in enumerate(logged)}
    for p in logged:
        if floors[p] is None:
            raise ValueError(f"no positive value of {p} to take the log of")

    def moved(p: str) -> Column:
        value = named(p).cast("double")
        # values at or below zero have no log; they take the smallest positive value
        return F.log(F.when(value > 0, value).otherwise(F.lit(floors[p]))) if p in floors else value

    y = [moved(p) for p in data.params]
    d_max = bounds["d_max"]
    weight = 1.0 - F.pow(F.col("distance") / F.lit(d_max), F.lit(2.0)) if d_max else F.lit(1.0)
    # Statistics and parameters travel as two arrays. Equations over dozens of columns would follow the
    # rows through every projection and keep the optimizer busy for longer than the job.
    away = [(named(s) - F.lit(data.target[s])) / F.lit(accepted.scale[s]) for s in data.stats]
    rows = kept.withColumns(
        {"__x": F.array(F.lit(1.0), *away), "__y": F.array(*[moved(p) for p in data.params]), "__w": weight}
    )
    k, m = len(data.stats) + 1, len(data.params)
    products, totals, count = _moments(rows.withColumn("__z", F.concat("__x", "__y")), "__z", "__w", k + m)
    gram = products[:k, :k]
    beta = _solve(gram, products[:k, k:])
    plain = totals / count

    # statistics are measured from the target, so the prediction there is the intercept
    shift = plain[k:] - plain[:k] @ beta
    left = [F.get("__y", F.lit(j)) - _dot("__x", beta[:, j]) - F.lit(float(shift[j])) for j in range(m)]
    rows = rows.withColumn("__r", F.array(*left))
    residuals = [F.get("__r", F.lit(j)) for j in range(m)]
    if heteroscedastic:
        # a zero residual has no log and stays out of this regression
        logs = F.transform("__r", lambda r: F.when(r != 0, F.log(r * r)).otherwise(F.lit(0.0)))
        moments = _moments(rows.withColumn("__z", F.concat("__x", logs)), "__z", "__w", k + m)[0][:k, k:]
        zeros = rows.agg(*[F.count_if(r == 0) for r in residuals]).first()
        for j in range(m):
            own = _moments(rows.where(residuals[j] != 0), "__x", "__w", k)[0] if zeros[j] else gram
            c = _solve(own, moments[:, [j]])[:, 0]
            residuals[j] = residuals[j] * F.sqrt(F.exp(F.lit(float(c[0])) - _dot("__x", c)))
    adjusted = {p: f"adjusted_{p}" for p in data.params}
    columns = {}
    for j, p in enumerate(data.params):
        value = F.lit(float(beta[0, j] + shift[j])) + residuals[j]
        columns[adjusted[p]] = F.exp(value) if p in floors else value
    out = rows.withColumns(columns).drop("__x", "__y", "__w", "__r")
    return Posterior(materialise(out), data.params, adjusted)


# --- cross-validation ------------------------------------------------------------------------


def _without(v: float, around: Sequence[float], n: int) -> float:
    """Median of n sorted values less one copy of v, from the values around the middle."""
    if n % 2 == 0:
        low, high = around
        return high if v <= low else low
    a, b, c = around
    if v <= a:
        return (b + c) / 2.0
    return (a + c) / 2.0 if v <= b else (a + b) / 2.0


def _middle(n: int) -> list[int]:
    """Ranks that decide the median once one of n values is taken out."""
    return [n // 2, n // 2 + 1] if n % 2 == 0 else [(n - 1) // 2, (n + 1) // 2, (n + 3) // 2]


def _leave_one_out_scales(
    complete: DataFrame, data: AbcInput, held: Sequence, n: int, block_rows: int | None
) -> list[dict[str, float]]:
    """Per held-out condition, the scale of each statistic over the other conditions.

    Taking out one value moves a median by at most one place, so the values around the middle of the
    full column settle all held-out medians. These take at most three values per statistic, and for each
    of them the values around the middle of the absolute deviations settle the rest: the table is read
    twice, whatever the number of held-out conditions.
    """
    ranks = _middle(n)
    sizes = GroupSizes(n * len(data.stats), n)
    long = to_long(complete, [], data.stats, "name", "value")
    around = {
        r["name"]: r["x"] for r in order_statistics(long, ["name"], "value", ranks, block_rows, sizes).collect()
    }
    centres = [{s: _without(h[s], around[s], n) for s in data.stats} for h in held]
    distinct = {s: sorted({c[s] for c in centres}) for s in data.stats}
    deviations = [
        F.struct(
            F.lit(s).alias("name"),
            F.lit(i).alias("centre"),
            F.abs(named(s) - F.lit(float(c))).alias("value"),
        )
        for s in data.stats
        for i, c in enumerate(distinct[s])
    ]
    away = complete.select(F.explode(F.array(*deviations)).alias("d")).select("d.*")
    spread = {
        (r["name"], r["centre"]): r["x"]
        for r in order_statistics(away, ["name", "centre"], "value", ranks, block_rows, sizes).collect()
    }
    out = []
    for h, c in zip(held, centres, strict=True):
        mads = {
            s: _without(abs(h[s] - c[s]), spread[(s, distinct[s].index(c[s]))], n) for s in data.stats
        }
        out.append({s: (MAD_SCALE * v if v else 1.0) for s, v in mads.items()})
    return out


def abc_cross_validate(
    data: AbcInput,
    nval: int,
    tols: Sequence[float],
    seed: str = "cv",
    block_rows: int | None = None,
    method: str = "rejection",
    pruned: bool | None = None,
) -> DataFrame:
    """Re-estimate ``nval`` held-out conditions from the others.

    Gives tol, holdout, parameter, true, estimate; the estimate is the median of the accepted values, with
    ``method="loclinear"`` of the values adjusted by a weighted linear regression on the statistics.
    Held-out conditions are those with the lowest keyed draw, so a seed always picks the same ones. All
    tolerances read one ranking, which is made of the rows below each held-out condition's cut. With ``pruned``
    held-out conditions are compared with what an index leaves of the others, instead of with all of them; the
    result is the same. By default they are from ``PRUNED_TARGETS`` on, when the index pays.
    """
    if method not in ("rejection", "loclinear"):
        raise ValueError("method must be 'rejection' or 'loclinear'")
    complete = data.complete()
    total, usable = data.df.agg(
        F.count(F.lit(1)),
        F.count_if(reduce(lambda a, b: a & b, [~is_missing(s) for s in data.stats])),
    ).first()
    if usable < 4 or nval < 1 or nval >= usable:
        raise ValueError(f"cannot hold out {nval} of {usable} complete conditions")
    draw = uniform(seed, data.key)
    held = complete.orderBy(draw, data.key).limit(nval).collect()
    scale = _leave_one_out_scales(complete, data, held, usable, block_rows)
    targets = _targets(data, held, scale)

    k = range(len(data.stats))
    away = [((named(s) - F.col(f"__t{i}")) / F.col(f"__c{i}")).alias(f"__x{i}") for i, s in enumerate(data.stats)]
    # the table of held-out conditions has nval rows, which the caller sets
    goals = targets.select("holdout", *[f"__{kind}{i}" for kind in "tc" for i in k])
    accept = {float(t): min(math.ceil((total - 1) * t), usable - 1) for t in tols}
    most = max(accept.values())
    if nval >= PRUNED_TARGETS if pruned is None else pruned:
        wanted = [(h[data.key], {s: h[s] for s in data.stats}, c) for h, c in zip(held, scale, strict=True)]
        length = F.sqrt(reduce(lambda a, b: a + b, [x * x for x in away]))
        pairs = candidate_pairs(complete, data.key, data.stats, wanted, goals, length, most)
    else:
        pairs = complete.crossJoin(F.broadcast(goals)).where(named(data.key) != F.col("holdout"))
    measured = pairs.select(
        "holdout", named(data.key).alias("__id"), *doubles(complete, data.params), *away
    ).withColumn("__distance", F.sqrt(reduce(lambda a, b: a + b, [F.col(f"__x{i}") * F.col(f"__x{i}") for i in k])))
    near = materialise(_nearest(measured, ["holdout"], "__distance", most))
    placed = row_numbers(near, ["holdout"], ["__distance", "__id"], "__place", block_rows)
    levels = F.array(*[F.struct(F.lit(t).alias("tol"), F.lit(n).alias("k")) for t, n in accept.items()])
    taken = (
        placed.where(F.col("__place") <= most)
        .withColumn("level", F.explode(levels))
        .where(F.col("__place") <= F.col("level.k"))
        .withColumn("tol", F.col("level.tol"))
    )
    if method == "loclinear":
        taken = _adjusted(materialise(taken.drop("level")), data, len(data.stats))
    long = to_long(taken, ["tol", "holdout"], data.params)
    sizes = GroupSizes(most * nval * len(tols) * len(data.params), most)
    medians = group_quantiles(long, ["tol", "holdout", "parameter"], "value", [0.5], block_rows, sizes)
    truth = to_long(targets.select("holdout", *[named(p) for p in data.params]), ["holdout"], data.params)
    truth = truth.withColumnsRenamed({"holdout": "__h", "parameter": "__p", "value": "true"})
    same = (F.col("holdout") == F.col("__h")) & (F.col("parameter") == F.col("__p"))
    table = medians.join(F.broadcast(truth), same, "left")
    table = table.select("tol", "holdout", "parameter", "true", F.get("q", F.lit(0)).alias("estimate"))
    # a handful of rows at the end of a long plan, read by every report on them
    return materialise(table)


def _targets(data: AbcInput, held: Sequence, scale: Sequence[Mapping[str, float]]) -> DataFrame:
    """One row per held-out condition: its parameters, statistics ``__t…`` and their scales ``__c…``."""
    key = data.df.schema[data.key].dataType
    fields = [T.StructField("holdout", key)]
    fields += [T.StructField(p, T.DoubleType()) for p in data.params]
    fields += [T.StructField(f"__{kind}{i}", T.DoubleType()) for kind in "tc" for i in range(len(data.stats))]
    number = lambda v: None if v is None else float(v)
    rows = [
        (h[data.key], *[number(h[p]) for p in data.params], *[float(h[s]) for s in data.stats], *[float(c[s]) for s in data.stats])
        for h, c in zip(held, scale, strict=True)
    ]
    return data.df.sparkSession.createDataFrame(rows, T.StructType(fields))


def _adjusted(taken: DataFrame, data: AbcInput, k: int) -> DataFrame:
    """Move the accepted values to the target along a line fitted per held-out condition and tolerance.

    Conditions weigh ``1 − (d / d_max)²``. Sums of products add up before the shuffle; one row per fit,
    of the size of the number of statistics squared, comes to the driver.
    """
    group = ["tol", "holdout"]
    widest = taken.groupBy(*group).agg(F.max("__distance").alias("__d_max"))
    rows = join_on_keys(taken, widest, group)
    ratio = F.col("__distance") / F.col("__d_max")
    rows = rows.withColumn("__w", F.when(F.col("__d_max") > 0, 1.0 - ratio * ratio).otherwise(F.lit(1.0)))
    x = [F.lit(1.0), *[F.col(f"__x{i}") for i in range(k)]]
    y = [named(p) for p in data.params]
    grams = [F.sum(F.col("__w") * x[i] * x[j]) for i in range(k + 1) for j in range(i + 1)]
    moments = [F.sum(F.col("__w") * x[i] * v) for i in range(k + 1) for v in y]
    sums = rows.groupBy(*group).agg(F.array(*grams).alias("gram"), F.array(*moments).alias("moment")).collect()
    fits = []
    for r in sums:
        gram = np.zeros((k + 1, k + 1))
        gram[np.tril_indices(k + 1)] = r["gram"]
        gram = gram + np.tril(gram, -1).T
        beta = _solve(gram, np.array(r["moment"], dtype=float).reshape(k + 1, len(y)))
        fits.append((r["tol"], r["holdout"], beta[1:].T.tolist()))
    kind = data.df.schema[data.key].dataType.simpleString()
    table = data.df.sparkSession.createDataFrame(fits, f"tol double, holdout {kind}, slopes array<array<double>>")
    fitted = join_on_keys(rows, F.broadcast(table), group)

    def moved(j: int, p: str) -> Column:
        slope = lambda i: F.get(F.get("slopes", F.lit(j)), F.lit(i))
        # statistics are measured from the target: what the line adds beyond its intercept goes
        return named(p) - reduce(lambda a, b: a + b, [slope(i) * F.col(f"__x{i}") for i in range(k)])

    return fitted.withColumns({p: moved(j, p) for j, p in enumerate(data.params)})
