"""Named summary expressions for :func:`trialkit.operators.summarise.summarise`."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from trialkit.functions.columns import as_column, is_missing


def present(value: Column | str) -> Column:
    """The value, with NaN turned into NULL so that aggregates skip both."""
    v = as_column(value)
    return F.when(~is_missing(v.cast("double")), v)


@dataclass(frozen=True)
class Vector:
    """Aggregates that together fill several output columns.

    Element names give ``<column>_<name>``; if any is missing or empty all become ``<column>_X1…``.
    A single unlisted element keeps the plain column name.
    """

    items: tuple[Column, ...]
    names: tuple[str | None, ...] | None = None
    as_list: bool = False

    def suffixes(self) -> list[str | None]:
        return vector_suffixes(len(self.items), self.names, self.as_list)


@dataclass(frozen=True)
class Quantiles:
    """Exact type-7 quantiles of a column; the planner picks a method that fits the group sizes."""

    value: Column
    probs: tuple[float, ...]
    strict: bool = False

    def suffixes(self) -> list[str | None]:
        return vector_suffixes(len(self.probs), tuple(percent_name(p) for p in self.probs), False)


def vector_suffixes(size: int, names: Sequence[str | None] | None, as_list: bool) -> list[str | None]:
    if size == 1 and not as_list:
        return [None]
    if names is None or any(not n for n in names):
        return [f"X{i + 1}" for i in range(size)]
    return list(names)


def percent_name(p: float) -> str:
    return f"{100 * p:.7g}%"


def vector(items: Sequence[Column] | Mapping[str, Column], as_list: bool = False) -> Vector:
    if isinstance(items, Mapping):
        return Vector(tuple(items.values()), tuple(items.keys()), as_list)
    return Vector(tuple(items), None, as_list)


def quantiles(value: Column | str, probs: Sequence[float], strict: bool = False) -> Quantiles:
    if not probs or any(not 0 <= p <= 1 for p in probs):
        raise ValueError("probabilities must lie in [0, 1]")
    return Quantiles(as_column(value).cast("double"), tuple(float(p) for p in probs), strict)


def median(value: Column | str, strict: bool = False) -> Quantiles:
    return quantiles(value, [0.5], strict)


def unless_missing(result: Column, value: Column, strict: bool) -> Column:
    """With ``strict`` the result is NULL as soon as one input is missing."""
    if not strict:
        return result
    return F.when(F.count(F.lit(1)) == F.count(present(value)), result)


def mean(value: Column | str, strict: bool = False) -> Column:
    return unless_missing(F.avg(present(value)), as_column(value), strict)


def sd(value: Column | str, strict: bool = False) -> Column:
    """Sample standard deviation."""
    return unless_missing(F.stddev_samp(present(value)), as_column(value), strict)


def count() -> Column:
    return F.count(F.lit(1))


def first(value: Column | str, order: Sequence[Column | str]) -> Column:
    """Value of the row that comes first by ``order``, the same on every run."""
    return F.min_by(as_column(value), F.struct(*[as_column(o) for o in order]))


def share(condition: Column) -> Column:
    """Share of the group's rows that meet the condition (NULL counts as not met)."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def omission_rate(expected: Column | float) -> Column:
    """Share of expected responses that left no row."""
    total = expected if isinstance(expected, Column) else F.lit(float(expected))
    return 1.0 - F.try_divide(F.count(F.lit(1)).cast("double"), total)


def _pair(y: Column | str, x: Column | str) -> tuple[Column, Column]:
    yy, xx = as_column(y).cast("double"), as_column(x).cast("double")
    both = ~is_missing(yy) & ~is_missing(xx)
    return F.when(both, yy), F.when(both, xx)


def lm(y: Column | str, x: Column | str, name: str | None = None) -> Vector:
    """Least-squares line y ~ x: ``(Intercept)`` and the slope, named after x.

    A constant x leaves the slope NULL and the intercept at the mean of y.
    """
    label = name or (x if isinstance(x, str) else "x")
    yy, xx = _pair(y, x)
    moves = F.regr_sxx(yy, xx) > 0
    return Vector(
        (
            F.when(moves, F.regr_intercept(yy, xx)).otherwise(F.avg(yy)),
            F.when(moves, F.regr_slope(yy, xx)),
        ),
        ("(Intercept)", label),
    )


def gaussian_aic(y: Column | str, x: Column | str) -> Column:
    """AIC of the Gaussian model y ~ x with its maximum-likelihood variance."""
    yy, xx = _pair(y, x)
    n = F.regr_count(yy, xx).cast("double")
    sxx, syy, sxy = F.regr_sxx(yy, xx), F.regr_syy(yy, xx), F.regr_sxy(yy, xx)
    moves = sxx > 0
    rss = F.greatest(F.when(moves, syy - F.try_divide(sxy * sxy, sxx)).otherwise(syy), F.lit(0.0))
    # two for the variance, two for each fitted coefficient
    penalty = F.when(moves, F.lit(6.0)).otherwise(F.lit(4.0))
    deviance = F.when(rss > 0, F.log(F.try_divide(2 * math.pi * rss, n))).otherwise(F.lit(-math.inf))
    return F.when(n > 0, n * (deviance + 1.0) + penalty)
