"""Column expressions shared by the operators."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """Column by its literal name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_column(value: Column | str) -> Column:
    return named(value) if isinstance(value, str) else value


def require_columns(df: DataFrame, wanted: Iterable[str]) -> None:
    """Raise before any job runs when a column is absent."""
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(
            f"missing columns: {', '.join(missing)}; available columns: {', '.join(df.columns)}"
        )


# --- missing and finite values ---------------------------------------------------------------


def is_missing(value: Column | str) -> Column:
    """NULL or NaN."""
    v = as_column(value)
    return v.isNull() | F.isnan(v)


def is_finite(value: Column | str) -> Column:
    """True for an ordinary number; false, never NULL, for NULL, NaN and the infinities."""
    v = as_column(value).cast("double")
    return F.coalesce(F.abs(v) < F.lit(math.inf), F.lit(False))


def valid_time(value: Column | str) -> Column:
    """A usable response time: present, finite and above zero."""
    v = as_column(value).cast("double")
    return F.coalesce((v > 0) & (v < F.lit(math.inf)), F.lit(False))


def finite_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose listed columns are all finite."""
    return df.where(reduce(lambda a, b: a & b, [is_finite(c) for c in columns]))


def complete_cases(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without NULL or NaN.

    One condition per column, not one over all of them: the optimizer carries each condition through
    later renames, and one that spans many columns multiplies with every one renamed.
    """
    types = dict(df.dtypes)
    tests = []
    for c in columns if columns is not None else df.columns:
        tests.append(named(c).isNotNull())
        if types[c] in ("double", "float"):
            tests.append(~F.isnan(named(c)))
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def doubles(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """The columns as doubles; those that are already are passed on as they stand, without an alias."""
    types = dict(df.dtypes)
    return [named(c) if types[c] == "double" else named(c).cast("double").alias(c) for c in columns]


# --- formula columns and recycling -----------------------------------------------------------


def with_formulas(df: DataFrame, formulas: Sequence[tuple[str, Column | float | str]]) -> DataFrame:
    """Add columns in order. A later formula sees the earlier ones; an existing name is overwritten.

    Columns refer to earlier ones by ``F.col``; plain values are repeated on every row.
    """
    for name, formula in formulas:
        df = df.withColumn(name, formula if isinstance(formula, Column) else F.lit(formula))
    return df


def recycle(values: Sequence[float], position: Column | str, n: int) -> Column:
    """Repeat ``values`` cyclically along a 1-based ``position`` running to ``n``."""
    if len(values) == 0 or n % len(values) != 0:
        raise ValueError(f"length {len(values)} does not divide n = {n}")
    if len(values) == 1:
        return F.lit(values[0])
    slot = F.pmod(as_column(position).cast("bigint") - 1, F.lit(len(values)))
    return F.get(F.array(*[F.lit(v) for v in values]), slot.cast("int"))


# --- draws -----------------------------------------------------------------------------------


def uniform(seed: str, *keys: Column | str, low: Column | float = 0.0, high: Column | float = 1.0) -> Column:
    """Uniform draw fixed by seed and row key, so it never depends on the partitioning.

    52 bits of the MD5 of the text ``seed:key:key…`` over 2^52, shifted to the cell midpoint.
    """
    text = F.concat_ws(":", F.lit(seed), *[as_column(k).cast("string") for k in keys])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    u = (bits + 0.5) / float(2**52)
    lo = low if isinstance(low, Column) else F.lit(float(low))
    hi = high if isinstance(high, Column) else F.lit(float(high))
    return lo + (hi - lo) * u


def normal(seed: str, *keys: Column | str, mean: Column | float = 0.0, sd: Column | float = 1.0) -> Column:
    """Normal draw by Box–Muller from two keyed uniforms."""
    radius = F.sqrt(-2.0 * F.log(uniform(seed + "/r", *keys)))
    angle = 2.0 * math.pi * uniform(seed + "/a", *keys)
    mu = mean if isinstance(mean, Column) else F.lit(float(mean))
    scale = sd if isinstance(sd, Column) else F.lit(float(sd))
    return mu + scale * (radius * F.cos(angle))


# --- normal distribution function ------------------------------------------------------------

# Hart's rational approximation of the normal tail, as printed by West (2005).
TAIL_NUMERATOR = (
    3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
TAIL_DENOMINATOR = (
    8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
TAIL_SPLIT = 7.07106781186547
TAIL_ROOT_2PI = 2.506628274631
TAIL_FAR = 37.0


def _horner(coefficients: Sequence[float], x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def with_normal_cdf(df: DataFrame, z: str, out: str) -> DataFrame:
    """Add Φ(z) as column ``out``.

    The steps are separate projections: Catalyst then computes |z| and exp(-z²/2) once per row
    and does not paste them into every place they are used.
    """
    x, e, tail = f"{out}__x", f"{out}__e", f"{out}__tail"
    df = df.withColumn(x, F.abs(named(z)))
    df = df.withColumn(e, F.exp(-named(x) * named(x) / 2.0))
    far = named(x)
    for k in (0.65, 4.0, 3.0, 2.0, 1.0):
        far = named(x) + F.lit(k) if k == 0.65 else named(x) + F.lit(k) / far
    df = df.withColumn(
        tail,
        F.when(named(x) > TAIL_FAR, F.lit(0.0))
        .when(
            named(x) < TAIL_SPLIT,
            named(e) * _horner(TAIL_NUMERATOR, named(x)) / _horner(TAIL_DENOMINATOR, named(x)),
        )
        .otherwise(named(e) / far / TAIL_ROOT_2PI),
    )
    return df.withColumn(out, F.when(named(z) > 0, 1.0 - named(tail)).otherwise(named(tail))).drop(x, e, tail)
