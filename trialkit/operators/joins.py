"""Joins and groups on keys that may be NULL."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialkit.functions.columns import named


def _plain_default(dtype: T.DataType) -> Column:
    if isinstance(dtype, T.NumericType):
        return F.lit(0).cast(dtype)
    if isinstance(dtype, T.StringType):
        return F.lit("")
    if isinstance(dtype, T.BooleanType):
        return F.lit(False)
    if isinstance(dtype, T.DateType):
        return F.date_from_unix_date(F.lit(0))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.timestamp_seconds(F.lit(0)).cast(dtype)
    raise TypeError(f"cannot group in order by a column of type {dtype.simpleString()}")


def solid_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str], list[Column]]:
    """Replace nullable keys by a value that is never NULL and a flag.

    NULL keys form a group of their own here. A NULL-safe join on the keys would do, but its hash
    differs from that of a window on the same keys and costs another shuffle; plain equality on these
    columns does not. Returns rows, key columns, and the columns that give back the originals.
    """
    columns: dict[str, Column] = {}
    back: list[Column] = []
    for i, k in enumerate(keys):
        field = df.schema[k]
        value, flag = f"__g{i}", f"__g{i}_null"
        if field.nullable:
            columns[value] = F.coalesce(named(k), _plain_default(field.dataType))
            columns[flag] = named(k).isNull()
            back.append(F.when(~named(flag), named(value)).alias(k))
        else:
            columns[value] = named(k)
            back.append(named(value).alias(k))
    return df.withColumns(columns).drop(*keys), list(columns), back


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; keys appear once, on the left.

    No broadcast hint: the size of ``right`` is measured at run time and Spark picks the strategy.
    Without keys ``right`` is the one row of a global aggregate.
    """
    if not keys:
        return left.crossJoin(right)
    renamed = right.withColumnsRenamed({k: f"__r_{i}" for i, k in enumerate(keys)})
    on = []
    for i, k in enumerate(keys):
        nullable = left.schema[k].nullable or right.schema[k].nullable
        mine, other = named(k), named(f"__r_{i}")
        on.append(mine.eqNullSafe(other) if nullable else mine == other)
    joined = left.join(renamed, reduce(lambda a, b: a & b, on), how)
    return joined.drop(*[f"__r_{i}" for i in range(len(keys))])
