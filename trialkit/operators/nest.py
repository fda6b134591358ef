"""Nested records, long rows, and the design tables that start a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialkit.functions.columns import doubles, named, with_formulas

#: Per-item inputs a trial may carry; not part of the long table.
EXCLUDED_FIELD = ".item_params"
INDEX_COLUMNS = ("model", "condition_idx", "trial_idx", "rank_idx")


def _trial_fields(df: DataFrame, trials: str) -> list[str]:
    element = df.schema[trials].dataType.elementType
    return [f.name for f in element.fields if f.name != EXCLUDED_FIELD]


def _field(parent: Column, name: str) -> Column:
    return parent.getField(name)


def as_variant(df: DataFrame, params: str = "cond_params") -> DataFrame:
    """Parameters (a struct, or a map of names) as a variant: tables of different models then have one schema."""
    return df.withColumn(params, F.to_variant_object(named(params)))


def parameter_types(df: DataFrame, params: str = "cond_params") -> dict[str, tuple[str, bool]]:
    """Names of the parameters in a variant column, each with its type and whether it has a value per trial.

    One aggregate over the rows; what reaches the driver is a row per name. Numbers are doubles, and what is not of
    one kind in all conditions is a string.
    """
    entries = df.select(F.explode(_held(params)).alias("name", "value"))
    listed = F.schema_of_variant("value").startswith("ARRAY<")
    kinds: dict[str, set[str]] = {}
    arrays = set()
    for name, many, kind in entries.groupBy("name", listed).agg(F.schema_of_variant_agg("value")).collect():
        plain = kind.removeprefix("ARRAY<").removesuffix(">") if many else kind
        if plain in ("BIGINT", "DOUBLE", "FLOAT") or plain.startswith("DECIMAL("):
            plain = "double"
        if plain != "VOID":
            kinds.setdefault(name, set()).add({"double": "double", "BOOLEAN": "boolean"}.get(plain, "string"))
        arrays |= {name} if many else set()
        kinds.setdefault(name, set())
    return {
        name: (own.pop() if len(own) == 1 else "string" if own else "double", name in arrays)
        for name, own in sorted(kinds.items())
    }


def _held(params: str) -> Column:
    return F.try_variant_get(named(params), "$", "map<string,variant>")


def flatten_results(
    df: DataFrame,
    *,
    condition: str = "condition_idx",
    trials: str = "result",
    params: str = "cond_params",
    param_names: Sequence[str] | None = None,
    model: str = "model",
) -> DataFrame:
    """One row per response from one nested record per condition.

    ``trials`` is an array of structs of equally long arrays; ``params`` a struct of arrays with one value
    per trial, or a map of them, whose keys to read ``param_names`` lists, or a variant (see :func:`as_variant`),
    in which each condition may have parameters of its own: their names and types are looked up first, unless
    ``param_names`` lists some, and a condition without one has NULL there. In a variant one value may stand for all
    trials. A trial without responses gives no row. A parameter named like an index column replaces that column.
    Both explodes are narrow: nothing is shuffled.
    """
    fields = _trial_fields(df, trials)
    ptype = df.schema[params].dataType
    mapped = isinstance(ptype, T.MapType)
    if mapped and param_names is None:
        raise TypeError("a map has no fixed columns: name the parameters to read")
    free = isinstance(ptype, T.VariantType)
    found = parameter_types(df, params) if free else {}
    if param_names is not None:
        pnames = list(param_names)
    else:
        pnames = list(found) if free else [f.name for f in ptype.fields]

    def parameter(name: str) -> Column:
        held = F.col("__params")
        if not free:
            values = F.try_element_at(held, F.lit(name)) if mapped else _field(held, name)
            return F.get(values, F.col("__t"))
        kind, listed = found.get(name, ("double", False))
        value = F.try_element_at(held, F.lit(name))
        alone = F.try_variant_get(value, "$", kind)
        return F.coalesce(F.get(F.try_variant_get(value, "$", f"array<{kind}>"), F.col("__t")), alone) if listed else alone

    # Parameters are read by position while the trials are still arrays, so the row that travels through
    # the second explode carries one value per parameter rather than the whole arrays.
    per_trial = df.select(
        named(model).alias("__model"),
        named(condition).alias("__condition"),
        (_held(params) if free else named(params)).alias("__params"),
        F.posexplode(named(trials)).alias("__t", "__trial"),
    ).select(
        "__model",
        "__condition",
        F.col("__t"),
        F.arrays_zip(*[_field(F.col("__trial"), f).alias(f) for f in fields]).alias("__rows"),
        *[parameter(p).alias(f"__p_{p}") for p in pnames],
    )
    rows = per_trial.select(
        "__model", "__condition", "__t", *[named(f"__p_{p}") for p in pnames],
        F.posexplode("__rows").alias("__r", "__row"),
    )
    index = {
        "model": F.col("__model").cast("string"),
        "condition_idx": F.col("__condition"),
        "trial_idx": (F.col("__t") + 1).cast("int"),
        "rank_idx": (F.col("__r") + 1).cast("int"),
    }
    values = {f: _field(F.col("__row"), f) for f in fields}
    parameters = {p: named(f"__p_{p}") for p in pnames}
    columns = {**index, **values, **parameters}
    return rows.select(*[c.alias(n) for n, c in columns.items()])


def count_responses(df: DataFrame, trials: str = "result") -> Column:
    """Responses in a nested record: the lengths of its first trial field, summed."""
    first = _trial_fields(df, trials)[0]
    return F.aggregate(
        named(trials),
        F.lit(0).cast("bigint"),
        lambda total, t: total + F.coalesce(F.size(_field(t, first)), F.lit(0)).cast("bigint"),
    )


def condition_range(spark: SparkSession, n: int) -> DataFrame:
    """Condition numbers 1 … n."""
    return spark.range(1, n + 1).withColumnRenamed("id", "condition_idx")


def design_table(
    conditions: DataFrame,
    *,
    condition_formulas: Sequence[tuple[str, Column | float | str]] = (),
    n_trials: int,
    trial_formulas: Sequence[tuple[str, Column | float | str]] = (),
    n_items: int,
    item_formulas: Sequence[tuple[str, Column | float | str]] = (),
) -> DataFrame:
    """Conditions × trials × items, with formulas run at each level.

    The levels are spread by ``explode`` of a sequence: a narrow step on the condition rows.
    """
    table = with_formulas(conditions, condition_formulas)
    table = table.withColumn("trial_idx", F.explode(F.sequence(F.lit(1), F.lit(n_trials))))
    table = with_formulas(table, trial_formulas)
    table = table.withColumn("item_idx", F.explode(F.sequence(F.lit(1), F.lit(n_items))))
    return with_formulas(table, item_formulas)


def to_long(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "parameter", value: str = "value"
) -> DataFrame:
    """One row per listed column."""
    cast = df.select(*[named(i) for i in ids], *doubles(df, columns))
    return cast.unpivot([named(i) for i in ids], [named(c) for c in columns], name, value)
