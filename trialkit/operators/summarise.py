"""Grouped summaries that can be added together, pivoted wide and joined on their key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialkit.functions.columns import complete_cases, named, require_columns
from trialkit.functions.stats import Quantiles, Vector, present
from trialkit.operators.blocks import GroupSizes, group_quantiles, group_sizes, join_on_keys

Expression = Column | Vector | Quantiles


@dataclass(frozen=True)
class SummaryTable:
    """A summary and the columns that identify its rows."""

    df: DataFrame
    key: tuple[str, ...]

    def __add__(self, other: SummaryTable) -> SummaryTable:
        if not isinstance(other, SummaryTable):
            return NotImplemented
        check_same_key(self.key, other.key)
        return SummaryTable(full_join(self.df, other.df, self.key), self.key)

    @property
    def statistics(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.key]

    def complete(self) -> SummaryTable:
        """Without rows that lack a value."""
        return SummaryTable(complete_cases(self.df), self.key)


@dataclass(frozen=True)
class SummaryOp:
    by: tuple[str, ...]
    wider_by: tuple[str, ...]
    expressions: tuple[tuple[str, Expression], ...]
    pivot_values: tuple | None = None

    @property
    def pivoted(self) -> tuple[str, ...]:
        return tuple(c for c in self.by if c not in self.wider_by)


@dataclass(frozen=True)
class SummarySpec:
    """Summaries to run later: call it on rows, or add it to another one."""

    ops: tuple[SummaryOp, ...]

    def __add__(self, other: SummarySpec) -> SummarySpec:
        if not isinstance(other, SummarySpec):
            return NotImplemented
        return SummarySpec(self.ops + other.ops)

    def __call__(
        self, df: DataFrame, block_rows: int | None = None, sizes: GroupSizes | None = None
    ) -> SummaryTable:
        return apply_spec(self, df, block_rows, sizes)

    def __repr__(self) -> str:
        lines = [f"SummarySpec with {len(self.ops)} operation(s)"]
        for i, op in enumerate(self.ops, 1):
            lines.append(
                f"  {i}: by=[{', '.join(op.by)}] wider_by=[{', '.join(op.wider_by)}] "
                f"expressions={len(op.expressions)}"
            )
        return "\n".join(lines)


def _names(columns: str | Sequence[str] | None) -> tuple[str, ...]:
    if columns is None:
        return ()
    return (columns,) if isinstance(columns, str) else tuple(columns)


def summarise(
    *,
    by: str | Sequence[str] | None = ("condition_idx",),
    wider_by: str | Sequence[str] | None = ("condition_idx",),
    pivot_values: Sequence | None = None,
    **expressions: Expression,
) -> SummarySpec:
    """Describe a summary per ``by`` group with one row per ``wider_by`` value.

    Columns in ``by`` but not in ``wider_by`` are spread over the columns of the result. With
    ``pivot_values`` (values of that column, or tuples of several columns' values) these are the columns,
    in that order; otherwise the rows are read for them, and at most ``spark.sql.pivotMaxValues`` are
    allowed. An expression is an aggregate of the rows of a group: built-in, or a grouped-aggregate pandas
    UDF, which holds a group in the memory of one task.
    """
    values = None if pivot_values is None else tuple(pivot_values)
    op = SummaryOp(_names(by), _names(wider_by), tuple(expressions.items()), values)
    outside = [c for c in op.wider_by if c not in op.by]
    if outside:
        raise ValueError(
            f"wider_by must be a subset of by; by = {list(op.by)}, wider_by = {list(op.wider_by)}, "
            f"not in by: {', '.join(outside)}"
        )
    return SummarySpec((op,))


def summarise_by(df: DataFrame, **arguments) -> SummaryTable:
    """:func:`summarise` applied at once."""
    block_rows, sizes = arguments.pop("block_rows", None), arguments.pop("sizes", None)
    return summarise(**arguments)(df, block_rows, sizes)


def check_same_key(left: Sequence[str], right: Sequence[str]) -> None:
    if tuple(left) != tuple(right):
        raise ValueError(f"tables have different keys: {list(left)} and {list(right)}")


def clash_names(left: Sequence[str], right: Sequence[str]) -> tuple[list[str], list[str]]:
    """Names shared by both sides get ``.x`` and ``.y``."""
    shared = set(left) & set(right)
    return (
        [f"{c}.x" if c in shared else c for c in left],
        [f"{c}.y" if c in shared else c for c in right],
    )


def full_join(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Full outer join on the key; NULL keys match each other."""
    key = list(key)
    lcols = [c for c in left.columns if c not in key]
    rcols = [c for c in right.columns if c not in key]
    lnames, rnames = clash_names(lcols, rcols)
    if not key:
        # two global summaries: one row each
        pair = left.toDF(*[f"__l{i}" for i in range(len(lcols))]).crossJoin(
            right.toDF(*[f"__r{i}" for i in range(len(rcols))])
        )
        return pair.toDF(*lnames, *rnames)
    a = left.select(
        *[named(k).alias(f"__lk{i}") for i, k in enumerate(key)],
        *[named(c).alias(f"__l{i}") for i, c in enumerate(lcols)],
    )
    b = right.select(
        *[named(k).alias(f"__rk{i}") for i, k in enumerate(key)],
        *[named(c).alias(f"__r{i}") for i, c in enumerate(rcols)],
    )
    same = reduce(
        lambda p, q: p & q, [F.col(f"__lk{i}").eqNullSafe(F.col(f"__rk{i}")) for i in range(len(key))]
    )
    return a.join(b, same, "full").select(
        *[F.coalesce(f"__lk{i}", f"__rk{i}").alias(k) for i, k in enumerate(key)],
        *[F.col(f"__l{i}").alias(n) for i, n in enumerate(lnames)],
        *[F.col(f"__r{i}").alias(n) for i, n in enumerate(rnames)],
    )


# --- planning --------------------------------------------------------------------------------


def apply_spec(
    spec: SummarySpec, df: DataFrame, block_rows: int | None = None, sizes: GroupSizes | None = None
) -> SummaryTable:
    """Run all operations; those with the same groups share one aggregation, so one shuffle.

    The group tables are stacked and folded by one more aggregation on the key, which does the work of
    the pivots and of the full joins between the operations together. Before that, one job at most reads
    the rows for pivot labels and for the size of the largest key; ``sizes`` (rows by key) and pivot values
    that are given save it.
    """
    key = spec.ops[0].wider_by
    for op in spec.ops[1:]:
        check_same_key(key, op.wider_by)
    require_columns(df, dict.fromkeys(c for op in spec.ops for c in op.by))

    groupings = list(dict.fromkeys(op.by for op in spec.ops))
    labels_of, sizes = _measured(spec, df, sizes)
    key_large, large = _outgrown(spec, df, block_rows, sizes)
    rows = df
    if key and not key_large:
        # Quantiles move every value anyway. Moving the rows once by the key lets all operations
        # and the final fold run on that one partitioning.
        rows = df.repartition(*[named(k) for k in key])
    stacked: list[DataFrame] = []
    folds: list[Column] = []
    placed: dict[int, list[tuple[str, str]]] = {}
    for by in groupings:
        members = [(i, op) for i, op in enumerate(spec.ops) if op.by == by]
        table, values = _aggregate(rows, by, members, large[by], block_rows)
        pivoted = members[0][1].pivoted
        if not pivoted:
            stacked.append(table.withColumn("__key", F.lit(None).cast("string")))
            folds += [F.first(named(c), ignorenulls=True).alias(c) for own in values.values() for c, _ in own]
            placed.update(values)
            continue
        types = dict(df.dtypes)
        label = _label(pivoted, types)
        labels = labels_of[by]
        stacked.append(table.withColumn("__key", label).drop(*[c for c in pivoted]))
        for i, own in values.items():
            placed[i] = []
            for c, name in own:
                for j, text in enumerate(labels):
                    cell = F.when(F.col("__key") == F.lit(text), named(c))
                    folds.append(F.first(cell, ignorenulls=True).alias(f"{c}__{j}"))
                    # a lone value column leaves just the label
                    placed[i].append((f"{c}__{j}", text if len(own) == 1 else f"{name}_{text}"))

    # Columns come out in the order the operations were written, clashes resolved left to right.
    internal = [c for c, _ in placed[0]]
    final = [n for _, n in placed[0]]
    for i in range(1, len(spec.ops)):
        left, right = clash_names(final, [n for _, n in placed[i]])
        internal += [c for c, _ in placed[i]]
        final = left + right
    out = [named(c).alias(n) for c, n in zip(internal, final, strict=True)]
    if len(stacked) == 1 and not spec.ops[0].pivoted:
        folded = stacked[0]
    else:
        folded = bind_rows(*stacked).groupBy(*[named(k) for k in key]).agg(*folds)
    return SummaryTable(folded.select(*[named(k) for k in key], *out), key)


def _label(pivoted: Sequence[str], types: dict[str, str], values: Sequence[Column] | None = None) -> Column:
    parts = [named(c) for c in pivoted] if values is None else values
    return F.concat_ws("_", *[pivot_label(c, types[c], v) for c, v in zip(pivoted, parts, strict=True)])


def _measured(
    spec: SummarySpec, df: DataFrame, sizes: GroupSizes | None
) -> tuple[dict[tuple[str, ...], list[str]], GroupSizes | None]:
    """Pivot labels by grouping, and the sizes of the key groups where a quantile asks for them."""
    key = spec.ops[0].wider_by
    wanted = sizes is None and any(_has_quantiles(op) for op in spec.ops)
    labels: dict[tuple[str, ...], list[str]] = {}
    for by in dict.fromkeys(op.by for op in spec.ops):
        op = next(o for o in spec.ops if o.by == by)
        if not op.pivoted:
            continue
        given = next((o.pivot_values for o in spec.ops if o.by == by and o.pivot_values is not None), None)
        if given is not None:
            labels[by] = _given_labels(df, op.pivoted, given)
        else:
            labels[by], found = _labels(df, by, op.pivoted, key if wanted and sizes is None else None)
            sizes = sizes or found
    if wanted and sizes is None:
        sizes = group_sizes(df, key)
    return labels, sizes


def _given_labels(df: DataFrame, pivoted: Sequence[str], values: Sequence) -> list[str]:
    types = dict(df.dtypes)
    rows = [v if isinstance(v, tuple) else (v,) for v in values]
    labels = [_label(pivoted, types, [F.lit(x).cast(types[c]) for c, x in zip(pivoted, r, strict=True)]) for r in rows]
    return list(df.sparkSession.range(1).select(F.array(*labels).alias("labels")).first()["labels"])


def _labels(
    df: DataFrame, by: Sequence[str], pivoted: Sequence[str], key: Sequence[str] | None
) -> tuple[list[str], GroupSizes | None]:
    """Pivot labels in the order they are first met when the groups are read in key order.

    With ``key`` also the sizes of its groups: both come from one count of the groups, in one job.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    seen = F.min(F.struct(*[x for c in by for x in (named(c).isNull(), named(c))])).alias("__seen")
    label = _label(pivoted, dict(df.dtypes)).alias("__label")
    cells = df if key is None else df.groupBy(*[named(c) for c in by]).agg(F.count(F.lit(1)).alias("__n"))
    found = cells.groupBy(*[named(c) for c in pivoted]).agg(seen).select("__seen", label)
    found = found.orderBy("__seen").limit(limit + 1)
    listed = found.agg(F.sort_array(F.collect_list(F.struct("__seen", "__label"))).alias("__labels"))
    if key is not None:
        whole = cells.groupBy(*[named(c) for c in key]).agg(F.sum("__n").alias("__n"))
        listed = listed.crossJoin(whole.agg(F.sum("__n").alias("__total"), F.max("__n").alias("__largest")))
    row = listed.first()
    labels = [x["__label"] for x in row["__labels"]]
    if len(labels) > limit:
        raise ValueError(
            f"more than {limit} pivot columns; give pivot_values, or raise spark.sql.pivotMaxValues to allow it"
        )
    return labels, None if key is None else GroupSizes(row["__total"] or 0, row["__largest"] or 0)


def _has_quantiles(op: SummaryOp) -> bool:
    return any(isinstance(e, Quantiles) for _, e in op.expressions)


def _outgrown(
    spec: SummarySpec, df: DataFrame, block_rows: int | None, by_key: GroupSizes | None
) -> tuple[bool, dict[tuple[str, ...], GroupSizes | None]]:
    """Whether any key holds many rows, and the sizes of groupings with a group too big for one buffer.

    Nothing is counted unless a quantile asks for it, and a grouping that refines one with small
    groups is not counted again.
    """
    large: dict[tuple[str, ...], GroupSizes | None] = {op.by: None for op in spec.ops}
    if not any(_has_quantiles(op) for op in spec.ops):
        return True, large
    key = spec.ops[0].wider_by
    if not by_key.beyond(block_rows):
        return False, large
    for by in dict.fromkeys(op.by for op in spec.ops if _has_quantiles(op)):
        sizes = by_key if by == key else group_sizes(df, by)
        large[by] = sizes if sizes.beyond(block_rows) else None
    return True, large


def _aggregate(
    df: DataFrame,
    by: tuple[str, ...],
    members: list[tuple[int, SummaryOp]],
    large: GroupSizes | None,
    block_rows: int | None,
) -> tuple[DataFrame, dict[int, list[tuple[str, str]]]]:
    """One row per group; also, per operation, its (internal name, output name) pairs."""
    keys = list(by)
    aggregates: list[Column] = []
    in_python: list[Column] = []
    outputs: list[Column] = []
    values: dict[int, list[tuple[str, str]]] = {}
    asked: dict[str, tuple[Column, list[float]]] = {}
    for i, op in members:
        for name, expr in op.expressions:
            inner = f"__{i}_{name}"
            suffixes = [None] if isinstance(expr, Column) else expr.suffixes()
            values.setdefault(i, []).extend((_suffixed(inner, x), _suffixed(name, x)) for x in suffixes)
            if isinstance(expr, Quantiles):
                # all quantiles of one value come out of one buffer
                value, probs = asked.setdefault(str(expr.value), (expr.value, []))
                slot = list(asked).index(str(expr.value))
                probs += [p for p in expr.probs if p not in probs]
                if expr.strict:
                    whole = F.count(F.lit(1)) == F.count(present(expr.value))
                    aggregates.append(whole.alias(f"{inner}__ok"))
                for p, suffix in zip(expr.probs, suffixes, strict=True):
                    out = F.get(F.col(f"__quantiles{slot}"), F.lit(probs.index(p)))
                    out = F.when(named(f"{inner}__ok"), out) if expr.strict else out
                    outputs.append(out.alias(_suffixed(inner, suffix)))
            elif isinstance(expr, Vector):
                for item, suffix in zip(expr.items, suffixes, strict=True):
                    (in_python if _runs_python(item) else aggregates).append(item.alias(_suffixed(inner, suffix)))
                    outputs.append(named(_suffixed(inner, suffix)))
            else:
                (in_python if _runs_python(expr) else aggregates).append(expr.alias(inner))
                outputs.append(named(inner))
    if large is None:
        for slot, (value, probs) in enumerate(asked.values()):
            wanted = F.array(*[F.lit(p) for p in probs])
            aggregates.append(F.percentile(present(value), wanted).alias(f"__quantiles{slot}"))
    # a row count keeps the groups of an operation that has only separately computed quantiles
    table = df.groupBy(*[named(k) for k in keys]).agg(*aggregates, F.count(F.lit(1)).alias("__rows"))
    if in_python:
        # Spark runs Python aggregates by themselves; the built-in ones stay where they are
        theirs = df.groupBy(*[named(k) for k in keys]).agg(*in_python)
        table = join_on_keys(table, theirs, keys, "left") if keys else table.crossJoin(theirs)
    if large is not None:
        for slot, (value, probs) in enumerate(asked.values()):
            source = df.select(*[named(k) for k in keys], value.alias("__v"))
            parts = group_quantiles(source, keys, "__v", probs, block_rows, large)
            parts = parts.select(*[named(k) for k in keys], F.col("q").alias(f"__quantiles{slot}"))
            table = join_on_keys(table, parts, keys, "left") if keys else table.crossJoin(parts)
    return table.select(*[named(k) for k in keys], *outputs), values


def _runs_python(expression: Column) -> bool:
    """Whether a user's Python function is part of the expression.

    A Python function comes as a ready-made expression node; built-in functions are resolved by name. An
    expression taken for a Python one by mistake would only be aggregated by itself.
    """
    return "ExpressionColumnNode(" in expression._jc.node().toString()


def _suffixed(name: str, suffix: str | None) -> str:
    return name if suffix is None else f"{name}_{suffix}"


def pivot_label(column: str, dtype: str, value: Column | None = None) -> Column:
    """``<column>_<value>``: NULL reads NA, a logical TRUE or FALSE, a double has 15 digits at most.

    A double that holds an integer reads as the integer.
    """
    value = named(column) if value is None else value
    text = value.cast("string")
    if dtype == "boolean":
        text = F.upper(text)
    if dtype in ("double", "float"):
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        # 15 significant digits, of which trailing zeros go
        shown = F.regexp_replace(F.format_string("%.15g", value.cast("double")), r"\.?0+(e|$)", "$1")
        shown = F.when(value.isNotNull(), shown)
        text = F.when(whole, value.cast("decimal(16,0)").cast("string")).otherwise(shown)
    return F.concat(F.lit(column + "_"), F.coalesce(text, F.lit("NA")))


def bind_rows(*tables: DataFrame) -> DataFrame:
    """Stack tables by column name; a column a table lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
