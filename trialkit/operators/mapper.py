"""User functions per condition."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from inspect import signature

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialkit.functions.columns import named, require_columns
from trialkit.operators.blocks import BLOCK_ROWS, GroupSizes, row_numbers
from trialkit.operators.joins import join_on_keys
from trialkit.operators.summarise import SummarySpec, SummaryTable
from trialkit.sources.checkpoints import materialise
from trialkit.sources.results import ResultSet

CONDITION = "condition_idx"
SLOT = "__slot"
#: Results that one task combines.
FAN_IN = 16
#: Calls of a function over small results that one task makes.
CALLS = 500
NODE = "__node"
PIECE = "__piece"
TAG = "__tag"


def map_by_condition(
    results: ResultSet | DataFrame,
    function: SummarySpec | Callable[..., pd.DataFrame] | Callable[..., Iterator[pd.DataFrame]],
    *arguments,
    schema: str | None = None,
    merge: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
    merge_schema: str | None = None,
    combine: Callable[[DataFrame], object] | Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame] | None = None,
    associative: bool = False,
    fan_in: int = FAN_IN,
    condition: str = CONDITION,
    block_rows: int | None = None,
    sizes: GroupSizes | None = None,
    **options,
):
    """Apply ``function`` to the rows of each condition and bind the results by rows.

    * A summary spec runs as one Spark aggregation over the whole table: conditions are part of its
      key, so the result is the same and nothing is handed to Python.
    * A pandas function gets the rows of a condition as one frame and returns rows of ``schema``. The
      frame holds the whole condition in the memory of one task, however many rows that is.
    * Written over an iterator of frames it sees the condition batch by batch and need not hold it whole.
    * With ``merge`` the function, in either form, runs on pieces of a condition of at most ``block_rows``
      rows, and ``merge`` makes the result of a condition out of the rows its pieces gave. This is the
      form for conditions of any size: no task gets a whole one. ``sizes`` saves counting them.

    What a call gives does not depend on the number of rows. ``combine`` replaces the binding of rows: it
    gets the combined frame and its result is returned. With ``associative`` it is a function of two results,
    pandas frames with the columns of the result, that gives one of the same columns. The results of all
    conditions are then merged in the order of the conditions (a NULL one first), ``fan_in`` of them in a task,
    the results of these in turn, until one is left, which is returned as a frame.
    """
    df = results.dataset() if isinstance(results, ResultSet) else results
    require_columns(df, [condition])
    if isinstance(function, SummarySpec):
        out: DataFrame | SummaryTable = function(df, block_rows, sizes)
    elif not callable(function):
        raise TypeError("function must be callable or a summary spec")
    elif schema is None:
        raise ValueError("a pandas function needs the schema of its result")
    elif merge is None:
        out = df.groupBy(named(condition)).applyInPandas(_bound(function, arguments, options), schema)
    else:
        pieces, n = _in_pieces(df, condition, block_rows or BLOCK_ROWS, sizes)
        work = _bound(function, arguments, options)
        parts = pieces.groupBy(named(condition), named(PIECE)).applyInPandas(_without_piece(work), schema)
        out = _spread(parts, condition, n).groupBy(named(condition)).applyInPandas(merge, merge_schema or schema)
    if combine is None:
        return out
    if not associative:
        return combine(out)
    return _merged(out.df if isinstance(out, SummaryTable) else out, condition, combine, fan_in)


def _merged(results: DataFrame, condition: str, combine, fan_in: int) -> DataFrame:
    """Merge the results of the conditions in a tree: a task gets ``fan_in`` of them, whatever their number."""
    require_columns(results, [condition])
    if fan_in < 2:
        raise ValueError("a task must combine two results at least")
    names = results.columns
    left = materialise(results)
    order = row_numbers(left.select(named(condition)).distinct(), [], [condition], SLOT)
    order = materialise(order.withColumn(SLOT, F.col(SLOT) - 1))
    left = join_on_keys(left, order, [condition])
    schema = T.StructType([*results.schema.fields, T.StructField(SLOT, T.LongType())])

    def level(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [part[names].reset_index(drop=True) for _, part in rows.groupby(SLOT, sort=True)]
        return reduce(combine, parts).assign(**{SLOT: rows[SLOT].iloc[0] // fan_in})

    n = order.count()
    while n > 1:
        # written between the levels: a lost executor does not bring back the functions before
        n = math.ceil(n / fan_in)
        nodes = _spread(left.withColumn(NODE, F.floor(F.col(SLOT) / fan_in)), NODE, n * fan_in)
        left = materialise(nodes.groupBy(NODE).applyInPandas(level, schema))
    return left.drop(SLOT)


def _spread(rows: DataFrame, key: str, calls: int) -> DataFrame:
    """Rows by ``key`` over tasks of a bounded number of calls.

    Adaptive execution goes by bytes: it would hand the small results of all conditions to one task, and a call takes
    its time however few rows it gets.
    """
    return rows.repartition(max(1, math.ceil(calls / CALLS)), named(key))


def _takes_iterator(function) -> bool:
    hints = [str(p.annotation) for p in signature(function).parameters.values()]
    return any("Iterator" in h for h in hints)


def _bound(function, arguments, options):
    """The function of the rows alone, of the same kind for Spark's type hints.

    Spark would hand the key to a function of two parameters, even if the second has a default.
    """
    if _takes_iterator(function):

        def over_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            return function(batches, *arguments, **options)

        return over_batches

    def over_frame(rows: pd.DataFrame) -> pd.DataFrame:
        return function(rows, *arguments, **options)

    return over_frame


def _without_piece(function):
    if _takes_iterator(function):

        def over_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            return function(rows.drop(columns=PIECE) for rows in batches)

        return over_batches

    def over_frame(rows: pd.DataFrame) -> pd.DataFrame:
        return function(rows.drop(columns=PIECE))

    return over_frame


def _in_pieces(df: DataFrame, condition: str, block_rows: int, sizes: GroupSizes | None) -> tuple[DataFrame, int]:
    """Number the rows of each condition and cut the numbers into pieces of ``block_rows``; about how many conditions.

    Rows are put in order by a number that is written down with them, so equal rows are told apart and a lost
    executor renumbers nothing; columns may be of any type.
    """
    tagged = materialise(df.withColumn(TAG, F.monotonically_increasing_id()))
    numbers = row_numbers(tagged, [condition], [TAG], PIECE, block_rows, sizes)
    piece = F.floor((F.col(PIECE) - 1) / F.lit(block_rows)).cast("bigint")
    conditions = tagged.agg(F.approx_count_distinct(named(condition))).first()[0]
    return numbers.select(*[named(c) for c in df.columns], piece.alias(PIECE)), conditions
