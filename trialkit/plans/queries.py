"""Every operator as a query over the given tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialkit.functions import stats as S
from trialkit.functions.columns import (
    complete_cases,
    finite_rows,
    normal,
    recycle,
    uniform,
    valid_time,
    with_formulas,
)
from trialkit.operators.blocks import GroupSizes, average_ranks, group_quantiles, group_sizes, row_numbers
from trialkit.operators.crossing import first_crossing, race
from trialkit.operators.inference import (
    AbcInput,
    Posterior,
    abc_cross_validate,
    abc_local_linear,
    abc_rejection,
    build_abc_input,
    condition_params,
)
from trialkit.operators.mapper import map_by_condition
from trialkit.operators.nest import as_variant, count_responses, design_table, flatten_results
from trialkit.operators.report import (
    density_curves,
    pair_correlation,
    prior_and_posterior,
    recovery_table,
    residuals,
    scaled_histogram,
    summarise_posterior,
)
from trialkit.operators.states import SummaryStates
from trialkit.operators.summarise import bind_rows, summarise
from trialkit.operators.trim import apply_trim, trim_cells, trim_thresholds
from trialkit.plans.roles import (
    event_steps,
    flagship_spec,
    nested_vectors,
    part_trials,
    seconds,
    six,
    table,
)
from trialkit.sources.checkpoints import scratch_folder
from trialkit.sources.results import ResultSet, as_results, chunk_column, dense_codes
from trialkit.streaming.crossing import race_stream, state_store
from trialkit.streaming.summary import KeyedTable, keep_summary
from trialkit.streaming.trim import append_stream, read_results_stream, replace_stream, trim_stream

Query = Callable[[SparkSession, str], DataFrame]

#: Rows of a file that a streamed table is written to: one task writes, and one reads, no more.
STREAM_FILE_ROWS = 1_000_000

# --- summaries -------------------------------------------------------------------------------


def summary_flagship(spark: SparkSession, sf: str) -> DataFrame:
    return six(flagship_spec()(seconds(spark, sf)).df)


def summary_plain(spark: SparkSession, sf: str) -> DataFrame:
    spec = summarise(
        by=["condition_idx", "item_idx"],
        wider_by=["condition_idx", "item_idx"],
        n=S.count(),
        rt_mean=S.mean("rt"),
        rt_sd=S.sd("rt"),
        rt_median=S.median("rt"),
        rt_first=S.first("rt", ["trial_idx", "rt"]),
    )
    return six(spec(seconds(spark, sf)).df)


def summary_global(spark: SparkSession, sf: str) -> DataFrame:
    spec = summarise(
        by=None,
        wider_by=None,
        n=S.count(),
        rt_mean=S.mean("rt"),
        rt_sd=S.sd("rt"),
        rt_quantiles=S.quantiles("rt", [0.025, 0.5, 0.975]),
    ) + summarise(by=["item_idx"], wider_by=None, rt_max=F.max("rt"))
    return six(spec(seconds(spark, sf)).df)


def summary_pivot_single(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    spec = summarise(by=["user_id", "event_type"], wider_by=["user_id"], value_mean=S.mean("value"))
    return six(spec(events).df)


def summary_pivot_two_keys(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(
        "l_suppkey",
        "l_returnflag",
        # a double that holds whole numbers must read as such in a column name
        F.round(F.col("l_tax") * 100 / 4).alias("tax"),
        "l_quantity",
    )
    spec = summarise(
        by=["l_suppkey", "l_returnflag", "tax"],
        wider_by=["l_suppkey"],
        n=S.count(),
        quantity=F.sum("l_quantity"),
    )
    return six(spec(lines).df)


def summary_vectors(spark: SparkSession, sf: str) -> DataFrame:
    lines = seconds(spark, sf)
    spec = summarise(
        range=S.vector([F.min("rt"), F.max("rt")]),
        moments=S.vector({"mean": F.avg("rt"), "sd": F.stddev_samp("rt")}),
        listed=S.vector([F.count(F.lit(1))], as_list=True),
        alone=S.vector([F.sum("rt")]),
    )
    return six(spec(lines).df)


def summary_join(spark: SparkSession, sf: str) -> DataFrame:
    """Both sides have a NULL key; the first keys are among orders alone, the last among customers alone."""
    orders = table(spark, sf, "orders").withColumn("value", F.col("o_totalprice") / 1000)
    bought = summarise(by="cust", wider_by="cust", mean=S.mean("value"), n=S.count())
    balance = summarise(by="cust", wider_by="cust", mean=S.mean("c_acctbal"))
    customers = table(spark, sf, "customer").withColumn("cust", F.when(F.col("c_acctbal") >= 0, F.col("c_custkey") + 10))
    orders = orders.withColumn("cust", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")))
    return six((bought(orders) + balance(customers)).df)


@F.pandas_udf(T.DoubleType())
def _width(v: pd.Series) -> float:
    return float(v.max() - v.min())


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _quarters(v: pd.Series) -> list:
    return [float(v.quantile(0.25)), float(v.quantile(0.75))]


def summary_custom(spark: SparkSession, sf: str) -> DataFrame:
    """Grouped-aggregate pandas functions, one of which returns an array, beside built-in aggregates."""
    spec = summarise(
        rt_mean=S.mean("rt"), width=_width("rt"), rt_median=S.median("rt"), quarters=_quarters("rt"), n=S.count()
    )
    table_ = spec(seconds(spark, sf)).df
    ends = [F.get("quarters", F.lit(i)).alias(name) for i, name in enumerate(("low", "high"))]
    return six(table_.select("*", *ends).drop("quarters"))


def summary_pivot_given(spark: SparkSession, sf: str) -> DataFrame:
    spec = summarise(
        by=["user_id", "event_type"], wider_by=["user_id"], pivot_values=["view", "click"], value_mean=S.mean("value")
    )
    return six(spec(table(spark, sf, "events")).df)


def summary_streamed(spark: SparkSession, sf: str) -> DataFrame:
    """A summary spec kept up to date over a file stream."""
    keys = ["condition_idx", "item_idx"]
    spec = summarise(by=keys, wider_by=keys, n=S.count(), rt_mean=S.mean("rt"), rt_sd=S.sd("rt"))
    out, log = scratch_folder(spark, "summary"), scratch_folder(spark, "summary-log")
    replace_stream(spec(_line_stream(spark, sf)).df, out, log).awaitTermination()
    return six(spark.read.parquet(out))


def summary_kept(spark: SparkSession, sf: str) -> DataFrame:
    """The same over several files, in four micro-batches, into a table of which only what changed is written."""
    keys = ["condition_idx", "item_idx"]
    lines = table(spark, sf, "lineitem")
    parts = scratch_folder(spark, "lines")
    files = max(1, math.ceil(lines.count() / 4 / STREAM_FILE_ROWS))
    lines.repartition(4 * files, "l_orderkey").write.parquet(parts)
    stream = read_results_stream(spark, parts, lines.schema, files_per_batch=files)
    spec = summarise(by=keys, wider_by=keys, n=S.count(), rt_mean=S.mean("rt"), rt_sd=S.sd("rt"))
    out, log = scratch_folder(spark, "summary"), scratch_folder(spark, "summary-log")
    keep_summary(spec(_line_roles(stream)).df, keys, out, log, buckets=16).awaitTermination()
    return six(KeyedTable(spark, out, keys).read())


def _line_stream(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    return _line_roles(spark.readStream.schema(lines.schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf))


def _line_roles(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.col("l_suppkey").alias("condition_idx"),
        F.col("l_linenumber").alias("rank_idx"),
        F.col("l_linenumber").alias("item_idx"),
        F.col("l_orderkey").alias("trial_idx"),
        (F.col("l_extendedprice") / 1000).alias("rt"),
    )


def lm_aic_by_group(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").withColumn("rt", F.col("l_extendedprice") / 1000)
    spec = summarise(
        by="l_partkey",
        wider_by="l_partkey",
        lm_coef=S.lm("rt", "l_quantity"),
        flat_coef=S.lm("rt", F.lit(1.0), "flat"),
        aic=S.gaussian_aic("rt", "l_quantity"),
    )
    return six(spec(lines).df)


def strict_mean(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice") / 1000).alias("rt")
    )
    spec = summarise(
        by="l_orderkey",
        wider_by="l_orderkey",
        loose=S.mean("rt"),
        strict=S.mean("rt", strict=True),
        strict_sd=S.sd("rt", strict=True),
        strict_median=S.median("rt", strict=True),
    )
    return six(spec(lines).df)


def response_shares(spark: SparkSession, sf: str) -> DataFrame:
    steps = event_steps(spark, sf).withColumn("choice", F.when(F.col("signed_cents") > 0, 1).otherwise(-1))
    spec = summarise(
        by="user_id",
        wider_by="user_id",
        upper=S.share(F.col("choice") == 1),
        lower=S.share(F.col("choice") == -1),
        omitted=S.omission_rate(1000),
    )
    return six(spec(steps).df)


def summary_complete(spark: SparkSession, sf: str) -> DataFrame:
    lines = part_trials(spark, sf).withColumnRenamed("rank_idx", "item_idx")
    spec = summarise(by=["condition_idx", "item_idx"], rt_mean=S.mean("rt"), rt_sd=S.sd("rt"))
    return six(spec(lines).complete().df)


def bind_summaries(spark: SparkSession, sf: str) -> DataFrame:
    lines = seconds(spark, sf)
    a = summarise(by="condition_idx", rt_mean=S.mean("rt"))(lines).df
    b = summarise(by="condition_idx", rt_sd=S.sd("rt"), n=S.count())(lines).df
    return six(bind_rows(a, b))


# --- columns ---------------------------------------------------------------------------------


def _broken_times(spark: SparkSession, sf: str) -> DataFrame:
    lines = seconds(spark, sf)
    rt = F.col("rt")
    return lines.withColumn(
        "rt",
        F.when(F.col("item_idx") == 1, F.lit(None).cast("double"))
        .when(F.col("item_idx") == 2, F.lit(float("nan")))
        .when(F.col("item_idx") == 3, -rt)
        .when(F.col("item_idx") == 4, F.lit(0.0))
        .when(F.col("item_idx") == 5, F.lit(float("inf")))
        .otherwise(rt),
    )


def valid_times(spark: SparkSession, sf: str) -> DataFrame:
    rows = _broken_times(spark, sf).where(valid_time("rt"))
    return six(rows.select("condition_idx", "trial_idx", "item_idx", "rt"))


def finite_values(spark: SparkSession, sf: str) -> DataFrame:
    rows = finite_rows(_broken_times(spark, sf), ["rt", "item_idx"])
    return six(rows.groupBy("condition_idx", "item_idx").agg(F.count(F.lit(1)).alias("n"), F.sum("rt").alias("rt_sum")))


def complete_rows(spark: SparkSession, sf: str) -> DataFrame:
    kept = complete_cases(_broken_times(spark, sf), ["rt", "trial_idx"])
    return six(kept.groupBy("condition_idx", "item_idx").agg(F.count(F.lit(1)).alias("n"), F.sum("rt").alias("rt_sum")))


def formula_columns(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return six(
        with_formulas(
            parts,
            [
                ("a", F.col("p_retailprice") * 0.9),
                ("b", F.col("a") + F.col("p_size")),
                ("p_size", F.col("p_size") * 2),
                ("c", F.col("b") / F.col("p_size")),
                ("k", 3),
                ("a", F.sqrt("a") + F.col("k")),
            ],
        )
    )


def recycled_column(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey")
    n = parts.count()
    position = F.col("p_partkey") + 1
    return six(
        parts.select(
            "p_partkey",
            recycle([1.5, 2.5, 3.5, 4.5], position, n).alias("four"),
            recycle([7.0], position, n).alias("one"),
        )
    )


def seeded_draws(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part")
    return six(
        parts.select(
            "p_partkey",
            uniform("u", "p_partkey", low=1.0, high=10.0).alias("u"),
            uniform("v", "p_partkey", "p_size", low=F.col("p_size"), high=F.lit(100.0)).alias("v"),
            normal("n", "p_partkey", mean=2.0, sd=0.5).alias("n"),
        )
    )


def design(spark: SparkSession, sf: str) -> DataFrame:
    conditions = table(spark, sf, "part").select((F.col("p_partkey") + 1).alias("condition_idx"))
    out = design_table(
        conditions,
        condition_formulas=[
            ("beta_0", uniform("beta_0", "condition_idx", low=1.0, high=5.0)),
            ("beta_1", uniform("beta_1", "condition_idx", low=-0.5, high=-0.01)),
            ("chunk_idx", chunk_column(50)),
        ],
        n_trials=3,
        trial_formulas=[("shift", uniform("shift", "condition_idx", "trial_idx"))],
        n_items=2,
        item_formulas=[("v", F.col("beta_0") + F.col("item_idx") * F.col("beta_1") + F.col("shift"))],
    )
    return six(out)


def scalar_functions(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    rows = lines.select(
        "l_orderkey",
        "l_linenumber",
        F.log(p).alias("log_p"),
        F.exp(-q / 10).alias("exp_q"),
        F.sqrt(p).alias("sqrt_p"),
        F.abs(q - 25).alias("abs_q"),
        F.ceil(p / 7).alias("ceil_p"),
        F.floor(q / 7).alias("int_div"),
        F.pmod(F.col("l_orderkey"), F.lit(7)).alias("mod_o"),
        F.greatest(q, p / 1000).alias("hi"),
        F.least(q, p / 1000).alias("lo"),
        F.format_string("%.3f", F.sqrt(p)).alias("three"),
        F.format_string("%.4f", F.log(p)).alias("four"),
        F.concat_ws("_", F.lit("item"), F.col("l_linenumber").cast("string")).alias("label"),
        F.format_string("%05d", F.col("l_linenumber")).alias("padded"),
        F.size(F.sequence(F.lit(1), F.col("l_linenumber"))).alias("steps"),
        F.size(F.array_distinct(F.array_repeat(F.col("l_linenumber"), 3))).alias("distinct_n"),
        F.element_at(F.sort_array(F.array(q, F.lit(20.0), F.lit(30.0))), 2).alias("middle"),
        F.col("l_linenumber").cast("double").alias("as_double"),
    )
    return six(rows)


# --- sources ---------------------------------------------------------------------------------


def _stored(spark: SparkSession, sf: str) -> ResultSet:
    store = ResultSet.create(spark, scratch_folder(spark, "results"), {"conditions_per_chunk": 50})
    store.append(_stored_rows(spark, sf))
    suppliers = table(spark, sf, "supplier").select(
        (F.col("s_suppkey") + 1).alias("condition_idx"), F.col("s_acctbal").alias("balance")
    )
    store.write_conditions(suppliers.withColumn("chunk_idx", chunk_column(50)))
    store.finish()
    return ResultSet.load(spark, store.path)


def _stored_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = seconds(spark, sf).withColumn("condition_idx", F.col("condition_idx") + 1)
    return rows.withColumn("chunk_idx", chunk_column(50))


def results_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """A run that stopped twice: after recording its first chunk, and after leaving rows of the second one."""
    store = ResultSet.create(spark, scratch_folder(spark, "results"))
    rows = _stored_rows(spark, sf)
    store.commit(rows.where("chunk_idx = 1"))
    store.append(rows.where("chunk_idx = 2"))
    again = ResultSet.resume(spark, store.path)
    again.commit(rows)
    again.commit(rows)
    done = ResultSet.load(spark, again.finish().path)
    return six(done.dataset().select("condition_idx", "trial_idx", "item_idx", "rt", "chunk_idx"))


def summary_states(spark: SparkSession, sf: str) -> DataFrame:
    """A result set that grows twice, summarised from the states of its chunks."""
    store = ResultSet.create(spark, scratch_folder(spark, "results"))
    states = SummaryStates(
        spark,
        scratch_folder(spark, "states"),
        by=("item_idx",),
        moments=("rt",),
        lines={"lm": ("rt", "condition_idx")},
        quantiles={"rt": [0.1, 0.5, 0.9]},
    )
    rows = _stored_rows(spark, sf)
    for part in (rows.where("chunk_idx % 2 = 1"), rows):
        store.commit(part)
        states.update(store)
    return six(states.read().df)


def results_by_parameters(spark: SparkSession, sf: str) -> DataFrame:
    store = _stored(spark, sf)
    rows = store.where_parameters({"balance": (0.0, 5000.0), "condition_idx": (5, 60)})
    return six(rows.select("condition_idx", "trial_idx", "item_idx", "rt", "chunk_idx"))


def results_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    store = _stored(spark, sf)
    return six(store.dataset().select("condition_idx", "trial_idx", "item_idx", "rt", "chunk_idx"))


def results_conditions(spark: SparkSession, sf: str) -> DataFrame:
    return six(_stored(spark, sf).conditions())


def partition_read(spark: SparkSession, sf: str) -> DataFrame:
    return six(_stored(spark, sf).chunk(1).select("condition_idx", "trial_idx", "item_idx", "rt"))


def results_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return six(_stored(spark, sf).chunks())


def observed_ranks(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    rows = as_results(
        lines,
        condition="l_suppkey",
        trial="l_orderkey",
        item="l_linenumber",
        rt=F.col("l_extendedprice") / 1000,
        model="observed",
        tie_break=["l_partkey", "l_quantity"],
    )
    return six(rows)


def observed_codes(spark: SparkSession, sf: str) -> DataFrame:
    priority = F.nullif("o_orderpriority", F.lit("3-MEDIUM")).alias("o_orderpriority")
    return six(dense_codes(table(spark, sf, "orders").select("o_orderkey", priority), "o_orderpriority", "code"))


def flatten_models(spark: SparkSession, sf: str) -> DataFrame:
    """Two models with parameters of their own, read from one folder and flattened without naming any."""
    nested = nested_vectors(spark, sf)
    drift = F.col("cond_params.drift")
    other = nested.where("condition_idx % 2 = 1").withColumns(
        {"model": F.lit("gains"), "cond_params": F.struct(drift.alias("drift"), F.transform(drift, lambda d: d > 2).alias("strong"), (F.col("condition_idx") * 2).alias("gain"))}
    )
    path = scratch_folder(spark, "models")
    for part in (nested.where("condition_idx % 2 = 0"), other):
        as_variant(part).write.mode("append").parquet(path)
    return six(flatten_results(spark.read.parquet(path)))


def flatten_nested(spark: SparkSession, sf: str) -> DataFrame:
    return six(flatten_results(nested_vectors(spark, sf)))


def nested_counts(spark: SparkSession, sf: str) -> DataFrame:
    nested = nested_vectors(spark, sf)
    return six(nested.select("condition_idx", count_responses(nested).alias("responses")))


# --- trimming --------------------------------------------------------------------------------


def trim_grid(spark: SparkSession, sf: str) -> DataFrame:
    return six(trim_cells(seconds(spark, sf)))


def trim_best(spark: SparkSession, sf: str) -> DataFrame:
    return six(trim_thresholds(seconds(spark, sf)))


def trim_best_in_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The plan for groups beyond a task's reach, forced on groups of any size."""
    return six(trim_thresholds(seconds(spark, sf), block_rows=50))


def trim_best_bounded(spark: SparkSession, sf: str) -> DataFrame:
    """A few big groups, one per line number, whose distances are found by bounds over cells of times."""
    return six(trim_thresholds(seconds(spark, sf, "l_linenumber"), block_rows=200))


def trim_applied(spark: SparkSession, sf: str) -> DataFrame:
    rows = seconds(spark, sf)
    kept = apply_trim(rows, trim_thresholds(rows), min_n_used=60)
    return six(kept.select("condition_idx", "rank_idx", "trial_idx", "rt", "trim", "q_lower", "q_upper"))


def trim_streamed(spark: SparkSession, sf: str) -> DataFrame:
    """The same trim over a file stream: the lines arrive as new files, thresholds are static."""
    bounds = trim_thresholds(seconds(spark, sf))
    rows = _line_stream(spark, sf).drop("item_idx")
    out, log = scratch_folder(spark, "trimmed"), scratch_folder(spark, "trimmed-log")
    append_stream(trim_stream(rows, bounds, 60), out, log).awaitTermination()
    kept = spark.read.parquet(out)
    return six(kept.select("condition_idx", "rank_idx", "trial_idx", "rt", "trim", "q_lower", "q_upper"))


# --- ordered scans ---------------------------------------------------------------------------


def ranks_averaged(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return six(average_ranks(lines, ["l_linenumber"], "l_quantity", "avg_rank"))


def quantiles_in_blocks(spark: SparkSession, sf: str) -> DataFrame:
    parts = group_quantiles(seconds(spark, sf), ["item_idx"], "rt", [0.1, 0.5, 0.9], block_rows=500)
    return six(parts.select("item_idx", "n", *[F.get("q", F.lit(i)).alias(f"q{i}") for i in range(3)]))


def quantiles_by_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts of both signs, a NULL group, and repeated values; every rank is found by counting."""
    lines = table(spark, sf, "lineitem").select(
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"),
        (F.round(F.col("l_extendedprice") - 50_000, 0) * F.col("l_discount")).alias("amount"),
    )
    probs = [0.0, 0.025, 0.25, 0.5, 0.75, 0.975, 1.0]
    parts = group_quantiles(lines, ["flag"], "amount", probs, block_rows=100)
    return six(parts.select("flag", "n", *[F.get("q", F.lit(i)).alias(f"q{i}") for i in range(len(probs))]))


def rows_numbered_in_blocks(spark: SparkSession, sf: str) -> DataFrame:
    events = event_steps(spark, sf).select("event_type", "event_id", "cents")
    return six(row_numbers(events, ["event_type"], ["cents", "event_id"], "place", block_rows=200))


def crossings(spark: SparkSession, sf: str) -> DataFrame:
    return six(
        first_crossing(
            event_steps(spark, sf), series=["user_id"], time="t_us", step="signed_cents", upper=20_000, lower=-10_000
        )
    )


def crossings_in_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return six(
        first_crossing(
            event_steps(spark, sf), series=["event_type"], time="t_us", step="cents", upper=2_500_000, block_rows=300
        )
    )


def race_streamed(spark: SparkSession, sf: str) -> DataFrame:
    """The same race over files of about eight days each, some steps up to two days late, in six micro-batches."""
    day = 24 * 3600 * 1_000_000
    events = event_steps(spark, sf).select(
        "user_id", "event_type", F.timestamp_micros("t_us").alias("at"), F.col("cents").cast("double").alias("cents"),
        F.floor((F.col("t_us") + F.pmod("event_id", F.lit(48)) * (day // 24)) / (8 * day)).alias("part"),
    )
    path = scratch_folder(spark, "steps")
    schema = events.drop("part").schema
    for part in range(5):
        rows = events.where(F.least("part", F.lit(4)) == part).drop("part")
        if part == 4:
            # a last step beyond all others lets the watermark pass them
            newest = events.agg((F.max("at") + F.expr("INTERVAL 4 DAYS")).alias("at"))
            rows = rows.unionByName(newest.select(F.lit(-1).cast("bigint").alias("user_id"), F.lit("none").alias("event_type"), "at", F.lit(0.0).alias("cents")))
        rows.coalesce(1).write.mode("append").parquet(path)
    stream = read_results_stream(spark, path, schema, files_per_batch=1)
    race_ = race_stream(
        stream, trial=["user_id"], item="event_type", time="at", step="cents", upper=20_000,
        max_time=25 * day, max_reached=3, late="2 days",
    )
    out, log = scratch_folder(spark, "race"), scratch_folder(spark, "race-log")
    with state_store(spark):
        append_stream(race_, out, log).awaitTermination()
    return six(spark.read.schema(race_.schema).parquet(out))


def race_ranks(spark: SparkSession, sf: str) -> DataFrame:
    hits = first_crossing(
        event_steps(spark, sf), series=["user_id", "event_type"], time="t_us", step="cents", upper=20_000
    )
    day = 24 * 3600 * 1_000_000
    return six(race(hits, trial=["user_id"], item="event_type", max_time=25 * day, max_reached=3))


# --- per-condition functions -----------------------------------------------------------------


def map_native(spark: SparkSession, sf: str) -> DataFrame:
    spec = summarise(rt_mean=S.mean("rt")) + summarise(by=["condition_idx", "item_idx"], rt_sd=S.sd("rt"))
    return six(map_by_condition(seconds(spark, sf), spec, combine=lambda t: t.df))


def map_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Filter, then summarise each condition, by a plain function of its rows."""

    def described(rows: pd.DataFrame) -> pd.DataFrame:
        kept = rows[rows["item_idx"] > 1]
        return pd.DataFrame(
            {
                "condition_idx": kept["condition_idx"].head(1),
                "n": len(kept),
                "middle": kept["rt"].median(),
                "width": kept["rt"].max() - kept["rt"].min(),
            }
        )

    rows = seconds(spark, sf).select("condition_idx", "item_idx", "rt")
    return six(map_by_condition(rows, described, schema="condition_idx long, n long, middle double, width double"))


def map_iterator(spark: SparkSession, sf: str) -> DataFrame:
    """The same over batches of a condition's rows."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, key = 0, 0.0, None
        for rows in batches:
            n, total, key = n + len(rows), total + rows["rt"].sum(), rows["condition_idx"].iloc[0]
        yield pd.DataFrame({"condition_idx": [key], "n": [n], "total": [total]})

    rows = seconds(spark, sf).select("condition_idx", "rt")
    return six(map_by_condition(rows, counted, schema="condition_idx long, n long, total double"))


def map_python(spark: SparkSession, sf: str) -> DataFrame:
    def part_sums(rows):
        out = rows[["condition_idx"]].head(1).copy()
        out["n"], out["total"], out["longest"] = len(rows), rows["rt"].sum(), rows["rt"].max()
        return out

    def whole(parts):
        out = parts[["condition_idx"]].head(1).copy()
        out["n"], out["total"], out["longest"] = parts["n"].sum(), parts["total"].sum(), parts["longest"].max()
        return out

    rows = seconds(spark, sf).select("condition_idx", "trial_idx", "item_idx", "rt")
    return six(
        map_by_condition(
            rows, part_sums, schema="condition_idx long, n long, total double, longest double", merge=whole
        )
    )


# --- inference -------------------------------------------------------------------------------


def _input(spark: SparkSession, sf: str) -> AbcInput:
    """Parts as conditions: statistics from their line items, parameters from the table of parts."""
    rows = seconds(spark, sf, "l_partkey", "l_returnflag")
    stats = {"rt_mean": S.mean("rt"), "rt_sd": S.sd("rt"), "rt_median": S.median("rt")}
    # one count serves both summaries: no group of some rows is larger than all of them
    sizes = group_sizes(rows, ["condition_idx"])
    summary = summarise(**stats)(rows, sizes=sizes).complete()
    everything = GroupSizes(sizes.total, sizes.total)
    observed = summarise(by=None, wider_by=None, **stats)(rows.where("l_returnflag = 'R'"), sizes=everything)
    parts = table(spark, sf, "part").select(
        F.col("p_partkey").alias("condition_idx"),
        F.col("p_size").cast("double").alias("size"),
        F.col("p_retailprice").alias("price"),
    )
    return build_abc_input(rows, summary, observed, ["size", "price"], conditions=parts)


def _by_item(rows: pd.DataFrame) -> pd.DataFrame:
    found = rows.groupby("item_idx", as_index=False).agg(n=("rt", "size"), low=("rt", "min"), high=("rt", "max"))
    return found.assign(condition_idx=rows["condition_idx"].iloc[0])[["condition_idx", "item_idx", "n", "low", "high"]]


def _both_items(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    how = {"condition_idx": "min", "n": "sum", "low": "min", "high": "max"}
    return pd.concat([a, b]).groupby("item_idx", as_index=False).agg(how)[list(a.columns)]


def map_combined(spark: SparkSession, sf: str) -> DataFrame:
    """Results of all conditions merged two by two, eight in a task."""
    schema = "condition_idx bigint, item_idx int, n bigint, low double, high double"
    whole = map_by_condition(
        seconds(spark, sf), _by_item, schema=schema, combine=_both_items, associative=True, fan_in=8
    )
    return six(whole)


def first_params(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("condition_idx"),
        F.col("l_orderkey").alias("trial_idx"),
        F.col("l_linenumber").alias("rank_idx"),
        "l_quantity",
        "l_discount",
    )
    return six(condition_params(lines, ["l_quantity", "l_discount"]))


def abc_input(spark: SparkSession, sf: str) -> DataFrame:
    data = _input(spark, sf)
    goal = [F.lit(v).alias(f"target_{s}") for s, v in data.target.items()]
    return six(data.df.select("*", *goal))


def abc_input_one_sided(spark: SparkSession, sf: str) -> DataFrame:
    """Parameters and statistics come from different rows, so either side has conditions of its own."""
    lines = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("condition_idx"),
        F.col("l_orderkey").alias("trial_idx"),
        F.col("l_linenumber").alias("rank_idx"),
        (F.col("l_extendedprice") / 1000).alias("rt"),
        F.col("l_discount").alias("rebate"),
        "l_quantity",
    )
    summary = summarise(rt_mean=S.mean("rt"))(lines.where("l_quantity >= 45"))
    observed = summarise(by=None, wider_by=None, rt_mean=S.mean("rt"))(lines)
    return six(build_abc_input(lines.where("l_quantity <= 3"), summary, observed, ["rebate"]).df)


def abc_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return six(abc_rejection(_input(spark, sf), 0.05).df)


def abc_nearest_in_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return six(abc_rejection(_input(spark, sf), 0.5, block_rows=100).df)


def abc_linear(spark: SparkSession, sf: str) -> DataFrame:
    post = abc_local_linear(_input(spark, sf), 0.5, ["none", "log"], heteroscedastic=False)
    return six(post.df.select("condition_idx", "adjusted_size", "adjusted_price"))


def abc_linear_rescaled(spark: SparkSession, sf: str) -> DataFrame:
    post = abc_local_linear(_input(spark, sf), 0.5, ["none", "log"])
    return six(post.df.select("condition_idx", "adjusted_size", "adjusted_price"))


def _cv(spark: SparkSession, sf: str) -> DataFrame:
    return abc_cross_validate(_input(spark, sf), 10, [0.05, 0.1])


def abc_cv(spark: SparkSession, sf: str) -> DataFrame:
    return six(_cv(spark, sf))


def abc_cv_many(spark: SparkSession, sf: str) -> DataFrame:
    """Many held-out conditions and a narrow tolerance: neighbours through the pivot index."""
    return six(abc_cross_validate(_input(spark, sf), 100, [0.02, 0.05], pruned=True))


def abc_cv_linear(spark: SparkSession, sf: str) -> DataFrame:
    return six(abc_cross_validate(_input(spark, sf), 10, [0.1, 0.2], method="loclinear"))


def cv_recovery(spark: SparkSession, sf: str) -> DataFrame:
    return six(recovery_table(_cv(spark, sf), resid_tol=0.9))


def cv_residual_density(spark: SparkSession, sf: str) -> DataFrame:
    return six(density_curves(residuals(_cv(spark, sf)), ["tol", "parameter"], "residual"))


def cv_pair_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return six(pair_correlation(_cv(spark, sf), ["size", "price"]))


def posterior_summary(spark: SparkSession, sf: str) -> DataFrame:
    post = abc_rejection(_input(spark, sf), 0.05)
    broken = post.df.withColumn("unusable", F.lit(float("inf")))
    summary = summarise_posterior(
        Posterior(broken, (*post.params, "unusable")), p10=S.quantiles("value", [0.1]), sd=S.sd("value")
    )
    return six(summary.df)


def posterior_custom(spark: SparkSession, sf: str) -> DataFrame:
    """Posterior summaries by a pandas function and a built-in expression."""
    post = abc_rejection(_input(spark, sf), 0.05)
    return six(summarise_posterior(post, ci_level=0.9, width=_width("value"), sd=S.sd("value")).df)


def histogram_scaled(spark: SparkSession, sf: str) -> DataFrame:
    return six(scaled_histogram(table(spark, sf, "events"), ["event_type"], "value"))


def density_events(spark: SparkSession, sf: str) -> DataFrame:
    return six(density_curves(table(spark, sf, "events"), ["event_type"], "value"))


def density_prior_posterior(spark: SparkSession, sf: str) -> DataFrame:
    data = _input(spark, sf)
    both = prior_and_posterior(abc_rejection(data, 0.05), data)
    return six(density_curves(both, ["type", "parameter"], "value", panel=["parameter"]))


QUERIES: dict[str, Query] = {
    "summary_flagship": summary_flagship,
    "summary_plain": summary_plain,
    "summary_global": summary_global,
    "summary_pivot_single": summary_pivot_single,
    "summary_pivot_two_keys": summary_pivot_two_keys,
    "summary_vectors": summary_vectors,
    "summary_custom": summary_custom,
    "summary_pivot_given": summary_pivot_given,
    "summary_stream": summary_streamed,
    "summary_stream_kept": summary_kept,
    "summary_join": summary_join,
    "summary_complete": summary_complete,
    "lm_aic_by_group": lm_aic_by_group,
    "strict_mean": strict_mean,
    "response_shares": response_shares,
    "bind_summaries": bind_summaries,
    "valid_times": valid_times,
    "finite_values": finite_values,
    "complete_cases": complete_rows,
    "formula_columns": formula_columns,
    "recycled_column": recycled_column,
    "seeded_draws": seeded_draws,
    "design_table": design,
    "scalar_functions": scalar_functions,
    "results_round_trip": results_round_trip,
    "results_conditions": results_conditions,
    "results_resumed": results_resumed,
    "summary_states": summary_states,
    "results_by_parameters": results_by_parameters,
    "results_chunks": results_chunks,
    "partition_read": partition_read,
    "observed_ranks": observed_ranks,
    "observed_codes": observed_codes,
    "flatten_models": flatten_models,
    "flatten_nested": flatten_nested,
    "nested_counts": nested_counts,
    "trim_grid": trim_grid,
    "trim_thresholds": trim_best,
    "trim_thresholds_in_blocks": trim_best_in_blocks,
    "trim_thresholds_bounded": trim_best_bounded,
    "trim_apply": trim_applied,
    "trim_stream": trim_streamed,
    "average_ranks": ranks_averaged,
    "quantiles_in_blocks": quantiles_in_blocks,
    "quantiles_by_selection": quantiles_by_selection,
    "row_numbers_in_blocks": rows_numbered_in_blocks,
    "first_crossing": crossings,
    "first_crossing_in_blocks": crossings_in_blocks,
    "race_rank": race_ranks,
    "race_rank_stream": race_streamed,
    "map_by_condition": map_native,
    "map_by_condition_frame": map_frame,
    "map_by_condition_iterator": map_iterator,
    "map_by_condition_python": map_python,
    "map_by_condition_combined": map_combined,
    "condition_params": first_params,
    "abc_input": abc_input,
    "abc_input_one_sided": abc_input_one_sided,
    "abc_rejection": abc_nearest,
    "abc_rejection_in_blocks": abc_nearest_in_blocks,
    "abc_loclinear": abc_linear,
    "abc_loclinear_rescaled": abc_linear_rescaled,
    "abc_cv": abc_cv,
    "abc_cv_many": abc_cv_many,
    "abc_cv_loclinear": abc_cv_linear,
    "cv_recovery": cv_recovery,
    "cv_residual_density": cv_residual_density,
    "cv_pair_correlation": cv_pair_correlation,
    "posterior_summary": posterior_summary,
    "posterior_custom": posterior_custom,
    "histogram_scaled": histogram_scaled,
    "density_curves": density_events,
    "density_prior_posterior": density_prior_posterior,
}
