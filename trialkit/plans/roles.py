"""The given tables in the roles of a result table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialkit.operators.summarise import SummarySpec, summarise
from trialkit.functions import stats as S

#: Results are compared to one part in 2**20 of a unit. No sum or mean of decimal amounts lies halfway
#: between two multiples of a power of two, as they do between decimals, so noise in the last bit of a double
#: does not show.
STEPS = 2.0**20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def six(df: DataFrame) -> DataFrame:
    """Doubles to about six decimals and integers to bigint, for comparison with other engines."""

    def plain(name: str, dtype: str) -> Column:
        col = F.col("`" + name.replace("`", "``") + "`")
        if dtype in ("double", "float"):
            # adding zero turns −0 into 0
            return (F.round(col.cast("double") * STEPS) / STEPS + 0.0).alias(name)
        if dtype in ("int", "smallint", "tinyint", "bigint"):
            return col.cast("bigint").alias(name)
        return col

    return df.select(*[plain(n, t) for n, t in df.dtypes])


def seconds(spark: SparkSession, sf_dir: str, condition: str = "l_suppkey", *more: str) -> DataFrame:
    """Line items: supplier as condition, order as trial, line as item and rank, price/1000 as time."""
    return table(spark, sf_dir, "lineitem").select(
        F.col(condition).alias("condition_idx"),
        F.col("l_orderkey").alias("trial_idx"),
        F.col("l_linenumber").alias("rank_idx"),
        F.col("l_linenumber").alias("item_idx"),
        (F.col("l_extendedprice") / 1000).alias("rt"),
        *more,
    )


def part_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by part, with the part's size and price as parameters."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("condition_idx"),
        F.col("l_orderkey").alias("trial_idx"),
        F.col("l_linenumber").alias("rank_idx"),
        (F.col("l_extendedprice") / 1000).alias("rt"),
        "l_returnflag",
    )
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("condition_idx"),
        F.col("p_size").cast("double").alias("size"),
        F.col("p_retailprice").alias("price"),
    )
    return lines.join(parts, "condition_idx")


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time in microseconds and value in cents; purchases and signups count down."""
    events = table(spark, sf_dir, "events")
    cents = F.round(F.col("value") * 100).cast("bigint")
    up = F.when(F.col("event_type").isin("purchase", "signup"), F.lit(-1)).otherwise(F.lit(1))
    return events.select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)").alias("t_us"),
        cents.alias("cents"),
        (cents * up).alias("signed_cents"),
    )


def flagship_spec() -> SummarySpec:
    """Mean, quantiles, line and AIC per condition, then mean and quantiles per item, side by side."""
    return summarise(
        rt_mean=S.mean("rt"),
        rt_quantiles=S.quantiles("rt", [0.1, 0.5, 0.9]),
        lm_coef=S.lm("rt", "item_idx"),
        aic=S.gaussian_aic("rt", "item_idx"),
    ) + summarise(
        by=["condition_idx", "item_idx"],
        # an order has up to seven lines
        pivot_values=range(1, 8),
        rt_mean=S.mean("rt"),
        rt_quantiles=S.quantiles("rt", [0.1, 0.5, 0.9]),
    )


def nested_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as nested results: eight trials of eight items; an item responds above 0.1."""
    trial = F.sequence(F.lit(0), F.lit(7))
    slots = F.sequence(F.lit(1), F.lit(8))

    def at(i: Column, j: Column) -> Column:
        return F.get("embedding", (i * 8 + j - 1).cast("int")).cast("double")

    def responded(i: Column) -> Column:
        return F.filter(slots, lambda j: at(i, j) > 0.1)

    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("condition_idx"),
        F.lit("vectors").alias("model"),
        F.struct(
            F.transform(trial, lambda i: (i + F.col("label")) * 0.5).alias("drift"),
            F.transform(trial, lambda i: i * 0.25).alias("ndt"),
        ).alias("cond_params"),
        F.transform(
            trial,
            lambda i: F.struct(
                responded(i).alias("item_idx"), F.transform(responded(i), lambda j: at(i, j)).alias("rt")
            ),
        ).alias("result"),
    )
