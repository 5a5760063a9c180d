"""Profiles of the measure and of the log's quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.functions.arrays import numbers_sql
from trialloom.functions.bundles import EXPECTED_BUNDLES
from trialloom.functions.numeric import finite_sql, sample_skew, to_number
from trialloom.functions.ordering import summarise
from trialloom.operators.clean import INSTANCE, SEED, TARGET

QUARTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}
HISTOGRAM_BINS = 40

# Expected length of each array column, from customers, services and products.
LENGTH_RULES = [
    ("service_time", "service_num"),
    ("service_price", "service_num"),
    ("service_cost", "service_num"),
    ("inventory", "product_num"),
    ("weight", "customer_num"),
    ("early_start", "customer_num"),
    ("late_start", "customer_num"),
    ("Ser_Pro_corr", "service_num * product_num"),
    ("transfer_matrix", "(customer_num + 2) * (customer_num + 2)"),
    ("VariableCost", "(customer_num + 2) * (customer_num + 2)"),
]


def measure_summary(df: DataFrame, by: Sequence[str] = (), *, value: str = TARGET) -> DataFrame:
    """Nine numbers per group: count, mean, population std, min, quartiles, max, sample skew."""
    x = F.expr(finite_sql(f"try_cast(`{value}` as double)"))
    # An empty group has count 0 and nulls; the columns are named as a profile reads.
    return summarise(
        df.select(*by, x.alias("_x")),
        by,
        [
            F.count("_x").alias("count"),
            F.avg("_x").alias("mean"),
            F.stddev_pop("_x").alias("std"),
            F.min("_x").alias("min"),
            F.max("_x").alias("max"),
            sample_skew("_x").alias("skew"),
        ],
        {"_x": QUARTILES},
    )


def summary_by_stage(df: DataFrame) -> DataFrame:
    return measure_summary(df, ["scale_phase", "scale_stage"])


def summary_by_signature(df: DataFrame) -> DataFrame:
    return measure_summary(df, ["size_signature"]).orderBy(
        F.col("median").desc_nulls_last(), "size_signature"
    )


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier, fully equal row."""
    copies = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    return copies.agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_row_count"))


def data_quality(df: DataFrame, expected: int = EXPECTED_BUNDLES) -> DataFrame:
    """One row: rows, instances, copies, missing keys, complete instances, group sizes."""
    per_instance = df.groupBy(INSTANCE).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(to_number(TARGET).isNull()).alias("no_target"),
        F.count_if(to_number(SEED).isNull()).alias("no_seed"),
    )
    known = F.col(INSTANCE).isNotNull()
    size = F.when(known, F.col("n"))
    return per_instance.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.count_if(known).alias("instance_count"),
        F.coalesce(F.sum("no_target"), F.lit(0)).alias("missing_target_count"),
        F.coalesce(F.sum("no_seed"), F.lit(0)).alias("missing_seed_count"),
        F.count_if(size == expected).alias("complete_instance_count"),
        F.count_if(size != expected).alias("incomplete_instance_count"),
        F.min(size).alias("min_bundle_count_per_instance"),
        F.max(size).alias("max_bundle_count_per_instance"),
    ).withColumn("duplicate_row_count", duplicate_count(df).scalar())


def length_mismatch(df: DataFrame, rules: Sequence[tuple[str, str]] = LENGTH_RULES) -> DataFrame:
    """Per row, 1 where an array's length differs from the rule."""
    return df.selectExpr(
        "*", *[f"int(size({numbers_sql(column)}) != {rule}) as {column}_mismatch" for column, rule in rules]
    )


def length_checks(df: DataFrame, rules: Sequence[tuple[str, str]] = LENGTH_RULES) -> DataFrame:
    """Per array column: rows checked, mismatches and their rate, from one pass."""
    flagged = length_mismatch(df, rules).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.expr(f"coalesce(sum({c}_mismatch), 0L)").alias(c) for c, _ in rules],
    )
    entries = ", ".join(f"named_struct('column', '{c}', 'bad', {c})" for c, _ in rules)
    return flagged.selectExpr("rows", f"explode(array({entries})) as e").select(
        "e.column",
        F.col("rows").alias("checked_rows"),
        F.col("e.bad").alias("mismatch_count"),
        (F.col("e.bad") / F.nullif(F.col("rows"), F.lit(0))).alias("mismatch_rate"),
    )


def histogram(df: DataFrame, value: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins between the smallest and largest value, empty bins included.

    The largest value belongs to the last bin; equal values all fall in the middle one.
    """
    x = F.col(value)
    ends = df.agg(F.min(x).alias("low"), F.max(x).alias("high"))
    low, high = ends.select("low").scalar(), ends.select("high").scalar()
    slot = F.when(
        high > low, F.least(F.floor((x - low) / (high - low) * bins), F.lit(bins - 1))
    ).otherwise(F.lit(bins // 2))
    counts = df.where(x.isNotNull()).groupBy((slot + 1).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def stage_label(df: DataFrame) -> DataFrame:
    return df.withColumn("stage_label", F.concat_ws("|", "scale_phase", "scale_stage"))
