"""Variants compared over all instances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialloom.functions.bundles import BIT_COLUMNS, with_active_counts, with_bits
from trialloom.functions.numeric import is_close, safe_rate
from trialloom.functions.joining import salted_join
from trialloom.functions.ordering import rank_within, summarise
from trialloom.operators.clean import BUNDLE, INSTANCE, TARGET


def with_group_best(df: DataFrame, *, name: str = "best_runtime", complete: bool = False) -> DataFrame:
    """Repeat each instance's smallest measure on its rows.

    ``complete`` says that the log passed the completeness test, so an instance has 64 rows.
    """
    if complete:
        return df.withColumn(name, F.min(TARGET).over(Window.partitionBy(INSTANCE)))
    best = df.groupBy(INSTANCE).agg(F.min(TARGET).alias(name))
    return salted_join(df, best, [INSTANCE], "left")


def with_standing(df: DataFrame, *, complete: bool = False) -> DataFrame:
    """Add best measure, best flag (tolerant) and rank inside the instance."""
    best = with_group_best(df, complete=complete)
    flagged = best.withColumn("is_instance_best", is_close(F.col(TARGET), F.col("best_runtime")))
    return rank_within(flagged, [INSTANCE], TARGET, name="rank_in_instance", small_groups=complete)


def _scores() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("sample_count"),
        F.avg(TARGET).alias("avg_runtime"),
        F.stddev_samp(TARGET).alias("std_runtime"),
        F.sum("is_instance_best").alias("win_count"),
        F.avg("rank_in_instance").alias("avg_rank"),
    ]


def bundle_leaderboard(df: DataFrame, *, complete: bool = False) -> DataFrame:
    """Per bundle: count, mean, median, sample std, wins, mean rank and win rate.

    ``complete`` says that the log passed the completeness test, so an instance has 64 rows.
    """
    standing = with_standing(df, complete=complete)
    table = summarise(standing, [BUNDLE], _scores(), {TARGET: {"median_runtime": 0.5}}, values=df)
    instances = df.agg(F.count_distinct(INSTANCE)).scalar()
    return table.withColumn("win_rate", safe_rate(F.col("win_count"), instances)).orderBy(
        F.col("win_count").desc(), F.col("avg_runtime").asc()
    )


def bundle_by_stage(df: DataFrame, *, complete: bool = False) -> DataFrame:
    best = with_group_best(df, complete=complete)
    flagged = best.withColumn("is_instance_best", is_close(F.col(TARGET), F.col("best_runtime")))
    return summarise(
        flagged,
        ["scale_stage", BUNDLE],
        [F.avg(TARGET).alias("avg_runtime"), F.sum("is_instance_best").alias("win_count")],
        {TARGET: {"median_runtime": 0.5}},
        values=df,
    ).orderBy(F.col("scale_stage"), F.col("win_count").desc(), F.col("avg_runtime"))


def bit_effects(df: DataFrame) -> DataFrame:
    """Mean measure with each option off and on, in one pass over the log."""
    means = with_bits(df).agg(
        *[
            F.expr(f"avg({TARGET}) filter (where {bit} = {value})").alias(f"{bit}_{value}")
            for bit in BIT_COLUMNS
            for value in (0, 1)
        ]
    )
    entries = ", ".join(f"named_struct('feature', '{b}', 'off', {b}_0, 'on', {b}_1)" for b in BIT_COLUMNS)
    return means.selectExpr(f"inline(array({entries}))").selectExpr(
        "feature", "off as runtime_when_0", "on as runtime_when_1", "on - off as delta_1_minus_0"
    )


def active_interaction(df: DataFrame) -> DataFrame:
    return (
        with_active_counts(with_bits(df))
        .groupBy("root_active_count", F.col("later_active_count").alias("nonroot_active_count"))
        .agg(F.avg(TARGET).alias("avg_runtime"))
    )


def bundle_effects(df: DataFrame) -> DataFrame:
    """Both effect tables in one, columns missing on either side filled with null."""
    return bit_effects(df).unionByName(active_interaction(df), allowMissingColumns=True)


def fastest_bundle(df: DataFrame) -> DataFrame:
    """The bundle with the lowest mean measure, ties to the smaller bundle text."""
    return df.groupBy(BUNDLE).agg(F.avg(TARGET).alias("avg_runtime")).orderBy("avg_runtime", BUNDLE).limit(1)


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)
