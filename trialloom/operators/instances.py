"""What happens inside each instance: best, worst, baseline and gains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.functions.bundles import BASELINE_BUNDLE
from trialloom.functions.joining import salted_join
from trialloom.functions.numeric import guarded_gain
from trialloom.functions.ordering import summarise
from trialloom.operators.clean import BUNDLE, INSTANCE, TARGET


def best_of(what: str | Column, value: str = TARGET, tie: str = BUNDLE) -> Column:
    """Aggregate: ``what`` on the row with the smallest value, ties to the smaller bundle."""
    return F.min_by(what, F.when(F.col(value).isNotNull(), F.struct(value, tie)))


def worst_of(what: str | Column, value: str = TARGET, tie: str = BUNDLE) -> Column:
    """Aggregate: ``what`` on the row with the largest value, ties to the smaller bundle."""
    return F.min_by(what, F.when(F.col(value).isNotNull(), F.struct((-F.col(value)).alias("v"), tie)))


def first_of(what: str, tie: str = BUNDLE) -> Column:
    """Aggregate: ``what`` on the first row in bundle order."""
    return F.min_by(what, tie)


def argmin_argmax(df: DataFrame) -> DataFrame:
    return df.groupBy(INSTANCE).agg(
        best_of(BUNDLE).alias("best_bundle"),
        F.min(TARGET).alias("best_runtime"),
        worst_of(BUNDLE).alias("worst_bundle"),
        F.max(TARGET).alias("worst_runtime"),
    )


def first_in_group(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(INSTANCE).agg(*[first_of(c).alias(c) for c in columns])


def baseline_lookup(df: DataFrame, baseline: str = BASELINE_BUNDLE) -> DataFrame:
    """Each row with its instance's baseline measure, null where there is none."""
    base = (
        df.where(F.col(BUNDLE) == baseline)
        .groupBy(INSTANCE)
        .agg(F.min(TARGET).alias("baseline_runtime"))
    )
    return salted_join(df, base, [INSTANCE], "left")


def instance_summary(df: DataFrame, baseline: str = BASELINE_BUNDLE) -> DataFrame:
    """One row per instance from a single aggregation, which combines before the shuffle."""
    grouped = (
        df.where(F.col(INSTANCE).isNotNull())
        .groupBy(INSTANCE)
        .agg(
            F.count(F.lit(1)).alias("bundle_count"),
            best_of(BUNDLE).alias("best_bundle"),
            worst_of(BUNDLE).alias("worst_bundle"),
            F.min(TARGET).alias("best_runtime"),
            F.max(TARGET).alias("worst_runtime"),
            F.avg(TARGET).alias("mean_runtime"),
            F.stddev_pop(TARGET).alias("runtime_std"),
            F.min(F.when(F.col(BUNDLE) == baseline, F.col(TARGET))).alias("baseline_runtime"),
            first_of("scale_phase").alias("scale_phase"),
            first_of("scale_stage").alias("scale_stage"),
            first_of("size_signature").alias("size_signature"),
        )
    )
    base, best = F.col("baseline_runtime"), F.col("best_runtime")
    return grouped.withColumns(
        {
            "runtime_range": F.col("worst_runtime") - best,
            "best_vs_baseline_gain": base - best,
            "best_vs_baseline_gain_pct": guarded_gain(base, best),
            "best_vs_mean_gain": F.col("mean_runtime") - best,
        }
    )


def instance_overview(summary: DataFrame) -> DataFrame:
    return summarise(
        summary,
        [],
        [
            F.count(F.lit(1)).alias("instance_count"),
            F.avg("best_runtime").alias("avg_best_runtime"),
            F.avg("runtime_range").alias("avg_runtime_range"),
            F.avg("best_vs_baseline_gain").alias("avg_best_vs_baseline_gain"),
            F.avg("best_vs_baseline_gain_pct").alias("avg_best_vs_baseline_gain_pct"),
        ],
        {
            "runtime_range": {"median_runtime_range": 0.5},
            "best_vs_baseline_gain": {"median_best_vs_baseline_gain": 0.5},
        },
    )


def baseline_best_pairs(summary: DataFrame) -> DataFrame:
    """Baseline against best per instance, where both exist, with the common axis maximum."""
    pairs = summary.dropna(subset=["baseline_runtime", "best_runtime"]).select(
        INSTANCE, "baseline_runtime", "best_runtime"
    )
    top = pairs.agg(F.max(F.greatest("baseline_runtime", "best_runtime"))).scalar()
    return pairs.withColumn("axis_max", top)
