"""Bundle-selection policies and their regret."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.functions.bundles import BASELINE_BUNDLE
from trialloom.functions.ordering import summarise
from trialloom.operators.clean import BUNDLE, INSTANCE, TARGET
from trialloom.operators.instances import best_of
from trialloom.operators.leaderboard import fastest_bundle
from trialloom.operators.splits import SEED, draw, random_pick

# Policy names.
BASELINE_POLICY = "baseline_bundle"
FASTEST_POLICY = "global_fastest_bundle"
RANDOM_POLICY = "random_bundle"


def constant_choice(df: DataFrame, bundle: str = BASELINE_BUNDLE) -> DataFrame:
    """The same bundle for every instance."""
    return df.select(INSTANCE).distinct().withColumn(BUNDLE, F.lit(bundle))


def fastest_choice(df: DataFrame) -> DataFrame:
    """The globally fastest bundle, fitted on all rows, for every instance."""
    fastest = fastest_bundle(df).select(BUNDLE).scalar()
    return df.select(INSTANCE).distinct().withColumn(BUNDLE, fastest)


def random_choice(df: DataFrame, *, seed: int = SEED) -> DataFrame:
    return random_pick(df, seed=seed)


def _outcome(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "regret": F.col("selected_runtime") - F.col("oracle_runtime"),
            "top1_hit": (F.col("selected_bundle") == F.col("best_bundle")).cast("int"),
        }
    ).drop("best_bundle")


def policy_cases(df: DataFrame, choices: DataFrame, policy: str) -> DataFrame:
    """What a choice table would have cost, per instance; unmatched choices drop out.

    The log meets the choices in an equi-join on (instance, bundle) and the optimum is one
    aggregate per instance.
    """
    oracle = df.groupBy(INSTANCE).agg(
        F.min(TARGET).alias("oracle_runtime"), best_of(BUNDLE).alias("best_bundle")
    )
    chosen = (
        df.select(INSTANCE, BUNDLE, TARGET)
        .join(choices.select(INSTANCE, BUNDLE), [INSTANCE, BUNDLE])
        .groupBy(INSTANCE, F.col(BUNDLE).alias("selected_bundle"))
        .agg(F.min(TARGET).alias("selected_runtime"))
    )
    return _outcome(chosen.join(oracle, INSTANCE).withColumn("policy", F.lit(policy)))


def standard_cases(df: DataFrame, *, seed: int = SEED) -> DataFrame:
    """Baseline, globally fastest and drawn bundle per instance, in one pass over the log.

    Constant choices are conditional minima and the drawn bundle is a ``min_by``, so no
    choice table has to be joined.
    """
    fastest = fastest_bundle(df).select(BUNDLE).scalar()
    cell = F.struct(F.col(BUNDLE).alias("bundle"), F.col(TARGET).alias("runtime"))
    named = df.withColumn("_fastest", fastest)
    grouped = named.groupBy(INSTANCE).agg(
        F.min(TARGET).alias("oracle_runtime"),
        best_of(BUNDLE).alias("best_bundle"),
        F.min(F.when(F.col(BUNDLE) == BASELINE_BUNDLE, cell)).alias("baseline"),
        F.min(F.when(F.col(BUNDLE) == F.col("_fastest"), cell)).alias("fastest"),
        F.min_by(cell, F.struct(draw(seed, INSTANCE, BUNDLE), TARGET)).alias("random"),
    )
    picks = F.array(
        *[
            F.when(F.col(column).isNotNull(), F.struct(F.lit(policy).alias("policy"), F.col(column).alias("cell")))
            for policy, column in (
                (BASELINE_POLICY, "baseline"),
                (FASTEST_POLICY, "fastest"),
                (RANDOM_POLICY, "random"),
            )
        ]
    )
    cases = grouped.select(
        INSTANCE, "oracle_runtime", "best_bundle", F.explode(F.array_compact(picks)).alias("p")
    ).select(
        INSTANCE,
        F.col("p.cell.bundle").alias("selected_bundle"),
        F.col("p.cell.runtime").alias("selected_runtime"),
        "oracle_runtime",
        "best_bundle",
        "p.policy",
    )
    return _outcome(cases)


def policy_summary(cases: DataFrame) -> DataFrame:
    return summarise(
        cases,
        ["policy"],
        [
            F.count(F.lit(1)).alias("instance_count"),
            F.avg("selected_runtime").alias("avg_selected_runtime"),
            F.avg("regret").alias("avg_regret"),
            F.avg("top1_hit").alias("top1_hit_rate"),
        ],
        {"regret": {"median_regret": 0.5}},
    ).orderBy("avg_regret")
