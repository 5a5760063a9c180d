"""How well predictions rank the bundles of each instance, and how close they are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.functions.joining import salted_join
from trialloom.functions.numeric import pearson_sql
from trialloom.functions.ordering import rank_within, summarise
from trialloom.operators.clean import BUNDLE, INSTANCE, TARGET
from trialloom.operators.instances import best_of

TOPK = (1, 3, 5)
TRUE, PRED = "true_runtime", "pred_runtime"


def bundle_mean_predictions(split: DataFrame) -> DataFrame:
    """A model-free predictor: the bundle's mean over the training side, for all rows."""
    means = split.where(F.col("split") == "train").groupBy(BUNDLE).agg(F.avg(TARGET).alias(PRED))
    return salted_join(split, means, [BUNDLE], "left").withColumn(TRUE, F.col(TARGET))


def with_average_ranks(df: DataFrame, *, small_groups: bool = False) -> DataFrame:
    """Tie-averaged ranks of true and predicted measure inside each instance."""
    ranked = rank_within(
        df, [INSTANCE], TRUE, name="true_rank", method="average", small_groups=small_groups
    )
    return rank_within(
        ranked, [INSTANCE], PRED, name="pred_rank", method="average", small_groups=small_groups
    )


def spearman_by_group(df: DataFrame, *, small_groups: bool = False) -> DataFrame:
    """Rank correlation per instance, null where either side is constant."""
    ranked = with_average_ranks(df, small_groups=small_groups)
    return ranked.groupBy(INSTANCE).agg(F.expr(pearson_sql("true_rank", "pred_rank")).alias("spearman"))


def with_predicted_place(df: DataFrame, *, small_groups: bool = False) -> DataFrame:
    """Row's place in predicted order, ties to the smaller bundle."""
    return rank_within(
        df, [INSTANCE], PRED, name="pred_place", method="first", ties=[BUNDLE], small_groups=small_groups
    )


def _hits(topk: Sequence[int]) -> dict[str, Column]:
    return {f"top{k}_hit": F.coalesce((F.col("best_place") <= k).cast("int"), F.lit(0)) for k in topk}


def topk_hits(
    df: DataFrame, topk: Sequence[int] = TOPK, *, small_groups: bool = False
) -> DataFrame:
    """Whether the truly best bundle is among the first k predicted."""
    placed = with_predicted_place(df, small_groups=small_groups)
    best = placed.groupBy(INSTANCE).agg(best_of("pred_place", TRUE).alias("best_place"))
    return best.withColumns(_hits(topk)).drop("best_place")


def task_cases(
    df: DataFrame,
    topk: Sequence[int] = TOPK,
    *,
    by: Sequence[str] = (),
    small_groups: bool = False,
) -> DataFrame:
    """Per instance: sizes, true best, what the prediction picks, regret, hits, Spearman.

    Ranks share the instance as their only shuffle key; instances of one row are left out.
    ``by`` names further columns that separate runs, such as the model.
    """
    keys = [*by, INSTANCE]
    rows = rank_within(df, keys, TRUE, name="true_rank", method="average", small_groups=small_groups)
    rows = rank_within(rows, keys, PRED, name="pred_rank", method="average", small_groups=small_groups)
    rows = rank_within(
        rows, keys, PRED, name="pred_place", method="first", ties=[BUNDLE], small_groups=small_groups
    )
    cases = (
        rows.where(F.col(INSTANCE).isNotNull())
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("bundle_count"),
            F.min(TRUE).alias("true_best_runtime"),
            best_of(TRUE, PRED).alias("pred_selected_runtime"),
            best_of("pred_place", TRUE).alias("best_place"),
            F.expr(pearson_sql("true_rank", "pred_rank")).alias("spearman"),
        )
        .where(F.col("bundle_count") >= 2)
    )
    return cases.withColumns(
        {"regret": F.col("pred_selected_runtime") - F.col("true_best_runtime"), **_hits(topk)}
    ).drop("best_place")


def task_summary(
    cases: DataFrame,
    topk: Sequence[int] = TOPK,
    *,
    by: Sequence[str] = (),
) -> DataFrame:
    """Means over the instances; without ``by`` exactly one row, also for no cases."""
    return summarise(
        cases,
        by,
        [
            F.count(F.lit(1)).alias("instance_count"),
            F.avg("spearman").alias("avg_spearman"),
            *[F.avg(f"top{k}_hit").alias(f"top{k}_hit_rate") for k in topk],
            F.avg("regret").alias("mean_regret"),
            F.max("regret").alias("max_regret"),
        ],
        {"regret": {"median_regret": 0.5}},
    )


def regression_aggregates(true: str = TRUE, pred: str = PRED) -> dict[str, Column]:
    """Aggregates mse, rmse, mae and r2 of one group."""
    y, f = F.col(true), F.col(pred)
    both = y.isNotNull() & f.isNotNull()
    error = F.when(both, y - f)
    mse = F.avg(error * error)
    return {
        "mse": mse,
        "rmse": F.sqrt(mse),
        "mae": F.avg(F.abs(error)),
        "r2": F.lit(1.0) - F.try_divide(mse, F.var_pop(F.when(both, y))),
    }


def regression_metrics(df: DataFrame, by: Sequence[str] = (), *, prefix: str = "") -> DataFrame:
    return df.groupBy(*by).agg(*[c.alias(prefix + n) for n, c in regression_aggregates().items()])


def sweep_summary(scored: DataFrame) -> DataFrame:
    """One row per model: ``train_``, ``test_``, ``group_train_`` and ``group_test_`` metrics.

    ``scored`` holds model, scheme (``random`` / ``group``), split, true and predicted measure.
    """
    metrics = regression_metrics(scored, ["model", "scheme", "split"])
    side = F.concat(F.when(F.col("scheme") == "group", "group_").otherwise(""), F.col("split"))
    names = list(regression_aggregates())
    sides = ["train", "test", "group_train", "group_test"]
    pivoted = (
        metrics.withColumn("side", side)
        .groupBy("model")
        .agg(*[F.max(F.when(F.col("side") == s, F.col(n))).alias(f"{s}_{n}") for s in sides for n in names])
    )
    return pivoted
