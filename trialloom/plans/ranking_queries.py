"""Queries on variants ranked inside instances and compared across them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.functions.bundles import EXPECTED_BUNDLES
from trialloom.functions.ordering import rank_within
from trialloom.operators import clean, instances, leaderboard, policies, splits, tasks
from trialloom.plans.registry import query, rounded
from trialloom.session import staged
from trialloom.sources import testbed


def complete_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.keep_complete(clean.above_minimum(testbed.trials(spark, sf_dir)))


def staged_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The complete log written once, for queries that read it several times."""
    return staged(complete_trials(spark, sf_dir), "complete")


@query(
    "bundle_leaderboard",
    """SELECT valid_selection, count(*) AS sample_count, round(avg(full_runtime), 8) AS avg_runtime,
              round(stddev_samp(full_runtime), 8) AS std_runtime,
              CAST(sum(is_instance_best) AS BIGINT) AS win_count, round(avg(rank_in_instance), 8) AS avg_rank,
              round(quantile_cont(full_runtime, 0.5), 8) AS median_runtime,
              round(sum(is_instance_best) / greatest((SELECT count(*) FROM {complete_ids}), 1)::DOUBLE, 8) AS win_rate
       FROM {standing} GROUP BY 1""",
)
def bundle_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        leaderboard.bundle_leaderboard(complete_trials(spark, sf_dir), complete=True)
    )


@query(
    "bundle_by_stage",
    """SELECT scale_stage, valid_selection, round(avg(full_runtime), 8) AS avg_runtime,
              CAST(sum(is_instance_best) AS BIGINT) AS win_count,
              round(quantile_cont(full_runtime, 0.5), 8) AS median_runtime
       FROM {standing} GROUP BY 1, 2""",
)
def bundle_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        leaderboard.bundle_by_stage(complete_trials(spark, sf_dir), complete=True)
    )


_LEADERBOARD_ALL = """
    SELECT valid_selection, count(*) AS sample_count, round(avg(full_runtime), 8) AS avg_runtime,
           round(stddev_samp(full_runtime), 8) AS std_runtime,
           CAST(sum(CASE WHEN abs(full_runtime - best) <= 1e-8 + 1e-5 * abs(best) THEN 1 ELSE 0 END) AS BIGINT) AS win_count,
           round(avg(place), 8) AS avg_rank, round(quantile_cont(full_runtime, 0.5), 8) AS median_runtime,
           round(sum(CASE WHEN abs(full_runtime - best) <= 1e-8 + 1e-5 * abs(best) THEN 1 ELSE 0 END)
                 / (SELECT count(DISTINCT instance_id) FROM {tl})::DOUBLE, 8) AS win_rate
    FROM (SELECT *, min(full_runtime) OVER (PARTITION BY instance_id) AS best,
                 rank() OVER (PARTITION BY instance_id ORDER BY full_runtime) AS place FROM {tl}) t
    GROUP BY 1"""


@query("bundle_leaderboard_spread", _LEADERBOARD_ALL)
def bundle_leaderboard_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaderboard of the unfiltered log, on the path for instances of unknown size."""
    return rounded(leaderboard.bundle_leaderboard(testbed.trials(spark, sf_dir)))


@query(
    "bit_effects",
    "\nUNION ALL ".join(
        f"""SELECT 'bundle_bit_{i}' AS feature,
                   round(avg(full_runtime) FILTER (WHERE (bundle_no >> {6 - i}) & 1 = 0), 8) AS runtime_when_0,
                   round(avg(full_runtime) FILTER (WHERE (bundle_no >> {6 - i}) & 1 = 1), 8) AS runtime_when_1,
                   round(avg(full_runtime) FILTER (WHERE (bundle_no >> {6 - i}) & 1 = 1)
                         - avg(full_runtime) FILTER (WHERE (bundle_no >> {6 - i}) & 1 = 0), 8) AS delta_1_minus_0
            FROM {{complete}}"""
        for i in range(1, 7)
    ),
)
def bit_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(leaderboard.bit_effects(complete_trials(spark, sf_dir)))


_ACTIVE = """((bundle_no >> 5) & 1) + ((bundle_no >> 4) & 1) + ((bundle_no >> 3) & 1) AS root_active_count,
       ((bundle_no >> 2) & 1) + ((bundle_no >> 1) & 1) + (bundle_no & 1) AS nonroot_active_count"""


@query(
    "active_interaction",
    f"SELECT {_ACTIVE}, round(avg(full_runtime), 8) AS avg_runtime FROM {{complete}} GROUP BY 1, 2",
)
def active_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(leaderboard.active_interaction(complete_trials(spark, sf_dir)))


@query(
    "effect_union",
    "\nUNION ALL ".join(
        f"""SELECT 'bundle_bit_{i}' AS feature,
                   round(avg(full_runtime) FILTER (WHERE (bundle_no >> {6 - i}) & 1 = 0), 8) AS runtime_when_0,
                   round(avg(full_runtime) FILTER (WHERE (bundle_no >> {6 - i}) & 1 = 1), 8) AS runtime_when_1,
                   round(avg(full_runtime) FILTER (WHERE (bundle_no >> {6 - i}) & 1 = 1)
                         - avg(full_runtime) FILTER (WHERE (bundle_no >> {6 - i}) & 1 = 0), 8) AS delta_1_minus_0,
                   NULL AS root_active_count, NULL AS nonroot_active_count, NULL AS avg_runtime
            FROM {{complete}}"""
        for i in range(1, 7)
    )
    + f"""
    UNION ALL SELECT NULL, NULL, NULL, NULL, {_ACTIVE}, round(avg(full_runtime), 8) FROM {{complete}}
    GROUP BY 5, 6""",
)
def effect_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(leaderboard.bundle_effects(complete_trials(spark, sf_dir)))


# --- instances ---------------------------------------------------------------------------


@query(
    "instance_summary",
    """SELECT instance_id, bundle_count, best_bundle, worst_bundle, round(best_runtime, 8) AS best_runtime,
              round(worst_runtime, 8) AS worst_runtime, round(mean_runtime, 8) AS mean_runtime,
              round(runtime_std, 8) AS runtime_std, round(baseline_runtime, 8) AS baseline_runtime,
              scale_phase, scale_stage, size_signature, round(worst_runtime - best_runtime, 8) AS runtime_range,
              round(baseline_runtime - best_runtime, 8) AS best_vs_baseline_gain,
              round(CASE WHEN baseline_runtime > 0 THEN (baseline_runtime - best_runtime) / baseline_runtime END, 8)
                  AS best_vs_baseline_gain_pct,
              round(mean_runtime - best_runtime, 8) AS best_vs_mean_gain
       FROM {instances}""",
)
def instance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On the log before the completeness test, where some instances lack the baseline."""
    return rounded(instances.instance_summary(clean.above_minimum(testbed.trials(spark, sf_dir))))


@query(
    "instance_overview",
    """SELECT count(*) AS instance_count, round(avg(best_runtime), 8) AS avg_best_runtime,
              round(avg(worst_runtime - best_runtime), 8) AS avg_runtime_range,
              round(avg(baseline_runtime - best_runtime), 8) AS avg_best_vs_baseline_gain,
              round(avg(CASE WHEN baseline_runtime > 0 THEN (baseline_runtime - best_runtime) / baseline_runtime END), 8)
                  AS avg_best_vs_baseline_gain_pct,
              round(quantile_cont(worst_runtime - best_runtime, 0.5), 8) AS median_runtime_range,
              round(quantile_cont(baseline_runtime - best_runtime, 0.5), 8) AS median_best_vs_baseline_gain
       FROM {instances}""",
)
def instance_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = instances.instance_summary(clean.above_minimum(testbed.trials(spark, sf_dir)))
    return rounded(instances.instance_overview(summary))


@query(
    "baseline_best_pairs",
    """SELECT instance_id, round(baseline_runtime, 8) AS baseline_runtime, round(best_runtime, 8) AS best_runtime,
              round((SELECT greatest(max(baseline_runtime), max(best_runtime)) FROM {instances}
                     WHERE baseline_runtime IS NOT NULL), 8) AS axis_max
       FROM {instances} WHERE baseline_runtime IS NOT NULL""",
)
def baseline_best_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = instances.instance_summary(clean.above_minimum(testbed.trials(spark, sf_dir)))
    return rounded(instances.baseline_best_pairs(summary))


_CELL = "instance_id, valid_selection, round(full_runtime, 8) AS full_runtime"


@query(
    "group_best",
    f"SELECT {_CELL}, round(min(full_runtime) OVER (PARTITION BY instance_id), 8) AS best_runtime FROM {{tl}}",
)
def group_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = leaderboard.with_group_best(testbed.trials(spark, sf_dir))
    return rounded(best.select("instance_id", "valid_selection", "full_runtime", "best_runtime"))


_RANKS = """SELECT instance_id, valid_selection,
       rank() OVER (PARTITION BY instance_id ORDER BY full_runtime) AS rank_in_instance FROM {tl}"""


@query("rank_in_group", _RANKS)
def rank_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = rank_within(
        testbed.trials(spark, sf_dir),
        ["instance_id"],
        "full_runtime",
        name="rank_in_instance",
    )
    return ranked.select("instance_id", "valid_selection", F.col("rank_in_instance").cast("long"))


@query("rank_in_group_spread", _RANKS)
def rank_in_group_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ranks on the path for groups of unknown size."""
    ranked = rank_within(testbed.trials(spark, sf_dir), ["instance_id"], "full_runtime", name="rank_in_instance")
    return ranked.select("instance_id", "valid_selection", F.col("rank_in_instance").cast("long"))


@query(
    "argmin_argmax",
    """SELECT instance_id, best_bundle, round(best_runtime, 8) AS best_runtime, worst_bundle,
              round(worst_runtime, 8) AS worst_runtime FROM {instances}""",
)
def argmin_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(instances.argmin_argmax(clean.above_minimum(testbed.trials(spark, sf_dir))))


@query(
    "dense_rank_desc",
    """SELECT instance_id, bundle_count, dense_rank() OVER (ORDER BY bundle_count DESC) AS size_rank
       FROM {instances}""",
)
def dense_rank_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances by their number of rows, largest first."""
    sizes = clean.above_minimum(testbed.trials(spark, sf_dir)).groupBy("instance_id").agg(
        F.count(F.lit(1)).alias("bundle_count")
    )
    return rank_within(
        sizes,
        [],
        "bundle_count",
        name="size_rank",
        method="dense",
        ascending=False,
    )


@query(
    "first_in_group",
    """SELECT instance_id, scale_phase, scale_stage, round(full_runtime, 8) AS full_runtime
       FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY valid_selection) AS place FROM {kept}) t
       WHERE place = 1""",
)
def first_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = clean.above_minimum(testbed.trials(spark, sf_dir))
    return rounded(instances.first_in_group(log, "scale_phase", "scale_stage", "full_runtime"))


@query(
    "baseline_lookup",
    f"""SELECT {_CELL}, round(baseline_runtime, 8) AS baseline_runtime
        FROM {{kept}} JOIN (SELECT instance_id, baseline_runtime FROM {{instances}}) b USING (instance_id)""",
)
def baseline_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    looked = instances.baseline_lookup(clean.above_minimum(testbed.trials(spark, sf_dir)))
    return rounded(looked.select("instance_id", "valid_selection", "full_runtime", "baseline_runtime"))


@query(
    "mixed_sort",
    """SELECT scale_stage, valid_selection, count(*) AS n, round(avg(full_runtime), 8) AS avg_runtime
       FROM {complete} GROUP BY 1, 2 ORDER BY scale_stage, n DESC, avg_runtime""",
)
def mixed_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = complete_trials(spark, sf_dir).groupBy("scale_stage", "valid_selection").agg(
        F.count(F.lit(1)).alias("n"), F.avg("full_runtime").alias("avg_runtime")
    )
    return rounded(grouped).orderBy(F.col("scale_stage").asc(), F.col("n").desc(), F.col("avg_runtime").asc())


@query(
    "top_n",
    """SELECT valid_selection, CAST(sum(is_instance_best) AS BIGINT) AS win_count,
              round(avg(full_runtime), 8) AS avg_runtime
       FROM {standing} GROUP BY 1 ORDER BY sum(is_instance_best) DESC, avg(full_runtime) LIMIT 10""",
)
def top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten bundles at the head of the leaderboard."""
    standing = leaderboard.with_standing(complete_trials(spark, sf_dir), complete=True)
    wins = standing.groupBy("valid_selection").agg(
        F.sum("is_instance_best").alias("win_count"), F.avg("full_runtime").alias("avg_runtime")
    )
    return rounded(leaderboard.top_n(wins, 10, F.col("win_count").desc(), F.col("avg_runtime").asc()))


@query(
    "fastest_bundle",
    """SELECT valid_selection, round(avg(full_runtime), 8) AS avg_runtime
       FROM {complete} GROUP BY 1 ORDER BY avg(full_runtime), valid_selection LIMIT 1""",
)
def fastest_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(leaderboard.fastest_bundle(complete_trials(spark, sf_dir)))


# --- splits and policies -------------------------------------------------------------------


@query("row_holdout", "SELECT instance_id, valid_selection, split FROM {row_split}")
def row_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = splits.row_holdout(staged_trials(spark, sf_dir), unique=True)
    return split.select("instance_id", "valid_selection", "split")


@query("group_holdout", "SELECT DISTINCT instance_id, split FROM {group_split}")
def group_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.group_holdout(staged_trials(spark, sf_dir)).select("instance_id", "split").distinct()


@query(
    "split_summary",
    """SELECT count(*) FILTER (WHERE split = 'train') AS train_row_count,
              count(*) FILTER (WHERE split = 'test') AS test_row_count,
              count(DISTINCT CASE WHEN split = 'train' THEN instance_id END) AS train_instance_count,
              count(DISTINCT CASE WHEN split = 'test' THEN instance_id END) AS test_instance_count
       FROM {group_split}""",
)
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_summary(splits.group_holdout(staged_trials(spark, sf_dir)))


@query(
    "split_by_stage",
    "SELECT split, scale_phase, scale_stage, count(*) AS row_count FROM {group_split} GROUP BY 1, 2, 3",
)
def split_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_by_stage(splits.group_holdout(staged_trials(spark, sf_dir)))


_PICKS = """SELECT instance_id, valid_selection FROM (
       SELECT instance_id, valid_selection, row_number() OVER (PARTITION BY instance_id
              ORDER BY md5('7|' || instance_id || '|' || valid_selection)) AS place FROM {complete}) p WHERE place = 1"""


@query("random_pick", _PICKS)
def random_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.random_pick(complete_trials(spark, sf_dir))


@query("policy_baseline", "SELECT DISTINCT instance_id, '(0, 0, 0, 0, 0, 0)' AS valid_selection FROM {complete}")
def policy_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.constant_choice(complete_trials(spark, sf_dir))


_FASTEST = """(SELECT valid_selection FROM {complete} GROUP BY 1
               ORDER BY avg(full_runtime), valid_selection LIMIT 1)"""


@query("policy_fastest", f"SELECT DISTINCT instance_id, {_FASTEST} AS valid_selection FROM {{complete}}")
def policy_fastest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.fastest_choice(staged_trials(spark, sf_dir))


def _cases(choices: str, policy: str, view: str = "complete") -> str:
    return f"""
        SELECT c.instance_id, '{policy}' AS policy, c.valid_selection AS selected_bundle,
               c.full_runtime AS selected_runtime, o.best_runtime AS oracle_runtime,
               c.full_runtime - o.best_runtime AS regret,
               CASE WHEN c.valid_selection = o.best_bundle THEN 1 ELSE 0 END AS top1_hit
        FROM {{{view}}} c JOIN ({choices}) p
          ON p.instance_id = c.instance_id AND p.valid_selection = c.valid_selection
        JOIN {{instances}} o ON o.instance_id = c.instance_id"""


_CASE_COLUMNS = """instance_id, policy, selected_bundle, round(selected_runtime, 8) AS selected_runtime,
       round(oracle_runtime, 8) AS oracle_runtime, round(regret, 8) AS regret, top1_hit"""
_BASELINE_PICKS = "SELECT DISTINCT instance_id, '(0, 0, 0, 0, 0, 0)' AS valid_selection FROM {complete}"
_FASTEST_PICKS = f"SELECT DISTINCT instance_id, {_FASTEST} AS valid_selection FROM {{complete}}"
_ALL_CASES = "\nUNION ALL ".join(
    [
        _cases(_BASELINE_PICKS, policies.BASELINE_POLICY),
        _cases(_FASTEST_PICKS, policies.FASTEST_POLICY),
        _cases(_PICKS, policies.RANDOM_POLICY),
    ]
)


@query(
    "policy_cases",
    f"""SELECT {_CASE_COLUMNS} FROM ({_cases(
        "SELECT DISTINCT instance_id, '(0, 0, 0, 0, 0, 0)' AS valid_selection FROM {kept}", "baseline_bundle", "kept")}) t""",
)
def policy_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline everywhere, also for instances that lack it and so drop out."""
    log = clean.above_minimum(testbed.trials(spark, sf_dir))
    return rounded(policies.policy_cases(log, policies.constant_choice(log), policies.BASELINE_POLICY))


@query("standard_policy_cases", f"SELECT {_CASE_COLUMNS} FROM ({_ALL_CASES}) t")
def standard_policy_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(policies.standard_cases(staged_trials(spark, sf_dir)))


@query(
    "policy_summary",
    f"""SELECT policy, count(*) AS instance_count, round(avg(selected_runtime), 8) AS avg_selected_runtime,
               round(avg(regret), 8) AS avg_regret, round(avg(top1_hit), 8) AS top1_hit_rate,
               round(quantile_cont(regret, 0.5), 8) AS median_regret
        FROM ({_ALL_CASES}) t GROUP BY 1""",
)
def policy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = policies.standard_cases(staged_trials(spark, sf_dir))
    return rounded(policies.policy_summary(cases))


# --- task metrics ---------------------------------------------------------------------------


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete log, split by instance, predicted by the bundle's training mean."""
    return tasks.bundle_mean_predictions(splits.group_holdout(staged_trials(spark, sf_dir)))


def held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).where(F.col("split") == "test")


_AVERAGE = """SELECT instance_id, valid_selection, round(true_rank, 8) AS true_rank,
       round(pred_rank, 8) AS pred_rank FROM {ranked}"""


@query("average_rank", _AVERAGE)
def average_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = tasks.with_average_ranks(held_out(spark, sf_dir), small_groups=True)
    return rounded(ranked.select("instance_id", "valid_selection", "true_rank", "pred_rank"))


@query("average_rank_spread", _AVERAGE)
def average_rank_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ranks on the path for groups of unknown size."""
    ranked = tasks.with_average_ranks(held_out(spark, sf_dir))
    return rounded(ranked.select("instance_id", "valid_selection", "true_rank", "pred_rank"))


@query(
    "topk_hit",
    """SELECT instance_id, CASE WHEN best_place <= 1 THEN 1 ELSE 0 END AS top1_hit,
              CASE WHEN best_place <= 3 THEN 1 ELSE 0 END AS top3_hit,
              CASE WHEN best_place <= 5 THEN 1 ELSE 0 END AS top5_hit FROM {cases}""",
)
def topk_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.topk_hits(held_out(spark, sf_dir), small_groups=True)


@query("spearman_by_group", "SELECT instance_id, round(spearman, 8) AS spearman FROM {cases}")
def spearman_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tasks.spearman_by_group(held_out(spark, sf_dir), small_groups=True))


@query(
    "task_cases",
    """SELECT instance_id, bundle_count, round(true_best_runtime, 8) AS true_best_runtime,
              round(pred_selected_runtime, 8) AS pred_selected_runtime, round(spearman, 8) AS spearman,
              round(pred_selected_runtime - true_best_runtime, 8) AS regret,
              CASE WHEN best_place <= 1 THEN 1 ELSE 0 END AS top1_hit,
              CASE WHEN best_place <= 3 THEN 1 ELSE 0 END AS top3_hit,
              CASE WHEN best_place <= 5 THEN 1 ELSE 0 END AS top5_hit FROM {cases}""",
)
def task_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tasks.task_cases(held_out(spark, sf_dir), small_groups=True))


@query(
    "task_summary",
    """SELECT count(*) AS instance_count, round(avg(spearman), 8) AS avg_spearman,
              round(avg(CASE WHEN best_place <= 1 THEN 1 ELSE 0 END), 8) AS top1_hit_rate,
              round(avg(CASE WHEN best_place <= 3 THEN 1 ELSE 0 END), 8) AS top3_hit_rate,
              round(avg(CASE WHEN best_place <= 5 THEN 1 ELSE 0 END), 8) AS top5_hit_rate,
              round(avg(pred_selected_runtime - true_best_runtime), 8) AS mean_regret,
              round(max(pred_selected_runtime - true_best_runtime), 8) AS max_regret,
              round(quantile_cont(pred_selected_runtime - true_best_runtime, 0.5), 8) AS median_regret FROM {cases}""",
)
def task_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = tasks.task_cases(held_out(spark, sf_dir), small_groups=True)
    return rounded(tasks.task_summary(cases))


_METRICS = {
    "mse": "avg(power(true_runtime - pred_runtime, 2))",
    "rmse": "sqrt(avg(power(true_runtime - pred_runtime, 2)))",
    "mae": "avg(abs(true_runtime - pred_runtime))",
    "r2": "1 - avg(power(true_runtime - pred_runtime, 2)) / var_pop(true_runtime)",
}


@query(
    "regression_metrics",
    "SELECT split, "
    + ", ".join(f"round({e}, 8) AS {n}" for n, e in _METRICS.items())
    + " FROM {predicted} GROUP BY 1",
)
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tasks.regression_metrics(predictions(spark, sf_dir), ["split"]))


@query(
    "sweep_summary",
    "SELECT 'bundle_mean' AS model, "
    + ", ".join(
        f"(SELECT round({e}, 8) FROM {{{view}}} WHERE split = '{split}') AS {prefix}{split}_{n}"
        for view, prefix in (("predicted_rows", ""), ("predicted", "group_"))
        for split in ("train", "test")
        for n, e in _METRICS.items()
    ),
)
def sweep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = staged_trials(spark, sf_dir)
    rows = tasks.bundle_mean_predictions(splits.row_holdout(log, unique=True))
    groups = tasks.bundle_mean_predictions(splits.group_holdout(log))
    scored = rows.withColumn("scheme", F.lit("random")).unionByName(groups.withColumn("scheme", F.lit("group")))
    return rounded(tasks.sweep_summary(scored.withColumn("model", F.lit("bundle_mean"))))
