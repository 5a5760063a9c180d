"""The whole analysis of a clean log as named tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from trialloom.operators import instances, leaderboard, policies, profile, signal, splits
from trialloom.operators.splits import SEED, TEST_SIZE


def analysis_tables(
    clean: DataFrame,
    augmented: DataFrame,
    *,
    complete: bool = True,
    test_size: float = TEST_SIZE,
    seed: int = SEED,
) -> dict[str, DataFrame]:
    """Sixteen result tables by name; the split and the choice of features run at once.

    ``complete`` says that the log passed the completeness test, so that an instance has 64
    rows. Length checks appear for the array columns present.
    """
    summary = instances.instance_summary(clean)
    split = splits.group_holdout(clean, test_size=test_size, seed=seed)
    features = signal.candidate_features(augmented)
    rules = [(c, rule) for c, rule in profile.LENGTH_RULES if c in augmented.columns]
    # The names of the result tables.
    return {
        "01_data_quality_summary": profile.data_quality(clean),
        "01_structured_length_checks": profile.length_checks(augmented, rules),
        "02_runtime_summary": profile.measure_summary(clean),
        "02_runtime_by_stage": profile.summary_by_stage(clean),
        "02_runtime_by_signature": profile.summary_by_signature(clean),
        "03_instance_summary": summary,
        "03_instance_overview": instances.instance_overview(summary),
        "04_bundle_summary": leaderboard.bundle_leaderboard(clean, complete=complete),
        "04_bundle_stage_summary": leaderboard.bundle_by_stage(clean, complete=complete),
        "04_bundle_effect_summary": leaderboard.bundle_effects(clean),
        "05_feature_signal_to_runtime": signal.signal_to_measure(augmented, features),
        "05_feature_signal_to_optimal": signal.signal_to_best(augmented, features, complete=complete),
        "05_feature_scalar_summary": signal.feature_summary(augmented, features),
        "06_split_summary": splits.split_summary(split),
        "06_split_stage_distribution": splits.split_by_stage(split),
        "06_baseline_policy_summary": policies.policy_summary(policies.standard_cases(clean, seed=seed)),
    }
