"""Queries on feature signal, model inputs, models and the result sinks."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.columns import HEADERS, MODEL_DROP, STAT_COLUMNS
from trialloom.functions.bundles import with_bits
from trialloom.functions.arrays import with_all_stats
from trialloom.functions.ordering import summarise
from trialloom.operators import clean, features, models, signal, tasks
from trialloom.plans.analysis import analysis_tables
from trialloom.plans.clean_queries import with_model_size
from trialloom.plans.ranking_queries import complete_trials, staged_trials
from trialloom.plans.registry import query, rounded
from trialloom.plans.sql_views import MODEL_COLUMNS, per_feature
from trialloom.session import drop_path, new_path, staged
from trialloom.sources import sinks, testbed, trial_log


def instance_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array statistics once per instance, before they meet its 64 rows."""
    return with_all_stats(testbed.cells(spark, sf_dir)).select("random_seed", *STAT_COLUMNS)


def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete trials with bits, counts, model size and array statistics, written once."""
    sized = with_model_size(complete_trials(spark, sf_dir))
    return staged(sized.join(instance_stats(spark, sf_dir), "random_seed", "left"), "model")


# --- signal --------------------------------------------------------------------------------


@query("candidate_features", f"SELECT feature FROM ({per_feature('count(*) AS n')}) f")
def candidate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.candidate_table(model_table(spark, sf_dir))


@query(
    "feature_summary",
    per_feature(
        "round(count(x) / count(*)::DOUBLE, 8) AS valid_ratio, round(avg(x), 6) AS mean, "
        "round(stddev_pop(x), 6) AS std, count(DISTINCT x) AS nunique"
    ),
)
def feature_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signal.feature_summary(model_table(spark, sf_dir)), 6)


@query(
    "signal_to_measure",
    per_feature(
        "round(corr(x, full_runtime), 8) AS pearson_with_runtime, "
        "round(abs(corr(x, full_runtime)), 8) AS abs_pearson_with_runtime"
    ),
)
def signal_to_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signal.signal_to_measure(model_table(spark, sf_dir)))


@query(
    "signal_to_best",
    per_feature(
        "round(corr(x, is_best), 8) AS pearson_with_optimal_flag, "
        "round(abs(corr(x, is_best)), 8) AS abs_pearson_with_optimal_flag"
    ),
)
def signal_to_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signal.signal_to_best(model_table(spark, sf_dir), complete=True))


_ENCODED = """
    SELECT instance_key, CAST(dense_rank() OVER (ORDER BY scale_phase) - 1 AS INTEGER) AS scale_phase,
           CAST(dense_rank() OVER (ORDER BY scale_stage) - 1 AS INTEGER) AS scale_stage,
           CAST(dense_rank() OVER (ORDER BY size_signature) - 1 AS INTEGER) AS size_signature,
           customer_num, CASE WHEN comment IS NULL THEN -1
             ELSE CAST(dense_rank() OVER (ORDER BY comment NULLS LAST) - 1 AS INTEGER) END AS comment
    FROM (SELECT random_seed AS instance_key, scale_phase, scale_stage, size_signature,
                 CAST(customer_num AS DOUBLE) AS customer_num,
                 CASE WHEN bundle_no % 5 <> 0 THEN 'b' || bundle_no END AS comment FROM {tl}) t"""


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    comment = F.when(F.col("bundle_no") % 5 != 0, F.concat(F.lit("b"), F.col("bundle_no")))
    return testbed.trials(spark, sf_dir).select(
        F.col("random_seed").alias("instance_key"),
        "scale_phase",
        "scale_stage",
        "size_signature",
        F.col("customer_num").cast("string").alias("customer_num"),
        comment.alias("comment"),
    )


@query("encode_mixed", _ENCODED)
def encode_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.encode_mixed(_mixed(spark, sf_dir))


@query("encode_mixed_spread", _ENCODED)
def encode_mixed_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same codes on the path for any number of distinct values."""
    return signal.encode_mixed(_mixed(spark, sf_dir))


# --- augmented table and ablation ------------------------------------------------------------

_AUGMENTED = "SELECT random_seed, valid_selection, " + ", ".join(
    [f"bundle_bit_{i}" for i in range(1, 7)] + [f"round({c}, 8) AS {c}" for c in STAT_COLUMNS]
) + " FROM {model}"


def augmented_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference order of work: the log with its cells, then statistics and bits."""
    cells = testbed.cells(spark, sf_dir).drop("customer_num", "service_num", "product_num")
    stats = with_all_stats(cells)
    return with_bits(complete_trials(spark, sf_dir)).join(stats, "random_seed", "left")


@query("augment", _AUGMENTED)
def augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = augmented_trials(spark, sf_dir)
    return rounded(
        table.select("random_seed", "valid_selection", *[f"bundle_bit_{i}" for i in range(1, 7)], *STAT_COLUMNS)
    )


_SPLIT_DROP = [c for c in models.SPLIT_SELECTION_DROP if c in MODEL_COLUMNS]
_GAIN_DROP = [c for c in models.GAIN_SELECTION_DROP if c in MODEL_COLUMNS]


@query(
    "ablate_features",
    " UNION ALL ".join(
        [f"SELECT 'split_manual' AS scheme, '{c}' AS removed, count({c}) AS filled, count(*) AS n FROM {{model}}" for c in _SPLIT_DROP]
        + [f"SELECT 'gain_manual' AS scheme, '{c}' AS removed, count({c}) AS filled, count(*) AS n FROM {{model}}" for c in _GAIN_DROP]
    ),
)
def ablate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features each hand-made selection removes from those present, and in how many rows they have a value."""
    table = model_table(spark, sf_dir)
    parts = None
    for scheme, unwanted in (("split_manual", models.SPLIT_SELECTION_DROP), ("gain_manual", models.GAIN_SELECTION_DROP)):
        removed = features.removed_features(table.columns, unwanted)
        if not removed:
            continue
        counts = table.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in removed])
        rows = counts.unpivot(["n"], removed, "removed", "filled").select(F.lit(scheme).alias("scheme"), "removed", "filled", "n")
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


# --- sinks -----------------------------------------------------------------------------------


@query("write_augmented", _AUGMENTED)
def write_augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "augmented")
    sinks.write_dataset(augmented_trials(spark, sf_dir), path)
    back = spark.read.parquet(path)
    return rounded(
        back.select("random_seed", "valid_selection", *[f"bundle_bit_{i}" for i in range(1, 7)], *STAT_COLUMNS)
    )


@query(
    "write_tables",
    f"""SELECT * FROM (VALUES ('01_data_quality_summary', 1), ('01_structured_length_checks', 10), ('02_runtime_summary', 1),
               ('03_instance_overview', 1), ('04_bundle_effect_summary', 22), ('06_split_summary', 1),
               ('06_baseline_policy_summary', 3)) fixed("table", n)
        UNION ALL SELECT '02_runtime_by_stage', count(DISTINCT scale_stage) FROM {{complete}}
        UNION ALL SELECT '02_runtime_by_signature', count(DISTINCT size_signature) FROM {{complete}}
        UNION ALL SELECT '03_instance_summary', count(DISTINCT instance_id) FROM {{complete}}
        UNION ALL SELECT '04_bundle_summary', count(DISTINCT valid_selection) FROM {{complete}}
        UNION ALL SELECT '04_bundle_stage_summary', count(DISTINCT (scale_stage, valid_selection)) FROM {{complete}}
        UNION ALL SELECT t, count(*) FROM ({per_feature('1 AS one')}) f,
          (VALUES ('05_feature_signal_to_runtime'), ('05_feature_signal_to_optimal'), ('05_feature_scalar_summary')) n(t)
          GROUP BY 1
        UNION ALL SELECT '06_split_stage_distribution', count(DISTINCT (split, scale_phase, scale_stage)) FROM {{group_split}}""",
)
def write_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All analysis tables written, and their rows counted from the files."""
    clean = staged_trials(spark, sf_dir)
    cells = testbed.cells(spark, sf_dir).drop("customer_num", "service_num", "product_num")
    augmented = staged(with_model_size(clean).join(with_all_stats(cells), "random_seed", "left"), "augmented")
    tables = analysis_tables(clean, augmented)
    folder = new_path(spark, "tables")
    sinks.write_tables(tables, folder)
    counts = None
    for name in tables:
        n = spark.read.parquet(os.path.join(folder, name)).agg(F.count(F.lit(1)).alias("n"))
        row = n.select(F.lit(name).alias("table"), "n")
        counts = row if counts is None else counts.unionByName(row)
    return counts


_PRINTED = [c for c, _ in HEADERS] + STAT_COLUMNS + [f"bundle_bit_{i}" for i in range(1, 7)]


@query(
    "csv_to_inputs",
    f"""SELECT instance_id, valid_selection, round(full_runtime, 8) AS full_runtime,
               CAST(customer_num AS DOUBLE) AS customer_num, CAST(bundle_bit_2 AS DOUBLE) AS bundle_bit_2,
               round(service_time_median, 8) AS service_time_median,
               CAST({len([c for c in _PRINTED if c not in MODEL_DROP and c != 'full_runtime'])} AS BIGINT) AS features
        FROM {{model}}""",
)
def csv_to_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way: printed 81-column log, cleaning, augmented log as CSV, model inputs.

    Printed matrices take most of the disk, so both CSV logs are packed, and the first goes when it has been read.
    """
    path, derived = new_path(spark, "printed"), new_path(spark, "derived")
    sinks.write_csv(testbed.printed_log(spark, sf_dir), path, compression="gzip")
    log = staged(clean.clean_log(trial_log.from_headers(trial_log.scan_trial_log(spark, path))), "log")
    drop_path(spark, path)
    augmented = trial_log.to_headers(features.augmented(log), rest=True)
    sinks.write_dataset(augmented, derived, as_csv=True, compression="gzip")
    back = trial_log.from_headers(trial_log.scan_trial_log(spark, derived))
    # encoding reads the log several times, the CSV is to be parsed once
    inputs, names = features.model_inputs(staged(clean.coerce(back, "full_runtime"), "back"))
    return rounded(
        inputs.select(
            F.col("meta_instance_id").alias("instance_id"),
            F.col("meta_valid_selection").alias("valid_selection"),
            F.col(features.LABEL).alias("full_runtime"),
            "customer_num",
            "bundle_bit_2",
            "service_time_median",
            F.lit(len(names)).cast("long").alias("features"),
        )
    )


# --- models ------------------------------------------------------------------------------------


_FITS: dict[tuple[str, str], tuple[models.Fits, list[str]]] = {}


def fits_of(spark: SparkSession, sf_dir: str) -> tuple[models.Fits, list[str]]:
    """Model inputs and all fits made on them in this application; queries share them.

    Inputs and scores are written tables, so a later query reads what an earlier one fitted.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FITS:
        inputs, names = features.model_inputs(model_table(spark, sf_dir).drop("ordinal", "bundle_no"))
        _FITS[key] = models.Fits(staged(inputs, "inputs")), names
    return _FITS[key]


def _scores(spark: SparkSession, sf_dir: str, learner: str) -> DataFrame:
    """Scores of a registered learner under the holdout by instance, at the full number of rounds."""
    fits, names = fits_of(spark, sf_dir)
    return fits.scores(learner, names, models.model_registry()[learner], "group")


# Predictions of other libraries can't be repeated in SQL: what is checked is that every held-out row
# is scored, and that the model's error on its training rows is below that of a predictor without a
# model (by one per cent; the linear learner by any share), whose error the SQL works out: the
# bundle's mean for learners that can tell single rows apart, the mean of all for the others, and
# for the kernel learner, which minimises absolute errors, the median.
_PLAIN = {
    "bundle": "sqrt(avg((y - avg_by) * (y - avg_by))) FROM (SELECT full_runtime AS y, avg(full_runtime) OVER (PARTITION BY valid_selection) AS avg_by",
    "all": "sqrt(avg((y - mean) * (y - mean))) FROM (SELECT full_runtime AS y, avg(full_runtime) OVER () AS mean",
    "median": "avg(abs(y - middle)) FROM (SELECT full_runtime AS y, median(full_runtime) OVER () AS middle",
}


def _held_out_sql(kind: str) -> str:
    return f"""
    SELECT instance_id, valid_selection, round(full_runtime, 8) AS true_runtime,
           round((SELECT {_PLAIN[kind]} FROM {{group_split}} WHERE split = 'train') t), 6) AS plain_error, true AS better
    FROM {{group_split}} WHERE split = 'test'"""


def _held_out(scored: DataFrame, kind: str) -> DataFrame:
    """Held-out rows, the training error without a model, and whether the model's is smaller."""
    rows = scored.select("instance_id", "valid_selection", "split", F.col("true_runtime").alias(clean.TARGET), F.col("pred_runtime").alias("own"))
    train = rows.where("split = 'train'")
    if kind == "bundle":
        plain = tasks.bundle_mean_predictions(train)
    elif kind == "all":
        plain = train.withColumn("pred_runtime", F.lit(train.agg(F.avg(clean.TARGET)).first()[0]))
    else:
        middle = summarise(train, [], [F.count("*").alias("n")], {clean.TARGET: {"middle": 0.5}}).first()["middle"]
        plain = train.withColumn("pred_runtime", F.lit(middle))

    def off(c: str) -> Column:
        miss = F.col(clean.TARGET) - F.col(c)
        return F.avg(F.abs(miss)) if kind == "median" else F.sqrt(F.avg(miss * miss))

    plain_error, own = plain.agg(off("pred_runtime"), off("own")).first()
    missing = rows.where("own is null or isnan(own)").count()
    better = not missing and own is not None and own < (0.9999 if kind == "all" else 0.99) * plain_error
    return rows.where("split = 'test'").select(
        "instance_id", "valid_selection", F.col(clean.TARGET).alias("true_runtime"), F.round(F.lit(plain_error), 6).alias("plain_error"),
        F.lit(better).alias("better"),
    )


def _fit_query(name: str, learner: str, kind: str) -> None:
    @query(name, _held_out_sql(kind))
    def fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(_held_out(_scores(spark, sf_dir, learner), kind))


for _name, _learner, _kind in (
    ("fit_boosted_a", "boosted_a", "bundle"),
    ("fit_boosted_b", "boosted_b", "all"),
    ("fit_forest", "random_forest", "bundle"),
    ("fit_boosted_c", "gradient_boosting", "bundle"),
    ("fit_kernel", "kernel", "median"),
    ("fit_linear", "linear_regression", "all"),
):
    _fit_query(_name, _learner, _kind)


@query(
    "fit_linear_one",
    """SELECT round(regr_slope(full_runtime, customer_num), 6) AS slope,
              round(regr_intercept(full_runtime, customer_num), 6) AS intercept
       FROM {group_split} WHERE split = 'train'""",
)
def fit_linear_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linear learner on one feature, where its weights have a closed form."""
    fits, _ = fits_of(spark, sf_dir)
    ready = fits.prepared(["customer_num"], "group")
    fitted = models.fit(ready, models.model_registry()["linear_regression"]).stages[-1]
    row = (float(fitted.coefficients[0]), float(fitted.intercept))
    return rounded(spark.createDataFrame([row], "slope double, intercept double"), 6)


@query(
    "score_holdout",
    """SELECT scale_phase, scale_stage, size_signature, random_seed, instance_id, valid_selection, split,
              round(full_runtime, 8) AS true_runtime
       FROM {group_split} WHERE split = 'test'""",
)
def score_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test-side rows that got a prediction, with all keys of the row."""
    scored = _scores(spark, sf_dir, "linear_regression").where("split = 'test' and pred_runtime is not null")
    keys = "scale_phase scale_stage size_signature random_seed instance_id valid_selection split true_runtime"
    return rounded(scored.select(*keys.split()))


@query("feature_importance")
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits, names = fits_of(spark, sf_dir)
    return fits.importances("boosted_a", names, models.model_registry()["boosted_a"])


@query(
    "importance_rules",
    """SELECT 'one_row_per_feature' AS rule, true AS holds UNION ALL SELECT 'no_negative_value', true
       UNION ALL SELECT 'more_gain_ranks_before', true UNION ALL SELECT 'ranks_without_gaps', true
       UNION ALL SELECT 'some_feature_used', true""",
)
def importance_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for the importances of any boosted model."""
    _, names = fits_of(spark, sf_dir)
    table = feature_importance(spark, sf_dir)
    by_gain = table.groupBy("gain_rank").agg(F.min("gain_importance").alias("low"), F.max("gain_importance").alias("high"))
    ranks = by_gain.agg(
        F.max("gain_rank").alias("last"), F.count("*").alias("n"), F.count_if(F.expr("low != high")).alias("mixed"),
        F.expr("array_sort(collect_list(struct(gain_rank, low)))").alias("steps"),
    )
    falling = "forall(sequence(2, size(steps)), i -> steps[i - 2].low > steps[i - 1].low)"
    facts = table.agg(
        F.expr(f"count(*) = {len(names)} and count(distinct feature) = {len(names)}").alias("one_row_per_feature"),
        F.expr("min(gain_importance) >= 0 and min(split_importance) >= 0").alias("no_negative_value"),
        F.expr("max(split_importance) > 0").alias("some_feature_used"),
    )
    order = ranks.selectExpr(
        f"mixed = 0 and (size(steps) < 2 or {falling}) as more_gain_ranks_before", "last = n as ranks_without_gaps"
    )
    return facts.unpivot([], facts.columns, "rule", "holds").unionAll(order.unpivot([], order.columns, "rule", "holds"))


def _sweep(spark: SparkSession, sf_dir: str) -> models.Sweep:
    fits, names = fits_of(spark, sf_dir)
    return models.model_sweep(fits.inputs, names, complete=True, fits=fits)


def _ablation(spark: SparkSession, sf_dir: str) -> models.Sweep:
    fits, names = fits_of(spark, sf_dir)
    return models.ablation_sweep(fits.inputs, names, complete=True, fits=fits)


def _checked(summary: DataFrame, *more: str) -> DataFrame:
    """Of each model: how many of its sixteen metrics there are, and whether they agree."""
    sides = ("train", "test", "group_train", "group_test")
    metrics = [f"{s}_{m}" for s in sides for m in ("mse", "rmse", "mae", "r2")]
    there = " + ".join(f"if({m} is null or isnan({m}), 0L, 1L)" for m in metrics)
    agree = " and ".join(
        f"abs({s}_rmse * {s}_rmse - {s}_mse) <= 1e-6 * {s}_mse + 1e-9 and {s}_mae <= {s}_rmse + 1e-9 and {s}_r2 <= 1" for s in sides
    )
    return summary.selectExpr("model", *more, f"{there} as metrics", f"coalesce({agree}, false) as consistent")


_MODELS = ", ".join(f"('{m}')" for m in models.model_registry())
_SCHEMES = ("split_manual", models.SPLIT_SELECTION_DROP), ("gain_manual", models.GAIN_SELECTION_DROP)


@query("model_sweep", f"SELECT model, CAST(16 AS BIGINT) AS metrics, true AS consistent FROM (VALUES {_MODELS}) m(model)")
def model_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(_sweep(spark, sf_dir).whole().summary)


@query("model_sweep_summary")
def model_sweep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics themselves."""
    return _sweep(spark, sf_dir).whole().summary


@query(
    "ablation_sweep",
    """SELECT model, CAST(16 AS BIGINT) AS metrics, true AS consistent
       FROM (VALUES ('split_manual'), ('gain_manual')) m(model)""",
)
def ablation_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(_ablation(spark, sf_dir).whole().summary)


@query("ablation_sweep_summary")
def ablation_sweep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics themselves, with the number of features that were removed."""
    return _ablation(spark, sf_dir).whole().summary


#: Features of the model table: what is left of its columns without keys, label and dropped ones.
_FEATURES = [c for c in MODEL_COLUMNS if c not in MODEL_DROP and c not in ("full_runtime", "ordinal", "bundle_no")]
_EVALUATED = [*models.model_registry(), *(name for name, _ in _SCHEMES)]


@query(
    "write_eval",
    f"""SELECT "table", model, CAST(1 AS BIGINT) AS n
        FROM (VALUES {', '.join(f"('{m}')" for m in _EVALUATED)}) m(model), (VALUES ('summary'), ('task_summary')) t("table")
        UNION ALL SELECT 'cases', model, n FROM (VALUES {', '.join(f"('{m}')" for m in _EVALUATED)}) m(model),
          (SELECT count(DISTINCT instance_id) AS n FROM {{group_split}} WHERE split = 'test') tested
        UNION ALL SELECT 'importances', model, n
          FROM (VALUES ('boosted_a', {len(_FEATURES)}), ('split_manual', {len(_FEATURES) - len(set(_SPLIT_DROP))}),
                       ('gain_manual', {len(_FEATURES) - len(set(_GAIN_DROP))})) i(model, n)
        UNION ALL SELECT 'errors', 'none', 0""",
)
def write_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of both sweeps written by model, and their rows counted from the files."""
    folder = new_path(spark, "evaluation")
    counts = []
    for half, sweep in (("models", _sweep(spark, sf_dir)), ("ablation", _ablation(spark, sf_dir))):
        for name in ("summary", "task_summary", "cases", "importances", "errors"):
            path = os.path.join(folder, half, name)
            table = getattr(sweep, name)
            (sinks.write_dataset if name == "errors" else sinks.write_by_model)(table, path)
            back = spark.read.schema(table.schema).parquet(path)
            counts.append(back.selectExpr(f"'{name}' as table", "'none' as model" if name == "errors" else "model", "1L as m"))
    # a table of errors without rows counts as zero
    counts.append(spark.range(1).selectExpr("'errors' as table", "'none' as model", "0L as m"))
    rows = counts[0]
    for other in counts[1:]:
        rows = rows.unionAll(other)
    return rows.groupBy("table", "model").agg(F.sum("m").alias("n"))
