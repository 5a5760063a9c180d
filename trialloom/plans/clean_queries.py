"""Queries on reading, cleaning and completeness of the raw log, and on sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.functions import bundles as B
from trialloom.functions.numeric import guarded_gain, is_close, safe_rate
from trialloom.operators import clean, features, grids, leaderboard, profile
from trialloom.plans.registry import query, rounded
from trialloom.plans.sql_views import BUNDLE_TEXT, MODEL_SIZE
from trialloom.session import new_path
from trialloom.sources import sinks, testbed, trial_log
from trialloom.streaming import append

RAW_LIST = ", ".join(testbed.RAW_COLUMNS)
LOG = "instance_id, valid_selection, random_seed, round(full_runtime, 8) AS full_runtime"
KEPT = ["instance_id", "valid_selection", "random_seed", "full_runtime"]


# --- reading ---------------------------------------------------------------------------


@query("scan_trial_log", f"SELECT {RAW_LIST} FROM {{raw}}")
def scan_trial_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "raw-log")
    sinks.write_csv(testbed.raw_log(spark, sf_dir), path)
    return trial_log.scan_trial_log(spark, path, testbed.RAW_COLUMNS)


@query(
    "project_rename",
    """SELECT valid_selection AS "有效不等式选择", size_signature, round(full_runtime, 8) AS full_runtime,
              customer_num AS "客户数", service_num AS "服务数", product_num AS "产品数", team_num AS "服务团队数",
              scale_phase, scale_stage, random_seed FROM {tl}""",
)
def project_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trial_log.to_headers(testbed.trials(spark, sf_dir)))


# --- cleaning --------------------------------------------------------------------------


@query("drop_header_rows", f"SELECT {RAW_LIST} FROM {{headless}}")
def drop_header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.drop_header_rows(testbed.raw_log(spark, sf_dir))


@query("dedup_rows", f"SELECT {RAW_LIST} FROM {{dedup}}")
def dedup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.drop_duplicate_rows(drop_header_rows(spark, sf_dir))


@query(
    "duplicate_count",
    f"""SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_row_count
        FROM (SELECT count(*) AS n FROM {{headless}} GROUP BY {RAW_LIST}) t""",
)
def duplicate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.duplicate_count(drop_header_rows(spark, sf_dir))


@query("coerce_numeric", f"SELECT {RAW_LIST} FROM {{coerced}}")
def coerce_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.coerce(dedup_rows(spark, sf_dir), "full_runtime", "random_seed")


@query("drop_null_keys", f"SELECT {RAW_LIST} FROM {{usable}}")
def drop_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.drop_missing_keys(coerce_numeric(spark, sf_dir))


@query("min_measure", f"SELECT {RAW_LIST} FROM {{usable}} WHERE full_runtime > 0.5")
def min_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.above_minimum(drop_null_keys(spark, sf_dir))


@query("instance_key", "SELECT instance_id, valid_selection, full_runtime FROM {slow}")
def instance_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = clean.with_instance_id(min_measure(spark, sf_dir))
    return keyed.select("instance_id", "valid_selection", "full_runtime")


@query("complete_groups", "SELECT instance_id, valid_selection, full_runtime, note FROM {clean}")
def complete_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = clean.clean_log(testbed.raw_log(spark, sf_dir))
    return cleaned.select("instance_id", "valid_selection", "full_runtime", "note")


@query("semi_members", f"SELECT {LOG} FROM {{kept}} WHERE instance_id IN (SELECT instance_id FROM {{complete_ids}})")
def semi_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = clean.above_minimum(testbed.trials(spark, sf_dir))
    return rounded(clean.keep_members(log, clean.complete_instances(log)).select(*KEPT))


@query("ordered_log", f"SELECT {LOG} FROM {{complete}} ORDER BY instance_id, valid_selection")
def ordered_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = clean.keep_complete(clean.above_minimum(testbed.trials(spark, sf_dir)))
    return rounded(clean.ordered_log(log).select(*KEPT))


# --- projections and predicates ---------------------------------------------------------

@query(
    "drop_columns",
    """SELECT scale_phase, scale_stage, size_signature, ordinal, customer_num, service_num, team_num, bundle_no,
              round(full_runtime, 8) AS full_runtime FROM {tl}""",
)
def drop_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.drop_columns(testbed.trials(spark, sf_dir)))


@query(
    "meta_projection",
    "SELECT instance_id, scale_phase, scale_stage, size_signature, random_seed, valid_selection FROM {tl}",
)
def meta_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.metadata(testbed.trials(spark, sf_dir))


@query(
    "guarded_gain",
    """SELECT instance_id, round(CASE WHEN base > 0 THEN (base - best) / base END, 8) AS gain
       FROM (SELECT instance_id, min(full_runtime) AS best,
                    min(CASE WHEN valid_selection = '(0, 0, 0, 0, 0, 0)' THEN full_runtime END) AS base
             FROM {kept} GROUP BY 1) t""",
)
def gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.when(F.col("valid_selection") == B.BASELINE_BUNDLE, F.col("full_runtime"))
    grouped = clean.above_minimum(testbed.trials(spark, sf_dir)).groupBy("instance_id").agg(
        F.min("full_runtime").alias("best"), F.min(base).alias("base")
    )
    return rounded(grouped.select("instance_id", guarded_gain(F.col("base"), F.col("best")).alias("gain")))


@query(
    "safe_rate",
    """SELECT scale_stage, round(sum(CASE WHEN bundle_no = 0 THEN 1 ELSE 0 END)
                               / greatest(count(*) FILTER (WHERE bundle_no < 0), 1)::DOUBLE, 8) AS rate
       FROM {tl} GROUP BY 1""",
)
def rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, none = F.count_if(F.col("bundle_no") == 0), F.count_if(F.col("bundle_no") < 0)
    counts = testbed.trials(spark, sf_dir).groupBy("scale_stage").agg(part.alias("p"), none.alias("w"))
    return rounded(counts.select("scale_stage", safe_rate(F.col("p"), F.col("w")).alias("rate")))


@query(
    "isclose_flag",
    """SELECT instance_id, valid_selection,
              CASE WHEN abs(full_runtime - best) <= 1e-8 + 1e-5 * abs(best) THEN 1 ELSE 0 END AS is_best
       FROM (SELECT *, min(full_runtime) OVER (PARTITION BY instance_id) AS best FROM {tl}) t""",
)
def isclose_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = leaderboard.with_group_best(testbed.trials(spark, sf_dir), name="best")
    flag = is_close(F.col("full_runtime"), F.col("best")).alias("is_best")
    return best.select("instance_id", "valid_selection", flag)


@query("stage_label", "SELECT scale_phase || '|' || scale_stage AS stage_label, count(*) AS n FROM {tl} GROUP BY 1")
def stage_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.stage_label(testbed.trials(spark, sf_dir)).groupBy("stage_label").agg(F.count(F.lit(1)).alias("n"))


@query("stage_band", "SELECT random_seed, ordinal, scale_phase, scale_stage FROM {inst}")
def stage_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = testbed.table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey as random_seed", "1 + 16 * s_nationkey as ordinal"
    )
    return suppliers.select(
        "*", B.phase_of("ordinal").alias("scale_phase"), B.stage_of("ordinal").alias("scale_stage")
    )


@query(
    "size_signature",
    "SELECT size_signature, count(*) AS n, count(DISTINCT instance_id) AS instances FROM {tl} GROUP BY 1",
)
def size_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testbed.trials(spark, sf_dir).groupBy("size_signature").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("instance_id").alias("instances")
    )


def with_model_size(trials: DataFrame) -> DataFrame:
    counted = B.with_active_counts(B.with_bits(trials))
    return B.with_model_size(
        counted, "customer_num", "service_num", "product_num", "team_num", "root_active_count"
    )


@query("model_size", f"SELECT instance_id, valid_selection, {MODEL_SIZE} FROM {{tl}}")
def model_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_model_size(testbed.trials(spark, sf_dir)).select(
        "instance_id", "valid_selection", "base_num_vars", "base_num_constrs", "root_num_constrs"
    )


@query(
    "phase_delta",
    """SELECT instance_id, valid_selection,
              round(full_runtime / 2 + full_runtime - full_runtime / 4, 8) AS legacy_runtime FROM {tl}""",
)
def phase_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("full_runtime")
    phases = testbed.trials(spark, sf_dir).select(
        "instance_id", "valid_selection", (t / 4).alias("plain"), (t / 2).alias("root"), t.alias("later")
    )
    time = grids.phase_delta(F.col("root"), F.col("plain"), F.col("later")).alias("legacy_runtime")
    return rounded(phases.select("instance_id", "valid_selection", time))


_ROW_IDS = """
    SELECT instance_id, valid_selection,
           CAST(row_number() OVER (ORDER BY instance_id, valid_selection) + 100 AS BIGINT) AS id FROM {tl}"""


@query("row_ids", _ROW_IDS)
def row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = grids.row_ids(testbed.trials(spark, sf_dir), first=101)
    return numbered.select("instance_id", "valid_selection", "id")


@query("row_ids_spread", _ROW_IDS)
def row_ids_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same numbers on the path for logs of unknown size."""
    return grids.row_ids(testbed.trials(spark, sf_dir), first=101).select("instance_id", "valid_selection", "id")


@query(
    "bundle_bits",
    """SELECT instance_id, valid_selection, (bundle_no >> 5) & 1 AS bundle_bit_1, (bundle_no >> 4) & 1 AS bundle_bit_2,
              (bundle_no >> 3) & 1 AS bundle_bit_3, (bundle_no >> 2) & 1 AS bundle_bit_4,
              (bundle_no >> 1) & 1 AS bundle_bit_5, bundle_no & 1 AS bundle_bit_6 FROM {tl}""",
)
def bundle_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.with_bits(testbed.trials(spark, sf_dir).select("instance_id", "valid_selection"))


@query(
    "active_counts",
    """SELECT instance_id, valid_selection,
              ((bundle_no >> 5) & 1) + ((bundle_no >> 4) & 1) + ((bundle_no >> 3) & 1) AS root_active_count,
              ((bundle_no >> 2) & 1) + ((bundle_no >> 1) & 1) + (bundle_no & 1) AS later_active_count FROM {tl}""",
)
def active_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = B.with_active_counts(B.with_bits(testbed.trials(spark, sf_dir)))
    return counted.select("instance_id", "valid_selection", "root_active_count", "later_active_count")


@query(
    "factorial_grid",
    f"""SELECT random_seed, scale_stage, bundle_no, {BUNDLE_TEXT} AS valid_selection
        FROM (SELECT random_seed, scale_stage, CAST(n AS INTEGER) AS bundle_no FROM {{inst}}, range(64) r(n)) g""",
)
def factorial_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    instances = testbed.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("random_seed"), B.stage_of("1 + 16 * s_nationkey").alias("scale_stage")
    )
    return B.factorial_grid(instances)


# --- sinks -------------------------------------------------------------------------------


@query("append_batches", f"SELECT {LOG} FROM {{tl}}")
def append_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends, one per phase, read back together."""
    path = new_path(spark, "appended")
    log = testbed.trials(spark, sf_dir).select(*KEPT, "scale_phase")
    phases = (B.BASELINE_PHASE, B.STRESS_PHASE)
    sinks.append_batches((log.where(F.col("scale_phase") == p) for p in phases), path)
    return rounded(spark.read.parquet(path).select(*KEPT))


@query(
    "overwrite_run",
    f"""SELECT {LOG}, '2026-01-01' AS run_date FROM {{tl}}
        UNION ALL SELECT {LOG}, '2026-01-02' FROM {{kept}}""",
)
def overwrite_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two run dates; the second is written twice and keeps only its last rows."""
    path = new_path(spark, "runs")
    log = testbed.trials(spark, sf_dir).select(*KEPT)
    sinks.overwrite_run(log, path, "2026-01-01")
    sinks.overwrite_run(log, path, "2026-01-02")
    sinks.overwrite_run(clean.above_minimum(log), path, "2026-01-02")
    back = spark.read.option("basePath", path).parquet(path)
    return rounded(back.withColumn("run_date", F.col("run_date").cast("string")))


@query(
    "append_stream",
    """SELECT scale_phase || '|' || scale_stage || '|' || size_signature || '|' || random_seed AS instance_id,
              valid_selection, CAST(full_runtime AS DOUBLE) AS full_runtime, note
       FROM {headless} WHERE try_cast(full_runtime AS DOUBLE) > 0.5""",
)
def append_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw log as arriving files, cleaned by row and appended by a stream."""
    landing, out = new_path(spark, "landing"), new_path(spark, "stream")
    sinks.write_csv(testbed.raw_log(spark, sf_dir), landing)
    rows = append.arriving_trials(spark, landing, testbed.RAW_COLUMNS)
    append.append_stream(rows, out, new_path(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(out).select("instance_id", "valid_selection", "full_runtime", "note")
