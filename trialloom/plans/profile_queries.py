"""Queries that profile the measure and the log's quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trialloom.operators import clean, instances, profile, splits
from trialloom.plans.ranking_queries import complete_trials, staged_trials
from trialloom.plans.registry import query, rounded
from trialloom.sources import testbed


def _pack(by: str, view: str) -> str:
    lead = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    return f"""
        SELECT {lead}count(*) AS count, round(avg(full_runtime), 8) AS mean, round(stddev_pop(full_runtime), 8) AS std,
               round(min(full_runtime), 8) AS min, round(quantile_cont(full_runtime, 0.25), 8) AS p25,
               round(quantile_cont(full_runtime, 0.5), 8) AS median, round(quantile_cont(full_runtime, 0.75), 8) AS p75,
               round(max(full_runtime), 8) AS max, round(skewness(full_runtime), 8) AS skew
        FROM {view}{tail}"""


@query("measure_summary", _pack("", "{tl}"))
def measure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        profile.measure_summary(testbed.trials(spark, sf_dir))
    )


@query("summary_by_stage", _pack("scale_phase, scale_stage", "{tl}"))
def summary_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        profile.summary_by_stage(testbed.trials(spark, sf_dir))
    )


@query("summary_by_signature", _pack("size_signature", "{tl}"))
def summary_by_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        profile.summary_by_signature(testbed.trials(spark, sf_dir))
    )


@query("measure_summary_spread", _pack("", "{tl}"))
def measure_summary_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same numbers on the path for groups of unknown size."""
    return rounded(profile.measure_summary(testbed.trials(spark, sf_dir)))


@query("summary_by_stage_spread", _pack("scale_phase, scale_stage", "{tl}"))
def summary_by_stage_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.summary_by_stage(testbed.trials(spark, sf_dir)))


@query(
    "data_quality",
    """SELECT CAST(sum(n) AS BIGINT) AS row_count, count(*) AS instance_count,
              CAST(sum(no_target) AS BIGINT) AS missing_target_count, CAST(sum(no_seed) AS BIGINT) AS missing_seed_count,
              count(*) FILTER (WHERE n = 64) AS complete_instance_count,
              count(*) FILTER (WHERE n <> 64) AS incomplete_instance_count,
              min(n) AS min_bundle_count_per_instance, max(n) AS max_bundle_count_per_instance,
              (SELECT count(*) - (SELECT count(*) FROM {dedup}) FROM {headless}) AS duplicate_row_count
       FROM (SELECT scale_phase, scale_stage, size_signature, random_seed, count(*) AS n,
                    count(*) FILTER (WHERE try_cast(full_runtime AS DOUBLE) IS NULL) AS no_target,
                    count(*) FILTER (WHERE try_cast(random_seed AS DOUBLE) IS NULL) AS no_seed
             FROM {headless} GROUP BY 1, 2, 3, 4) t""",
)
def data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of the log before duplicates and unusable measures are removed."""
    rows = clean.drop_header_rows(testbed.raw_log(spark, sf_dir))
    return profile.data_quality(clean.with_instance_id(rows))


def _histogram(values: str) -> str:
    return f"""
        SELECT CAST(b.n AS INTEGER) AS bin, coalesce(c.n, 0) AS n
        FROM range(1, 41) b(n) LEFT JOIN (
            SELECT CAST(least(floor((x - low) / (high - low) * 40), 39) AS INTEGER) + 1 AS bin, count(*) AS n
            FROM ({values}) v, (SELECT min(x) AS low, max(x) AS high FROM ({values}) w) e
            WHERE x IS NOT NULL GROUP BY 1) c ON c.bin = b.n"""


@query("measure_histogram", _histogram("SELECT full_runtime AS x FROM {tl}"))
def measure_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.histogram(testbed.trials(spark, sf_dir), "full_runtime")


@query(
    "range_histogram",
    _histogram("SELECT max(full_runtime) - min(full_runtime) AS x FROM {complete} GROUP BY instance_id"),
)
def range_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.histogram(instances.instance_summary(complete_trials(spark, sf_dir)), "runtime_range")


@query(
    "split_pivot",
    """SELECT scale_stage, count(*) FILTER (WHERE split = 'train') AS train,
              count(*) FILTER (WHERE split = 'test') AS test
       FROM {group_split} GROUP BY 1""",
)
def split_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_pivot(splits.group_holdout(staged_trials(spark, sf_dir)))
