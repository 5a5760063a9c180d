"""From the raw text log to the clean trial log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.functions.bundles import EXPECTED_BUNDLES
from trialloom.functions.joining import salted_join
from trialloom.functions.numeric import to_number

TARGET = "full_runtime"
BUNDLE = "valid_selection"
INSTANCE = "instance_id"
SEED = "random_seed"

# The columns that identify an instance, in order.
INSTANCE_KEYS = ["scale_phase", "scale_stage", "size_signature", "random_seed"]


def drop_header_rows(df: DataFrame) -> DataFrame:
    """Remove rows in which every cell repeats its own column name.

    The rule names every column. As a plain filter over a log with renamed columns the optimizer
    would derive it anew for each combination of old and new names, so a generator makes it one
    column first, and the filter names that column alone. Works on streams as well.
    """
    is_header = " and ".join(f"`{c}` <=> '{c}'" for c in df.columns)
    marked = df.select("*", F.explode_outer(F.array(F.expr(is_header))).alias("_is_header"))
    return marked.where("not _is_header").drop("_is_header")


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Keep one of each group of fully equal rows; copies collapse before the shuffle."""
    return df.dropDuplicates()


def coerce(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: to_number(c) for c in columns})


def drop_missing_keys(df: DataFrame, target: str = TARGET, seed: str = SEED) -> DataFrame:
    return df.dropna(subset=[target, seed])


def above_minimum(df: DataFrame, minimum: float = 0.5, target: str = TARGET) -> DataFrame:
    return df.where(F.col(target) > F.lit(minimum))


def with_instance_id(df: DataFrame) -> DataFrame:
    """Join the key columns with ``|``.

    A whole number prints without a fraction, digit for digit; any other seed prints as it is.
    A null prints as ``?``, so that keys with and without a part stay apart.
    """
    text = F.trim(F.col(SEED).cast("string"))
    whole = F.regexp_extract(text, r"^([+-]?[0-9]+)([.]0*)?$", 1)
    seed = F.coalesce(F.expr("try_cast(_whole as decimal(38, 0))").cast("string"), text)
    keys = [F.coalesce(seed if c == SEED else F.col(c), F.lit("?")) for c in INSTANCE_KEYS]
    return df.withColumn("_whole", whole).withColumn(INSTANCE, F.concat_ws("|", *keys)).drop("_whole")


def complete_instances(df: DataFrame, expected: int = EXPECTED_BUNDLES) -> DataFrame:
    """Instances with exactly ``expected`` rows; rows count, not distinct bundles."""
    counts = df.where(F.col(INSTANCE).isNotNull()).groupBy(INSTANCE).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") == expected).select(INSTANCE)


def keep_members(df: DataFrame, members: DataFrame, on: str = INSTANCE) -> DataFrame:
    """Rows whose key is listed; a key with very many rows is spread over tasks."""
    return salted_join(df, members, [on], "left_semi")


def keep_complete(df: DataFrame, expected: int = EXPECTED_BUNDLES) -> DataFrame:
    """Rows of complete instances; each instance then has exactly ``expected`` rows."""
    return keep_members(df, complete_instances(df, expected))


def ordered_log(df: DataFrame) -> DataFrame:
    """Total order for a sink; operators never rely on it."""
    return df.orderBy(INSTANCE, BUNDLE)


def clean_log(
    raw: DataFrame,
    *,
    min_runtime: float = 0.5,
    require_complete: bool = True,
    expected_bundles: int = EXPECTED_BUNDLES,
) -> DataFrame:
    """All cleaning rules in order: the minimum filter comes before the completeness test."""
    rows = drop_duplicate_rows(drop_header_rows(raw))
    rows = drop_missing_keys(coerce(rows, TARGET, SEED))
    rows = with_instance_id(above_minimum(rows, min_runtime))
    return keep_complete(rows, expected_bundles) if require_complete else rows
