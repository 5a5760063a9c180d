"""Which scalar features carry signal about the measure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.functions.joining import salted_join
from trialloom.functions.numeric import finite_sql, is_close, is_number_sql, pearson_sql, to_number, to_number_sql
from trialloom.functions.ordering import rank_within
from trialloom.operators.clean import BUNDLE, INSTANCE, TARGET
from trialloom.operators.leaderboard import with_group_best
from trialloom.session import staged

NOT_FEATURES = {TARGET, INSTANCE, BUNDLE, "id"}
MIN_VALID = 0.95
NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")
#: Codes of one column that may be broadcast; more are joined by salted keys.
BROADCAST_CODES = 10_000


def _numeric(kind: str) -> bool:
    return kind in NUMERIC_TYPES or kind.startswith("decimal")


def _number(df_types: dict[str, str], column: str) -> str:
    if _numeric(df_types[column]):
        return finite_sql(f"cast(`{column}` as double)")
    return to_number_sql(f"`{column}`")


def _scalar_columns(df: DataFrame) -> list[str]:
    return [c for c, kind in df.dtypes if kind == "string" or _numeric(kind)]


def _long(df: DataFrame, names: Sequence[str], *keep: str) -> DataFrame:
    """One row per feature value (feature, x), nulls included, beside the ``keep`` columns.

    The rows multiply only between the scan and the partial aggregation of the same task;
    a shuffle sees one row per feature and task. One narrow aggregate also compiles to
    tight code, where one wide aggregate over all features does not.
    """
    return df.unpivot(list(keep), list(names), "feature", "x")


def candidate_features(df: DataFrame) -> list[str]:
    """Columns of which at least 95 % parse as numbers and that hold more than one value.

    A minimum below the maximum stands for a second value, so nothing is counted distinct.
    """
    names = [c for c in _scalar_columns(df) if c not in NOT_FEATURES]
    facts = (
        _long(numeric_features(df, names), names)
        .groupBy("feature")
        .agg(
            (F.count("x") / F.count(F.lit(1))).alias("valid"),
            (F.min("x") < F.max("x")).alias("varies"),
        )
        .where((F.col("valid") >= MIN_VALID) & F.col("varies"))
    )
    # One row per column of the table.
    found = {row["feature"] for row in facts.select("feature").collect()}
    return [c for c in names if c in found]


def candidate_table(df: DataFrame) -> DataFrame:
    """The surviving features by name, as a table."""
    names = candidate_features(df)
    listed = F.array(*[F.lit(c) for c in names]) if names else F.array().cast("array<string>")
    return df.sparkSession.range(1).select(F.explode(listed).alias("feature"))


def numeric_features(df: DataFrame, names: Sequence[str], *keep: str) -> DataFrame:
    """The named columns as numbers; ``keep`` are further SQL expressions."""
    types = dict(df.dtypes)
    return df.selectExpr(*keep, *[f"{_number(types, c)} as `{c}`" for c in names])


def feature_summary(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Valid share, distinct values, mean and population std per feature."""
    names = candidate_features(df) if names is None else list(names)
    values = _long(numeric_features(df, names), names)
    moments = values.groupBy("feature").agg(
        (F.count("x") / F.count(F.lit(1))).alias("valid_ratio"),
        F.avg("x").alias("mean"),
        F.stddev_pop("x").alias("std"),
    )
    # Repeated values collapse on the map side, so the shuffle carries distinct values only.
    distinct = (
        values.where(F.col("x").isNotNull())
        .groupBy("feature", "x")
        .agg(F.lit(1).alias("one"))
        .groupBy("feature")
        .agg(F.count(F.lit(1)).alias("nunique"))
    )
    return moments.join(distinct, "feature").orderBy(F.col("valid_ratio").desc(), "feature")


def _signal(df: DataFrame, names: Sequence[str], against: str, label: str) -> DataFrame:
    """Correlation of every feature with one column, where both are present."""
    table = _long(df, names, against).groupBy("feature").agg(F.expr(pearson_sql("x", against)).alias(label))
    return table.withColumn(f"abs_{label}", F.abs(label)).orderBy(
        F.col(f"abs_{label}").desc_nulls_last(), "feature"
    )


def signal_to_measure(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    names = candidate_features(df) if names is None else list(names)
    numbers = numeric_features(df, names, f"{TARGET} as _y")
    return _signal(numbers, names, "_y", "pearson_with_runtime")


def signal_to_best(df: DataFrame, names: Sequence[str] | None = None, *, complete: bool = False) -> DataFrame:
    """Correlation with the flag of being best in one's instance."""
    names = candidate_features(df) if names is None else list(names)
    best = with_group_best(df, name="_best", complete=complete)
    flagged = best.withColumn("_y", is_close(F.col(TARGET), F.col("_best")).cast("double"))
    numbers = numeric_features(flagged, names, "_y")
    return _signal(numbers, names, "_y", "pearson_with_optimal_flag")


def text_columns(df: DataFrame) -> list[str]:
    """Text columns that do not parse as numbers throughout; blanks count as missing."""
    texts = [c for c, kind in df.dtypes if kind == "string"]
    if not texts:
        return []
    wordy = df.agg(
        *[F.expr(f"count_if(trim(`{c}`) != '' and not {is_number_sql(f'`{c}`')})").alias(c) for c in texts]
    ).first()
    return [c for c in texts if wordy[c] > 0]


def encode_mixed(df: DataFrame) -> DataFrame:
    """All columns numeric: parsed where every value parses, else codes in sorted order.

    Codes start at 0; a null gets -1. They come from the distinct values only.
    """
    texts = [c for c, kind in df.dtypes if kind == "string"]
    wordy = [c for c in text_columns(df)]
    encoded = df.withColumns({c: to_number(c) for c in texts if c not in wordy})
    if not wordy:
        return encoded
    # All columns' distinct values from one pass over the table, coded together.
    values = df.select(*wordy).unpivot([], wordy, "_column", "_value").where("_value is not null").distinct()
    codes = staged(rank_within(values, ["_column"], "_value", name="_code", method="dense"), "codes")
    sizes = dict(codes.groupBy("_column").count().collect())
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if c not in wordy] or [F.lit(0)])
    for column in wordy:
        own = codes.where(F.col("_column") == column).select(F.col("_value").alias(column), "_code")
        if sizes.get(column, 0) <= BROADCAST_CODES:
            encoded = encoded.join(F.broadcast(own), column, "left")
        else:
            encoded = salted_join(encoded, own, [column], "left", row)
        encoded = encoded.withColumn(column, F.coalesce(F.col("_code") - 1, F.lit(-1)).cast("int")).drop("_code")
    return encoded.select(df.columns)
