"""Scalar and aggregate expressions with the missing-value rules of trial logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text that counts as one plain number.
PLAIN_NUMBER = r"^\s*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$"


_QUOTED = PLAIN_NUMBER.replace("\\", "\\\\")


def is_number_sql(text: str) -> str:
    return f"{text} rlike '{_QUOTED}'"


def to_number_sql(text: str) -> str:
    """Lenient cast: anything but a plain number gives null, never NaN."""
    return f"if({is_number_sql(text)}, try_cast(trim({text}) as double), null)"


def to_number(column: str) -> Column:
    return F.expr(to_number_sql(f"cast(`{column}` as string)"))


def finite_sql(x: str) -> str:
    """Null instead of NaN; aggregates skip nulls but would return NaN."""
    return f"nullif({x}, double('NaN'))"


def is_close(a: Column, b: Column, rel: float = 1e-5, absolute: float = 1e-8) -> Column:
    """1 when a equals b within the tolerance around b, else 0; null counts as different."""
    near = F.abs(a - b) <= F.lit(absolute) + F.lit(rel) * F.abs(b)
    return F.coalesce(near.cast("int"), F.lit(0))


def guarded_gain(base: Column, best: Column) -> Column:
    """Relative gain over the baseline, null unless the baseline is positive."""
    return F.when(base > 0, (base - best) / base)


def safe_rate(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def pearson_sql(x: str, y: str) -> str:
    """Aggregate: correlation over rows where both are present, null if either is constant."""
    sx, sy = f"stddev_pop(if({y} is null, null, {x}))", f"stddev_pop(if({x} is null, null, {y}))"
    return f"try_divide(covar_pop({x}, {y}), {sx} * {sy})"


def sample_skew(x: str) -> Column:
    """Aggregate: bias-corrected skew; null below three values, 0 for a constant."""
    n = f"cast(count({x}) as double)"
    corrected = f"skewness({x}) * sqrt({n} * ({n} - 1)) / nullif({n} - 2, 0D)"
    return F.expr(f"case when count({x}) < 3 then null when stddev_pop({x}) = 0 then 0D else {corrected} end")
