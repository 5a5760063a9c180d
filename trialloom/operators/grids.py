"""Numbering and timing of trial rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.functions.joining import salted_join
from trialloom.functions.ordering import rank_within, running_total
from trialloom.operators.clean import BUNDLE, INSTANCE


def row_ids(df: DataFrame, *, first: int = 1, complete: bool = False) -> DataFrame:
    """Consecutive row numbers: instances in order, bundles inside each instance.

    Only the instance sizes are ordered globally; rows are numbered inside their instance, rows
    of the same bundle in any order. ``complete`` says that an instance has 64 rows.
    """
    sizes = df.groupBy(INSTANCE).agg(F.count(F.lit(1)).alias("_size"))
    offsets = running_total(sizes, INSTANCE, "_size", name="_offset")
    numbered = rank_within(df, [INSTANCE], BUNDLE, name="_place", method="first", small_groups=complete)
    return (
        salted_join(numbered, offsets.select(INSTANCE, "_offset"), [INSTANCE], "inner")
        .withColumn("id", (F.col("_offset") + F.col("_place") + (first - 1)).cast("long"))
        .drop("_offset", "_place")
    )


def phase_delta(root: Column, plain: Column, later: Column) -> Column:
    """Composed time: rooted run plus later run, less the plain root run."""
    return root + later - plain
