"""Joins that survive a hot key, and grouping in tasks of bounded size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fewest and most tasks that the rows of one key are dealt to.
SALTS, MOST_SALTS = 16, 64
_SALT = "_salt"
#: Rows of a task that ``dealt`` aims at.
DEALT_ROWS = 1_000_000


def salts_for(df: DataFrame) -> int:
    """A quarter of the shuffle partitions, within bounds, as ``side`` is repeated for each."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(MOST_SALTS, max(SALTS, partitions // 4))


def salted_join(
    df: DataFrame,
    side: DataFrame,
    on: Sequence[str],
    how: str,
    spread: str | Column | None = None,
    salts: int | None = None,
) -> DataFrame:
    """Join ``side`` (few rows for each key) to ``df``, whose keys may be hot.

    Rows of ``df`` are dealt to ``salts`` buckets by a hash of ``spread`` (by default, or if there is
    no such column, of the whole row), ``side`` is repeated for each bucket, and the bucket joins
    the key, so a hot key goes to as many tasks. ``how`` must not keep unmatched rows of ``side``.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"can't salt a {how} join")
    if spread is None or isinstance(spread, str) and spread not in df.columns:
        spread = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    salts = salts or salts_for(df)
    bucket = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    copies = side.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # a generator, as the optimizer would reason about a plain expression over all columns for
    # each combination of their old and new names
    dealt = df.select("*", F.explode_outer(F.array(bucket)).alias(_SALT))
    return dealt.join(copies, [*on, _SALT], how).drop(_SALT)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` (of about ``rows`` rows) by a hash of ``keys`` in tasks of ``DEALT_ROWS``, to be grouped by ``keys`` next.

    A group-by alone first collects the groups of whatever a task reads, and a file of narrow columns
    holds very many of them. Rows that make small tasks on all cores stay where they are.
    """
    if rows <= DEALT_ROWS * df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(-(-rows // DEALT_ROWS), *keys)
