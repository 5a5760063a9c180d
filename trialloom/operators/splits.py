"""Exact, repeatable splits and draws by hashed order instead of a random stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialloom.operators.clean import BUNDLE, INSTANCE

# Default share and seed of the held-out side.
TEST_SIZE = 0.33
SEED = 7

PREFIX = 5
"""Hex digits that bin the draws: at most 16**5 bins, and a bin holds n / 16**5 keys."""


def draw(seed: int, *columns: str) -> Column:
    """Uniform text draw of a key."""
    return F.expr(f"md5(concat_ws('|', '{int(seed)}', {', '.join(f'`{c}`' for c in columns)}))")


def held_out_limit(keys: DataFrame, columns: Sequence[str], test_size: float, seed: int) -> DataFrame:
    """One row: the draw of the last of ceil(test_size * n) held-out keys.

    Counting draws per prefix finds the bin of that key; only this bin is sorted. Draws of
    distinct keys are uniform, so no bin is large.
    """
    drawn = keys.select(draw(seed, *columns).alias("d")).withColumn("bin", F.substring("d", 1, PREFIX))
    counts = drawn.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    # At most 16**PREFIX rows reach this window.
    upto = F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy())
    last = (
        counts.select("bin", "n", upto.alias("upto"), F.ceil(total * F.lit(test_size)).alias("wanted"))
        .where(F.col("upto") >= F.col("wanted"))
        .orderBy("bin")
        .limit(1)
        .select("bin", (F.col("wanted") - F.col("upto") + F.col("n")).alias("place"))
    )
    inside = drawn.join(last, "bin").withColumn(
        "row", F.row_number().over(Window.partitionBy("bin").orderBy("d"))
    )
    return inside.where(F.col("row") <= F.col("place")).agg(F.max("d").alias("limit"))


def with_split(
    df: DataFrame,
    columns: Sequence[str] = (INSTANCE,),
    *,
    test_size: float = TEST_SIZE,
    seed: int = SEED,
    name: str = "split",
    unique: bool = False,
) -> DataFrame:
    """Add ``train`` / ``test``; exactly ceil(test_size * n) of the n distinct keys are held out.

    The limit is found first, as one short text, so that the split itself is a narrow
    projection and the log is not shuffled. ``unique`` says that the keys do not repeat.
    """
    keys = df.select(*columns)
    limit = held_out_limit(keys if unique else keys.distinct(), columns, test_size, seed).first()["limit"]
    side = F.when(draw(seed, *columns) <= F.lit(limit), "test").otherwise("train")
    return df.withColumn(name, side)


def row_holdout(df: DataFrame, *, test_size: float = TEST_SIZE, seed: int = SEED, unique: bool = False) -> DataFrame:
    return with_split(df, (INSTANCE, BUNDLE), test_size=test_size, seed=seed, unique=unique)


def group_holdout(df: DataFrame, *, test_size: float = TEST_SIZE, seed: int = SEED) -> DataFrame:
    """Whole instances on one side, so nothing leaks between the sides."""
    return with_split(df, (INSTANCE,), test_size=test_size, seed=seed)


def split_summary(split: DataFrame) -> DataFrame:
    """Rows and instances per side; counted per instance first."""
    sizes = split.groupBy("split", INSTANCE).agg(F.count(F.lit(1)).alias("n"))
    sides = [("train", F.col("split") == "train"), ("test", F.col("split") == "test")]
    return sizes.agg(
        *[F.coalesce(F.sum(F.when(on, F.col("n"))), F.lit(0)).alias(f"{s}_row_count") for s, on in sides],
        *[F.count_if(on).alias(f"{s}_instance_count") for s, on in sides],
    )


def split_by_stage(split: DataFrame) -> DataFrame:
    return split.groupBy("split", "scale_phase", "scale_stage").agg(F.count(F.lit(1)).alias("row_count"))


def split_pivot(split: DataFrame) -> DataFrame:
    """Rows per stage with one column per side, zero where a side has none."""
    return (
        split.groupBy("scale_stage")
        .pivot("split", ["train", "test"])
        .agg(F.count(F.lit(1)))
        .na.fill(0, ["train", "test"])
    )


def random_pick(df: DataFrame, *, seed: int = SEED) -> DataFrame:
    """One drawn bundle per instance."""
    return df.groupBy(INSTANCE).agg(F.min_by(BUNDLE, draw(seed, INSTANCE, BUNDLE)).alias(BUNDLE))
