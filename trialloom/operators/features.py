"""From the clean log to model inputs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.columns import MODEL_DROP
from trialloom.functions.arrays import with_all_stats
from trialloom.functions.bundles import with_bits
from trialloom.operators.clean import BUNDLE, INSTANCE, INSTANCE_KEYS, TARGET
from trialloom.operators.signal import encode_mixed

LABEL = "_label"


def augmented(df: DataFrame, arrays: Iterable[str] | None = None) -> DataFrame:
    """Clean log plus array statistics and bundle bits, on the same rows by projection."""
    return with_bits(with_all_stats(df, arrays))


def drop_columns(df: DataFrame, names: Sequence[str] = tuple(MODEL_DROP)) -> DataFrame:
    """Drop the listed columns that are present."""
    return df.drop(*names)


def metadata(df: DataFrame) -> DataFrame:
    """Instance keys, plus the bundle where the log has one."""
    return df.select(INSTANCE, *INSTANCE_KEYS, *([BUNDLE] if BUNDLE in df.columns else []))


def removed_features(columns: Sequence[str], unwanted: Sequence[str]) -> list[str]:
    return [c for c in unwanted if c in columns]


def model_inputs(
    df: DataFrame, *, drop: Sequence[str] = tuple(MODEL_DROP)
) -> tuple[DataFrame, list[str]]:
    """One table of keys, label and numeric features, and the feature names.

    Keys and label travel under ``meta_`` names, so that features and keys never clash.
    """
    meta = [c for c in metadata(df).columns if c in df.columns]
    keyed = df.select(*[F.col(c).alias(f"meta_{c}") for c in meta], F.col(TARGET).alias(LABEL), "*")
    kept = drop_columns(keyed, [*drop, TARGET])
    features = [c for c in kept.columns if c != LABEL and not c.startswith("meta_")]
    fixed = [c for c in kept.columns if c not in features]
    # The keys keep their text inside a struct; only the features are encoded.
    encoded = encode_mixed(kept.select(*features, F.struct(*fixed).alias("_fixed")))
    return encoded.select("_fixed.*", *[F.col(c).cast("double").alias(c) for c in features]), features
