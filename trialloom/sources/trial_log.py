"""Reading and naming of trial logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialloom.columns import HEADERS, header_of, key_of
from trialloom.operators.clean import TARGET

LOG_COLUMNS = [key for key, _ in HEADERS]


def scan_trial_log(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str] | None = None,
    *,
    target: str = TARGET,
    line_breaks: bool = True,
) -> DataFrame:
    """Read a CSV log with every column as text and blanks as ``''``.

    The columns are those of the first file's header, unless ``columns`` gives them in order;
    every file's header is checked against them. ``target`` has to be among them, by its row key
    or its printed header. Cells with line breaks (printed matrices) need ``line_breaks``, and
    then one file is one task, so large logs should come in many files; without them files are
    split.
    """
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read.option("header", True).option("multiLine", line_breaks).option("escape", '"')
    if columns is None:
        columns = reader.csv(paths).columns
    if target not in columns and header_of(target) not in columns:
        raise KeyError(f"target column {target!r} is missing from {path}, which has {list(columns)}")
    text = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    log = reader.schema(text).option("enforceSchema", False).csv(paths)
    return log.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns])


def from_headers(df: DataFrame) -> DataFrame:
    """Printed headers, also those of derived columns, to row keys; other names stay."""
    return df.select(*[F.col(f"`{c}`").alias(key_of(c)) for c in df.columns])


def to_headers(df: DataFrame, *, rest: bool = False) -> DataFrame:
    """Ordered projection of the row keys present, under their printed headers.

    With ``rest`` the other columns follow in their order, derived ones under printed headers too.
    """
    first = [key for key, _ in HEADERS if key in df.columns]
    more = [c for c in df.columns if c not in first] if rest else []
    return df.select(*[F.col(f"`{c}`").alias(header_of(c)) for c in [*first, *more]])
