"""Trial batches that arrive while an experiment runs, appended as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from trialloom.operators.clean import (
    SEED,
    TARGET,
    above_minimum,
    coerce,
    drop_header_rows,
    drop_missing_keys,
    with_instance_id,
)


def arriving_trials(
    spark: SparkSession, folder: str, columns: Sequence[str], *, line_breaks: bool = True
) -> DataFrame:
    """Stream of text rows from the CSV files that land in a folder."""
    text = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = (
        spark.readStream.schema(text)
        .option("header", True)
        .option("multiLine", line_breaks)
        .option("escape", '"')
        .csv(folder)
    )
    return rows.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns])


def append_stream(
    rows: DataFrame, out: str, checkpoint: str, *, min_runtime: float = 0.5
) -> StreamingQuery:
    """Clean each row and append it, each file exactly once; ends when no file is left.

    Rules over more than one row (copies, completeness) need the whole log and are applied
    when the appended table is read.
    """
    typed = drop_missing_keys(coerce(drop_header_rows(rows), TARGET, SEED))
    kept = with_instance_id(above_minimum(typed, min_runtime))
    return (
        kept.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )
