"""Bounded samples of labelled rows, and their features counted in Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.session import staged

#: Most labelled rows that a classifier is fitted on: the ones with the smallest hash of doc_id.
SAMPLE_ROWS = 12_000


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of a doc_id's text, modulo ``divisor``; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def held_out(doc_id: Column, divisor: int, value: int) -> Column:
    return F.coalesce(remainder(doc_id, divisor) == value, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, divisor: int, value: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``text`` and ``label`` (0 or 1) of at most ``rows`` labelled doc_ids that aren't held out.

    Null doc_ids, labels and texts give no example. A doc_id labelled twice counts as 1 if any of
    its labels is 1, one with several texts is the one with the smallest hash. So the rows are
    bounded, as the chosen doc_ids are, which may be broadcast.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & (remainder(F.col("doc_id"), divisor) != value))
    chosen = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    # the smallest hashes lie below four times their share of all hashes, which keeps the sort small
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    share = min(1.0, 4 * rows / max(1, chosen.count()))
    near = chosen.where(place.cast("double") <= share * float(2**63))
    chosen = staged(near.orderBy(place, "doc_id").limit(rows), "chosen")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    known = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label")
    return staged(known.agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "label"), "sample")


def features(text: Column, own: Callable[[str], Iterable[str]]) -> Column:
    """Array of the distinct features of each text."""

    @F.arrow_udf("array<string>")
    def column(texts: pa.Array) -> pa.Array:
        return pa.array([list(own(x)) for x in texts.to_pylist()], pa.list_(pa.string()))

    return column(text)


def counted(examples: DataFrame, own: Callable[[str], Iterable[str]], least: int) -> DataFrame:
    """Examples with label 1 (``ones``) and 0 (``zeros``) that have each feature; rare ones go."""
    each = examples.select("label", F.explode(features(F.col("text"), own)).alias("feature"))
    ones, zeros = F.sum("label").alias("ones"), F.sum(1 - F.col("label")).alias("zeros")
    return each.groupBy("feature").agg(ones, zeros).where(F.expr("ones + zeros") >= least)


def matrix(examples: DataFrame, own: Callable[[str], Iterable[str]], index: dict[str, int]):
    """Indexes of each example's known features, as (label array, list of index arrays).

    Rows and features are both bounded, so the driver holds them.
    """

    @F.arrow_udf("array<int>")
    def column(texts: pa.Array) -> pa.Array:
        found = [sorted(index[f] for f in own(x) if f in index) for x in texts.to_pylist()]
        return pa.array(found, pa.list_(pa.int32()))

    table = examples.select("label", column(F.col("text")).alias("at")).toArrow()
    labels = table.column("label").to_numpy().astype(np.int64)
    at = [np.asarray(x, np.int64) for x in table.column("at").to_pylist()]
    # the rows come in any order, the fit should not depend on it
    order = sorted(range(len(at)), key=lambda i: (labels[i], at[i].tobytes()))
    return labels[order], [at[i] for i in order]
