"""Exact top-k search by inner product, in tiles of a matrix product.

Vectors are gathered into tiles of bounded size where they are read. Tiles of queries and tiles
of candidates meet in the cells of a grid, so that each is copied only along one side of it.
Every pair of tiles is one matrix product, of which each query keeps its k best; these partial
lists are merged in two levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialloom.session import staged

K, SCALE = 5, 256
#: Bytes of a tile, and most rows of one.
TILE_BYTES, TILE_ROWS, QUERY_ROWS = 1 << 21, 4096, 1024
TILE = "dim int, n int, first long, ids binary, data binary"
LONG = (1 << 63) - 1


def _tiles(scale: int, rows: int):
    """Batches of (vec_id, embedding) to tiles: vectors of one length, by ascending vec_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def out(dim: int, whole: bool) -> Iterator[pa.RecordBatch]:
            size = max(1, min(rows, TILE_BYTES // (8 * max(dim, 1))))
            ids = np.concatenate([x for x, _ in held[dim]])
            data = np.concatenate([y for _, y in held[dim]])
            end = len(ids) if whole else len(ids) // size * size
            for at in range(0, end, size):
                order = np.argsort(ids[at : min(at + size, end)], kind="stable") + at
                cells = [[dim], [len(order)], [int(ids[order[0]])], [ids[order].tobytes()], [data[order].tobytes()]]
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], ["dim", "n", "first", "ids", "data"])
            held[dim] = [(ids[end:], data[end:])]

        for batch in batches:
            lists = batch.column(1)
            values = np.asarray(lists.values.to_numpy(zero_copy_only=False), np.float64)
            offsets = np.asarray(lists.offsets)
            good = np.isfinite(values)  # a null component has become NaN
            bad = np.r_[0, np.cumsum(~good)]
            some = np.asarray(lists.is_valid()) & np.asarray(batch.column(0).is_valid())
            some &= bad[offsets[1:]] == bad[offsets[:-1]]
            ids, lengths = batch.column(0).fill_null(0).to_numpy(), np.diff(offsets)
            for dim in np.unique(lengths[some]):
                rows_ = np.flatnonzero(some & (lengths == dim))
                data = np.floor(scale * values[offsets[rows_][:, None] + np.arange(dim)])
                held.setdefault(int(dim), []).append((ids[rows_], data))
                if sum(len(x) for x, _ in held[int(dim)]) * max(8 * dim, 8) >= TILE_BYTES:
                    yield from out(int(dim), False)
        for dim in held:
            yield from out(dim, True)

    return run


def products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact integer inner products of whole-number vectors.

    Floating point is exact while no partial sum can leave its integers; beyond that Python's
    integers are used, and results beyond a long are cut to its ends.
    """
    longest = float(np.sqrt((queries**2).sum(1).max(initial=0)) * np.sqrt((candidates**2).sum(1).max(initial=0)))
    if longest < 2**24 and max(np.abs(queries).max(initial=0), np.abs(candidates).max(initial=0)) < 2**24:
        return (queries.astype(np.float32) @ candidates.astype(np.float32).T).astype(np.int64)
    if longest < 2**53:
        return (queries @ candidates.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(queries) @ whole(candidates).T if queries.shape[1] else np.zeros((len(queries), len(candidates)), object)
    return np.clip(exact, -LONG, LONG).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k largest scores, its own id left out; smaller columns win ties."""
    lowest = np.iinfo(np.int64).min
    scores = np.where(ids[None, :] == own[:, None], lowest, scores)
    rows, columns = np.arange(len(scores)), []
    for _ in range(min(k, scores.shape[1])):
        at = scores.argmax(1)
        columns.append(np.where(scores[rows, at] == lowest, -1, at))
        scores[rows, at] = lowest
    found = np.array(columns).T.reshape(len(scores), -1)
    keep = found.ravel() >= 0
    return np.repeat(rows, found.shape[1])[keep], found.ravel()[keep]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                query_ids, ids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                queries = np.frombuffer(r["q_data"], np.float64).reshape(len(query_ids), -1)
                candidates = np.frombuffer(r["data"], np.float64).reshape(len(ids), -1)
                scores = products(queries, candidates)
                row, column = best(scores, ids, query_ids, k)
                arrays = [query_ids[row], ids[column], scores[row, column], np.full(len(row), r["column"])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in arrays], ["query_id", "vec_id", "score", "part"]
                )

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: each query's k best rows of ``vectors``.

    Both tables have vec_id and embedding. Components become floor(scale * x); the score is their
    integer inner product. A row with the query's own vec_id is no candidate; ties go to the
    smaller vec_id; with fewer candidates than k all are given. Vectors that are null or hold a null
    or non-finite component, and rows without vec_id, take no part. Only vectors of equal length
    meet. A repeated candidate row may be found again; equal query rows count once. Scores beyond
    a long are cut to its ends. Empty tables give an empty table.
    """
    spark = vectors.sparkSession

    def tiles(rows: DataFrame, size: int, name: str) -> DataFrame:
        rows = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
        return staged(rows.mapInArrow(_tiles(scale, size), TILE), name)

    asked = tiles(queries.select("vec_id", "embedding").distinct(), QUERY_ROWS, "queries")
    given = tiles(vectors, TILE_ROWS, "tiles")
    blocks, shards = asked.count(), given.count()
    cells = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    high = max(1, min(blocks, round((cells * blocks / max(1, shards)) ** 0.5)))
    wide = max(1, min(shards, -(-cells // high)))
    asked = asked.selectExpr(
        "dim", f"pmod(xxhash64(first, n), {high}) as row", f"explode(sequence(0, {wide - 1})) as column", "ids q_ids", "data q_data"
    )
    given = given.selectExpr(
        "dim", f"pmod(xxhash64(first, n), {wide}) as column", f"explode(sequence(0, {high - 1})) as row", "ids", "data"
    )
    pairs = asked.join(given, ["dim", "row", "column"]).select("column", "q_ids", "q_data", "ids", "data")
    partial = pairs.mapInArrow(_search(k), "query_id long, vec_id long, score long, part long")
    order = [F.col("score").desc(), F.col("vec_id")]

    def merged(rows: DataFrame, *group: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        return rows.withColumn("rank", rank).where(F.col("rank") <= k)

    return merged(merged(partial, "query_id", "part"), "query_id").select("query_id", "rank", "vec_id", "score")
