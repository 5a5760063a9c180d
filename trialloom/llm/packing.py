"""Token ids packed into rows of fixed length, best fit first, longest piece first.

Each document becomes ids and an end mark. What is longer than a row is split into pieces, none
of its ids lost. Pieces are packed where they are read, in groups of bounded size: in the order
of falling length each piece goes to the open row with the least room that still holds it, found
in a segment tree over capacities. Nothing is shuffled, and a lost task packs the same rows again.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.llm.texts import word_pieces

LENGTH = 2048
#: Tokens packed together.
GROUP_TOKENS = 1 << 20
PACKED = (
    "pack_id long, n_tokens int, ids binary, cu_seqlens array<int>, resets array<int>, "
    "doc_ids array<long>, doc_starts array<long>"
)


class Capacities:
    """Open rows by the room that is left, in a segment tree of counts over capacities."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _change(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return the row with the least room of at least ``need``, and its room."""
        count, at = self.count, need + self.leaves
        while not count[at]:
            while at & 1:  # a right child: nothing to its right below this parent
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at *= 2
            if not count[at]:
                at += 1
        room = at - self.leaves
        self._change(room, -1)
        return self.rows[room].pop(), room


def best_fit(lengths: list[int], most: int) -> list[list[int]]:
    """Rows of piece numbers, none over ``most`` long: best fit, longest piece first, ties by number."""
    rows: list[list[int]] = []
    open_rows = Capacities(most)
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = open_rows.take(lengths[piece])
        if found is None:
            row, room = len(rows), most
            rows.append([])
        else:
            row, room = found
        rows[row].append(piece)
        if room - lengths[piece]:
            open_rows.add(room - lengths[piece], row)
    return rows


_loaded: dict[str, tiktoken.Encoding] = {}


def pack(docs: DataFrame, path: str, pattern: str, end: int, length: int = LENGTH, group: int = GROUP_TOKENS) -> DataFrame:
    """Packed rows of ``docs``: doc_id and text, encoded with the rank file ``path`` (of fixed size).

    ``ids`` is a row of a token-id matrix: ``length`` little-endian uint16 (uint32 if ids need it),
    filled up with ``end``. ``cu_seqlens`` has 0 and the end of each segment; positions start anew
    at ``resets``. ``doc_ids`` and ``doc_starts`` name each segment's document and the token of it
    where the segment begins. Null and empty texts have the end mark alone. Repeated rows are packed
    as often as they come, null doc_ids stay null, other columns are not read, and an empty table
    gives an empty table. Texts of over a million letters are encoded in parts.
    """
    with open(path, "rb") as file:
        content = file.read()
    spark = docs.sparkSession
    name, held = hashlib.sha256(content + pattern.encode()).hexdigest(), spark.sparkContext.broadcast(content)

    def encoding() -> tiktoken.Encoding:
        if name not in _loaded:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, held.value.splitlines())}
            _loaded.clear()
            _loaded[name] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return _loaded[name]

    kind = np.dtype("<u2") if max(end, content.count(b"\n")) < 1 << 16 else np.dtype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, made = encoding(), TaskContext.get().partitionId() << 32
        waiting: list[tuple[int | None, int, np.ndarray]] = []
        tokens = 0

        def packed() -> pa.RecordBatch:
            nonlocal made
            columns: list[list] = [[] for _ in range(7)]
            for row in best_fit([len(x[2]) for x in waiting], length):
                ends = np.cumsum([0, *(len(waiting[i][2]) for i in row)])
                cells = np.full(length, end, kind)
                cells[: ends[-1]] = np.concatenate([waiting[i][2] for i in row])
                values = (
                    made, int(ends[-1]), cells.tobytes(), ends.tolist(), ends[:-1].tolist(),
                    [waiting[i][0] for i in row], [waiting[i][1] for i in row],
                )
                for column, value in zip(columns, values):
                    column.append(value)
                made += 1
            ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
            kinds = (pa.int64(), pa.int32(), pa.binary(), ints, ints, longs, longs)
            names = [x.split()[0] for x in PACKED.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = [np.asarray(code.encode_to_numpy(p, disallowed_special=()), kind) for p in word_pieces(text or "")]
                ids = np.concatenate([*parts, np.array([end], kind)])
                for at in range(0, len(ids), length):
                    waiting.append((doc_id, at, ids[at : at + length]))
                tokens += len(ids)
                if tokens >= group:
                    yield packed()
                    waiting, tokens = [], 0
        if waiting:
            yield packed()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PACKED)


def position_ids(resets: Column, n_tokens: Column) -> Column:
    """Array of each token's place in its segment, by the resets of its row."""
    ends = F.concat(F.slice(resets, 2, F.size(resets)), F.array(n_tokens))
    runs = F.transform(F.arrays_zip(resets.alias("a"), ends.alias("b")), lambda x: F.sequence(F.lit(0), x["b"] - x["a"] - 1))
    return F.flatten(runs)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet: the id matrix, its segments, and a position for every token."""
    packed.withColumn("position_ids", position_ids(F.col("resets"), F.col("n_tokens"))).write.parquet(path)


def unpacked(packed: DataFrame, width: int = 2) -> DataFrame:
    """doc_id, start and ids (binary) of every segment: the pieces of documents as they were packed."""
    segments = "explode(arrays_zip(doc_ids, doc_starts, resets, slice(cu_seqlens, 2, size(resets)))) as s"
    return packed.select("ids", F.expr(segments)).select(
        F.col("s.doc_ids").alias("doc_id"),
        F.col("s.doc_starts").alias("start"),
        F.expr(f"substring(ids, s.resets * {width} + 1, (s.`3` - s.resets) * {width})").alias("ids"),
    )
