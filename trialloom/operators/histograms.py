"""Binned feature blocks and histograms for tree learners.

Training rows become blocks: one record for each batch, with the bins of all features as bytes, the
label and a hash of the row's key. Blocks are a written table, so a lost executor reads its share
again; tree learners keep them in memory as arrays. Per level of a tree every task adds up its
blocks' histograms in numpy; a shuffle adds those of each group of features in a task of its own,
which finds the best splits among them. What reaches the driver is one split for each node and group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.session import staged

MAX_BINS = 255
#: Values of a feature that a task keeps to cut its bins.
KEPT_VALUES = 10_000
#: Rows of a task, up to which more rows take more tasks; beyond, tasks read more blocks.
TASK_ROWS = 50_000
#: Rows of a block that is made of smaller ones.
BLOCK_ROWS = 200_000
#: Nodes up to which a tree is read node by node over all rows rather than row by row.
FEW_NODES = 127
#: Rows for each distinct row of shared features from which these are added up first, and the share of groups
#: in which a shared feature may vary.
SHARED_ROWS, VARYING = 4, 0.05


@dataclass(frozen=True)
class Shared:
    """Features that many rows have in common (``columns``), their distinct rows (``bins``, named by a hash) and which of them a row has (``unit``)."""

    columns: np.ndarray
    bins: np.ndarray
    name: np.ndarray
    unit: np.ndarray

    def rest(self, width: int) -> np.ndarray:
        """The other features."""
        return np.setdiff1d(np.arange(width), self.columns)


@dataclass(frozen=True)
class Block:
    """Bins (rows by features), labels, key hashes, what has been predicted so far, and hashes of groups.

    Where rows share features, ``bins`` has the others only. ``place`` says where a feature is: from 0 among ``bins``, from -1 down among the shared.
    """

    bins: np.ndarray
    label: np.ndarray
    key: np.ndarray
    margin: np.ndarray
    group: np.ndarray
    place: np.ndarray
    shared: Shared | None = None

    def cells(self, rows: np.ndarray, feature: np.ndarray) -> np.ndarray:
        """Bin of one feature for each of ``rows``."""
        at = self.place[feature]
        out = np.empty(len(rows), np.uint8)
        own = at >= 0
        out[own] = self.bins[rows[own], at[own]]
        if self.shared and not own.all():
            out[~own] = self.shared.bins[self.shared.unit[rows[~own]], -1 - at[~own]]
        return out

    def at_most(self, feature: int, cut: int) -> np.ndarray:
        """Whether each row's bin of a feature is up to ``cut``."""
        at = self.place[feature]
        if at >= 0:
            return self.bins[:, at] <= cut
        return (self.shared.bins[:, -1 - at] <= cut)[self.shared.unit]

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """Bins of all features, and hashes of groups."""
        if self.shared is None:
            return self.bins, self.group
        bins = np.empty((len(self.label), len(self.place)), np.uint8, "F")
        bins[:, self.place >= 0] = self.bins
        bins[:, self.shared.columns] = self.shared.bins[self.shared.unit]
        return bins, self.shared.name[self.shared.unit]


def block_of(bins: np.ndarray, label: np.ndarray, key: np.ndarray, margin: np.ndarray, group: np.ndarray) -> Block:
    """Block of rows, without what they share in ``bins``."""
    width = bins.shape[1]
    common, place = shared_of(bins, group), np.arange(width)
    if common is None:
        return Block(np.asfortranarray(bins), label, key, margin, group, place)  # features are read one by one
    rest = common.rest(width)
    place[rest], place[common.columns] = np.arange(len(rest)), -1 - np.arange(len(common.columns))
    return Block(np.asfortranarray(bins[:, rest]), label, key, margin, group[:0], place, common)


def shared_of(bins: np.ndarray, group: np.ndarray) -> Shared | None:
    """Features that hardly vary among rows of the same ``group``, as those of an instance; None where that saves little.

    Rows are told apart by the features themselves, so a group may also differ in them, and groups may have them in common.
    """
    if len(bins) < SHARED_ROWS:
        return None
    order = np.argsort(group, kind="stable")
    first = np.append(0, np.flatnonzero(np.diff(group[order])) + 1)
    if len(first) * SHARED_ROWS > len(bins):
        return None
    columns, name = [], np.zeros(len(bins), np.uint64)
    draws = np.random.default_rng(0)
    for i in range(bins.shape[1]):
        own = bins[:, i][order]
        if np.count_nonzero(np.minimum.reduceat(own, first) < np.maximum.reduceat(own, first)) <= VARYING * len(first):
            columns.append(i)
            name += draws.integers(0, 1 << 63, 256, np.uint64)[bins[:, i]]
    name, row, unit = np.unique(name, return_index=True, return_inverse=True)
    if not columns or len(row) * SHARED_ROWS > len(bins):
        return None
    distinct = np.asfortranarray(bins[row][:, columns])
    if any((distinct[:, k][unit] != bins[:, i]).any() for k, i in enumerate(columns)):
        return None  # two rows of the same name
    return Shared(np.array(columns), distinct, name.view(np.int64), unit.astype(np.int32))


def joined(parts: Sequence[Block]) -> Block:
    """The same rows as one block, so that a pass over them has few array steps."""
    bins, group = (np.concatenate(each) for each in zip(*[block.whole() for block in parts]))
    return block_of(bins, *(np.concatenate([getattr(block, f) for block in parts]) for f in ("label", "key", "margin")), group)


def feature_matrix(column: pa.Array) -> np.ndarray:
    """Rows by features of a non-null array column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


def _thinned(values: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and their counts; beyond ``most`` those at equal steps of rank stand for the ones before."""
    values, at = np.unique(values, return_inverse=True)
    upto = np.cumsum(np.bincount(at, counts, len(values)).astype(np.int64))
    if len(values) > most:
        kept = np.unique(np.searchsorted(upto, np.ceil(np.arange(1, most + 1) * (upto[-1] / most) - 1e-6)).clip(max=len(upto) - 1))
        values, upto = values[kept], upto[kept]
    return values, np.diff(upto, prepend=0)


def bin_edges(rows: DataFrame, width: int, most: int = MAX_BINS) -> list[np.ndarray]:
    """Upper edges of each feature's bins but the last; ``rows`` has the vector column ``features``.

    A feature with at most ``most`` distinct values gets a bin for each, cut half way between them;
    any other is cut at quantiles, which are exact up to ``KEPT_VALUES`` distinct values in a partition
    and off by a small share of that fraction of the rows beyond. One pass: a task sums up its rows for each
    feature, and the sums of a feature meet in one task.
    """
    arrays = rows.select(vector_to_array("features").alias("features"))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [(np.empty(0), np.empty(0, np.int64))] * width
        waiting: list[np.ndarray] = []

        def add() -> None:
            matrix = np.concatenate(waiting)
            for i, (values, counts) in enumerate(known):
                both = np.concatenate([values, matrix[:, i]]), np.concatenate([counts, np.ones(len(matrix), np.int64)])
                known[i] = _thinned(*both, KEPT_VALUES)
            waiting.clear()

        for batch in batches:
            if batch.num_rows:
                waiting.append(feature_matrix(batch.column(0)))
                if sum(map(len, waiting)) >= TASK_ROWS:
                    add()
        if waiting:
            add()
        cells = [[each[k].tobytes() for each in known] for k in (0, 1)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width), pa.int32()), *[pa.array(c, pa.binary()) for c in cells]], ["feature", "value", "n"]
        )

    def cut(key: tuple, group: pa.Table) -> pa.Table:
        cells = [np.frombuffer(b"".join(group.column(c).to_pylist()), kind) for c, kind in (("value", float), ("n", np.int64))]
        values, counts = _thinned(*cells, len(cells[0]))
        if len(values) <= most:
            edges = (values[1:] + values[:-1]) / 2
        else:
            upto = np.cumsum(counts)
            edges = np.unique(values[np.searchsorted(upto, np.ceil(np.arange(1, most) / most * upto[-1]))])
        return pa.table({"feature": pa.array([key[0].as_py()], pa.int32()), "edges": pa.array([edges.tobytes()], pa.binary())})

    sums = arrays.mapInArrow(local, "feature int, value binary, n binary").groupBy("feature")
    edges = [np.empty(0)] * width
    for row in sums.applyInArrow(cut, "feature int, edges binary").collect():
        edges[row.feature] = np.frombuffer(row.edges)
    return edges


def binned(matrix: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    out = np.empty(matrix.shape, np.uint8)
    for i, cuts in enumerate(edges):
        out[:, i] = np.searchsorted(cuts, matrix[:, i], side="left")
    return out


def group_of(columns: Sequence[str], name: str) -> Column:
    """Hash of the group whose rows are likely to share features: their ``name`` column's, if there is one."""
    return F.xxhash64(F.col(name)) if name in columns else F.xxhash64(vector_to_array("features"))


def gathered(rows: DataFrame, group: str) -> DataFrame:
    """Rows of a group side by side; a large group is cut by its rows."""
    near = [F.col(group), F.xxhash64(vector_to_array("features"))]
    return rows.repartitionByRange(tasks_for(rows), *near).sortWithinPartitions(group)


def block_table(
    rows: DataFrame, edges: Sequence[np.ndarray], label: str, key: Column | None = None, group: Column | None = None
) -> DataFrame:
    """One record for each batch of ``rows``: n, bins, label, key and group as bytes."""
    wanted = rows.select(
        vector_to_array("features").alias("features"),
        F.col(label).cast("double").alias("label"),
        (F.lit(0) if key is None else key).cast("long").alias("key"),
        (F.lit(0) if group is None else group).cast("long").alias("group"),
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bins = binned(feature_matrix(batch.column(0)), edges)
                cells = [bins, batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(), batch.column(3).to_numpy()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.num_rows]), *[pa.array([c.tobytes()], pa.binary()) for c in cells]],
                    ["n", "bins", "label", "key", "group"],
                )

    return wanted.mapInArrow(cut, "n long, bins binary, label binary, key binary, group binary")


def tasks_for(rows: DataFrame) -> int:
    """As many tasks as the number of rows is worth."""
    most = 4 * rows.sparkSession.sparkContext.defaultParallelism
    return int(min(most, max(1, -(-rows.count() // TASK_ROWS))))


def spread(rows: DataFrame) -> DataFrame:
    return rows.repartition(tasks_for(rows))


def loaded(table: DataFrame, width: int, margin: float, tasks: int, keyed: bool = True):
    """Blocks of a written table, kept in memory and on disk as arrays, in as many partitions as cores at most; with keys if ``keyed``."""
    tasks = min(tasks, table.sparkSession.sparkContext.defaultParallelism)

    def parts(rows: Sequence) -> Block:
        column = lambda name, kind: np.frombuffer(b"".join(row[name] for row in rows), kind)
        label = column("label", np.float64)
        key = column("key", np.int64) if keyed else np.empty(0, np.int64)
        return block_of(column("bins", np.uint8).reshape(-1, width), label, key, np.full(len(label), margin), column("group", np.int64))

    def larger(part: Iterator) -> Iterator[Block]:
        held, n = [], 0
        for row in part:
            if held and n + row.n > BLOCK_ROWS:
                yield parts(held)
                held, n = [], 0
            held.append(row)
            n += row.n
        if held:
            yield parts(held)

    return table.repartition(tasks).rdd.mapPartitions(larger).persist(StorageLevel.MEMORY_AND_DISK)


def most_bins(edges: Sequence[np.ndarray]) -> int:
    return max((len(cuts) for cuts in edges), default=0) + 1


def block_histograms(
    bins: np.ndarray, node: np.ndarray, weights: Sequence[np.ndarray | None], nodes: int, size: int, columns: Sequence[int] | None = None
) -> np.ndarray:
    """Sums of each of ``weights`` per (node, feature, bin below ``size``); rows of node -1 count nowhere.

    A weight of None counts rows. ``columns`` are the features wanted, by default all.
    """
    columns = range(bins.shape[1]) if columns is None else columns
    inside = np.flatnonzero(node >= 0)
    out = np.zeros((len(weights), nodes, len(columns), size))
    if not len(inside):
        return out
    here = slice(None) if len(inside) == len(node) else inside
    base = node[here].astype(np.int64) * size
    own = [None if weight is None else weight[here] for weight in weights]
    for i, column in enumerate(columns):
        slot = base + bins[:, column][here]
        for k, weight in enumerate(own):
            out[k, :, i] = np.bincount(slot, weight, nodes * size).reshape(nodes, size)
    return out


def sums_by_bin(
    block: Block, node: np.ndarray, weights: Sequence[np.ndarray | None], nodes: int, size: int, columns: Sequence[int] | None = None
) -> np.ndarray:
    """``block_histograms`` of a block; features that rows share are added up by node and distinct row first."""
    columns = np.arange(len(block.place)) if columns is None else np.asarray(columns)
    at, common = block.place[columns], block.shared
    inside = np.flatnonzero(node >= 0)
    if common is None or not len(inside):
        return block_histograms(block.bins, node, weights, nodes, size, at) if common is None else np.zeros((len(weights), nodes, len(columns), size))
    out = np.zeros((len(weights), nodes, len(columns), size))
    units = len(common.bins)
    if len(inside) == len(node):
        inside = slice(None)
    cell = node[inside].astype(np.int64) * units + common.unit[inside]
    counts = np.bincount(cell, minlength=nodes * units)
    there = np.flatnonzero(counts)
    sums = [(counts if weight is None else np.bincount(cell, weight[inside], nodes * units))[there] for weight in weights]
    base, unit = np.divmod(there, units)
    base *= size
    for i in np.flatnonzero(at < 0):
        slot = base + common.bins[:, -1 - at[i]][unit]
        for k, weight in enumerate(sums):
            out[k, :, i] = np.bincount(slot, weight, nodes * size).reshape(nodes, size)
    rest = np.flatnonzero(at >= 0)
    if len(rest):
        out[:, :, rest] = block_histograms(block.bins, node, weights, nodes, size, at[rest])
    return out


def split_by_features(blocks, local: Callable, columns: np.ndarray, best: Callable) -> list[list]:
    """What ``best(sums, features)`` finds for each node, for every group of features, in their order.

    ``local`` turns the blocks of a partition into one array (weights, nodes, columns, bins) or None. The
    arrays are added up by groups of ``columns``, one task for each, so no task holds all of them.
    """
    pieces = max(1, min(len(columns), blocks.context.defaultParallelism))
    groups = np.array_split(np.arange(len(columns)), pieces)

    def cut(part):
        total = local(part)
        if total is not None:
            for i, own in enumerate(groups):
                yield i, total[:, :, own]

    added = blocks.mapPartitions(cut).reduceByKey(np.add, pieces)
    found = added.map(lambda pair: (pair[0], best(pair[1], columns[groups[pair[0]]]))).collect()
    return [each for _, each in sorted(found, key=lambda pair: pair[0])]


@dataclass
class Tree:
    """Nodes as arrays; a leaf has feature -1. Rows with a bin up to ``cut`` go left."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def _few(self, bins: np.ndarray | Block) -> np.ndarray:
        """``leaves`` of a small tree, chosen node by node from the leaves up: bits of the left end or the right one."""
        out = [np.uint8(i) for i in range(len(self.feature))]
        for node in np.flatnonzero(self.feature >= 0)[::-1]:  # children come after their parent
            left, right = self.left[node], self.right[node]
            feature, cut = self.feature[node], self.cut[node]
            goes = np.negative((bins.at_most(feature, cut) if isinstance(bins, Block) else bins[:, feature] <= cut).view(np.uint8))
            out[node] = ((out[left] ^ out[right]) & goes) ^ out[right]
            out[left] = out[right] = None
        return out[0] if np.ndim(out[0]) else np.full(_length(bins), out[0])

    def leaves(self, bins: np.ndarray | Block) -> np.ndarray:
        """Node at which each row ends."""
        if len(self.feature) <= FEW_NODES:
            return self._few(bins)
        at = np.zeros(_length(bins), np.int64)
        going = np.arange(len(at))
        while len(going):
            feature = self.feature[at[going]]
            going, feature = going[feature >= 0], feature[feature >= 0]
            here = at[going]
            cells = bins.cells(going, feature) if isinstance(bins, Block) else bins[going, feature]
            at[going] = np.where(cells <= self.cut[here], self.left[here], self.right[here])
        return at

    def predict(self, bins: np.ndarray | Block) -> np.ndarray:
        return self.value[self.leaves(bins)]


def _length(rows: np.ndarray | Block) -> int:
    return len(rows.label) if isinstance(rows, Block) else len(rows)


def as_tree(nodes: list[dict]) -> Tree:
    """Nodes as dicts (feature, cut, left, right, value, gain; a leaf needs only value) to arrays."""
    column = lambda name, empty, kind: np.array([n.get(name, empty) for n in nodes], kind)
    return Tree(
        column("feature", -1, np.int64), column("cut", 0, np.int64), column("left", 0, np.int64),
        column("right", 0, np.int64), column("value", 0.0, np.float64), column("gain", 0.0, np.float64),
    )
