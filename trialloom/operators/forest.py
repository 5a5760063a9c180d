"""Random forest of unbounded depth.

The upper levels of all trees grow together on histograms, a group of nodes per Spark job. As soon as a
node's rows are below a byte bound they are handed over: one shuffle brings the rows of each such
(tree, node) to a task that finishes the subtree on its own, however deep. Bootstrap weights are
Poisson draws from a hash of the row's key and the tree, so no row is copied for a tree before that
shuffle, and a repeated task draws the same. Finished subtrees are a written table; scoring sends
rows to the subtrees in the same way, so a forest larger than its data never passes the driver.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.operators import histograms
from trialloom.operators.boosting import Boosting, first_of, node_splits, slack
from trialloom.operators.clean import INSTANCE
from trialloom.operators.histograms import Tree
from trialloom.session import shared_dir, staged

#: Bytes of a node's rows up to which one task finishes it, and of histograms in one job.
HAND_OVER = 64 << 20
JOB_BYTES = 128 << 20
#: Mean rows of a level's nodes below which splits are found by sorting rather than by histograms, and
#: nodes beyond which they are in any case.
SORTED_ROWS, MOST_DENSE = 256, 128
#: Share of the rows above which a feature's most frequent bin is not sorted but made up from the others.
COMMON = 0.25
#: Bins up to which a feature's splits are found by histograms of all nodes where others are shared by rows.
NARROW = 8

_GAIN = Boosting(rounds=1, rate=1.0, depth=1 << 30, l2=0.0)


def poisson_weights(key: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Poisson(1) draws, one for each key, from a mixed hash of key, tree and seed."""
    with np.errstate(over="ignore"):
        x = key.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(2 * tree + 1) + np.uint64(seed)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return np.searchsorted(_POISSON, (x >> np.uint64(11)).astype(np.float64) / 2.0**53, side="right").astype(np.float64)


_POISSON = np.cumsum([np.exp(-1.0) / float(np.prod(np.arange(1.0, k + 1))) for k in range(12)])


def _dense_splits(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, rank: np.ndarray, nodes: int):
    """Feature (-1 for none), cut and gain of few nodes with many rows each, from histograms."""
    size = int(bins.max()) + 1
    sums = histograms.block_histograms(bins, rank, (weight * label, weight), nodes, size)
    feature, cut, gain = np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(nodes)
    for node, (_, found) in enumerate(node_splits(sums, np.arange(bins.shape[1]), _GAIN)):
        if found:
            gain[node], feature[node], cut[node] = found[:3]
    return feature, cut, gain


def _ordered(bins: np.ndarray, rank: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each feature the rows outside its common bin by node and bin, and that bin; a row's node is its ``rank``, below 256.

    A bin is common if it holds over ``COMMON`` of the rows; without one (-1) all rows are ordered.
    """
    place = (rank.astype(np.uint16) << 8)[:, None] | bins
    orders, common = [], np.full(bins.shape[1], -1)
    for i in range(bins.shape[1]):
        counts = np.bincount(bins[:, i])
        if counts.max() > COMMON * len(rank):
            common[i] = counts.argmax()
        rows = np.flatnonzero(bins[:, i] != common[i])
        orders.append(rows[np.argsort(place[rows, i], kind="stable")])
    return orders, common


def _with_common(runs: np.ndarray, parts: np.ndarray, bin_: int, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and sums of runs with those of the common bin: what is missing in a node's total (weight; centred labels add up to 0)."""
    node = runs >> 8
    first = np.append(0, np.flatnonzero(node[1:] != node[:-1]) + 1)
    rest = totals[node[first]] - np.add.reduceat(parts, first)
    there = rest.real > 0.5  # weights are whole numbers
    places = (node[first][there] << 8) + bin_
    at = np.searchsorted(runs, places) + np.arange(len(places))
    old = np.ones(len(runs) + len(at), bool)
    old[at] = False
    merged, sums = np.empty(len(old), runs.dtype), np.empty(len(old), parts.dtype)
    merged[at], sums[at], merged[old], sums[old] = places, rest[there], runs, parts
    return merged, sums


def _sorted_splits(bins: np.ndarray, orders: list[np.ndarray], common: np.ndarray, rank: np.ndarray, weight: np.ndarray, label: np.ndarray, sums, totals):
    """The same for many nodes at once, from rows ordered by node and bin for each feature.

    A feature's common bin isn't in its order; its sums are the node's less those of the other bins. An order loses rows of nodes in which it doesn't vary, if they are many: what is one value in a
    node is one value in all nodes below. Labels are centred in their node, so the running sums stay small.
    """
    nodes = len(totals)
    means, near = sums / totals, slack(sums**2 / totals)
    both = np.zeros(len(label), complex)  # weight and centred label, moved and summed as one
    both.real, both.imag = weight, np.where(rank >= 0, weight * (label - means[rank]), 0.0)
    high = rank.astype(np.int32 if nodes < 1 << 22 else np.int64) << 8
    feature, cut, gain = np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(nodes)
    for i, order in enumerate(orders):
        if not len(order):
            continue
        place = high[order] + bins[:, i][order]  # node and bin
        ends = np.append(np.flatnonzero(place[1:] != place[:-1]), len(order) - 1)
        runs, length, own_both = place[ends], np.diff(ends, prepend=-1), both[order]
        rows_in = runs >> 8
        if common[i] < 0:
            upto = np.cumsum(own_both)[ends]
        else:
            runs, parts = _with_common(runs, np.add.reduceat(own_both, ends - length + 1), common[i], totals)
            upto = np.cumsum(parts)
        node = runs >> 8
        last = np.append(node[1:] != node[:-1], True)  # of the node's runs: no cut behind it
        before = np.zeros(nodes, complex)
        before[node[1:][last[:-1]]] = upto[:-1][last[:-1]]
        at = np.flatnonzero(~last)
        own = node[at]
        varies = np.zeros(nodes, bool)
        varies[own] = True
        if length[~varies[rows_in]].sum() * 8 > len(order):
            orders[i] = order[np.repeat(varies[rows_in], length)]
        if not len(at):
            continue
        left, total = upto[at] - before[own], totals[own]
        each = left.imag**2 * total / (left.real * (total - left.real))
        begin = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
        here = own[begin]
        best = np.maximum.reduceat(each, begin)
        # the first cut within rounding of the node's best one
        close = np.flatnonzero(each >= np.repeat(best - near[here], np.diff(np.append(begin, len(own)))))
        spot = close[np.searchsorted(close, begin)]
        better = best > gain[here] + near[here]
        feature[here[better]], cut[here[better]], gain[here[better]] = i, runs[at[spot[better]]] & 255, best[better]
    return feature, cut, gain


def _dealt(order: np.ndarray, child: np.ndarray, nodes: int) -> np.ndarray:
    """Rows by child, otherwise in their order; those of child -1 are left out."""
    own = child[order]
    if nodes < 0xFFFF:  # short numbers are sorted by counting
        own = own.astype(np.uint16)  # -1 comes last
        return order[np.argsort(own, kind="stable")[: np.count_nonzero(own < nodes)]]
    order, own = order[own >= 0], own[own >= 0]
    low = np.argsort((own & 0xFFFF).astype(np.uint16), kind="stable")
    return order[low[np.argsort((own[low] >> 16).astype(np.uint16), kind="stable")]]


def _narrow_splits(bins: np.ndarray, size: int, rank: np.ndarray, weight: np.ndarray, label: np.ndarray, sums, totals):
    """The same for features with few bins, from histograms of all nodes; ``label`` is centred in its node."""
    nodes = len(totals)
    near = slack(sums**2 / totals)
    feature, cut, gain = np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(nodes)
    base = rank.astype(np.int64) * size
    product, every = weight * label, np.arange(nodes)
    for i in range(bins.shape[1]):
        slot = base + bins[:, i]
        left = np.cumsum(np.bincount(slot, weight, nodes * size).reshape(nodes, size), axis=1)[:, :-1]
        moved = np.cumsum(np.bincount(slot, product, nodes * size).reshape(nodes, size), axis=1)[:, :-1]
        right = totals[:, None] - left
        inner = (left > 0.5) & (right > 0.5)  # weights are whole numbers
        each = np.where(inner, moved**2 * totals[:, None] / np.where(inner, left * right, 1.0), -np.inf)
        best = each.max(axis=1)
        spot = np.argmax(each >= (best - near)[:, None], axis=1)
        better = best > gain + near
        feature[better], cut[better], gain[better] = i, spot[better], each[every, spot][better]
    return feature, cut, gain


def _taken(bins: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``bins[rows]``, feature by feature, as they are read."""
    out = np.empty((len(rows), bins.shape[1]), bins.dtype, "F")
    for i in range(bins.shape[1]):
        np.take(bins[:, i], rows, out=out[:, i], mode="clip")
    return out


class _Side:
    """Some features of a tree's rows, or of the units of rows that share them, and how their splits are found.

    ``columns`` are the features; rows are in any order, a row's node is its ``rank`` (-1: none any more).
    """

    def __init__(self, columns: np.ndarray, bins: np.ndarray):
        self.columns, self.bins, self.orders, self.common = columns, bins, None, None

    def splits(self, rank: np.ndarray, weight: np.ndarray, label: np.ndarray, sums, totals):
        nodes = len(totals)
        if self.orders is None and (nodes > MOST_DENSE or len(rank) < SORTED_ROWS * nodes):
            self.orders, self.common = _ordered(self.bins, rank)
        if self.orders is None:
            found = _dense_splits(self.bins, label, weight, rank, nodes)
        else:
            found = _sorted_splits(self.bins, self.orders, self.common, rank, weight, label, sums, totals)
        return np.where(found[0] >= 0, self.columns[found[0]], -1), found[1], found[2]

    def dealt(self, place: np.ndarray, count: np.ndarray, rank: np.ndarray, nodes: int) -> None:
        """Each row becomes ``count`` rows (0, 1 or 2) from ``place`` on, whose nodes are ``rank``."""
        self.bins = _taken(self.bins, np.repeat(np.arange(len(count)), count))
        most = count.max(initial=0)
        for i, order in enumerate(self.orders or []):
            if most < 2:
                each = place[order[count[order] > 0]]
            else:
                each = np.repeat(order, count[order])
                second = np.append(False, each[1:] == each[:-1])[: len(each)]
                each = place[each] + second
            self.orders[i] = _dealt(each, rank, nodes)

    def moved(self, rows: np.ndarray, place: np.ndarray, stays: np.ndarray, rank: np.ndarray, nodes: int) -> None:
        """Only ``rows`` are left, in this order; ``place`` is where a row is now."""
        if not len(self.columns):
            return
        self.bins = _taken(self.bins, rows)
        for i, order in enumerate(self.orders or []):
            self.orders[i] = _dealt(place[order[stays[order] > 0]], rank, nodes)


def _better(found, other, sums, totals) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two splits of each node the one with more gain; within rounding that of the smaller feature."""
    near = slack(sums**2 / totals)
    (feature, cut, gain), (feature_2, cut_2, gain_2) = found, other
    second = (feature_2 >= 0) & ((feature < 0) | (gain_2 > gain + near) | ((gain_2 >= gain - near) & (feature_2 < feature)))
    return tuple(np.where(second, y, x) for x, y in ((feature, feature_2), (cut, cut_2), (gain, gain_2)))


def finish(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, group: np.ndarray | None = None) -> Tree:
    """The whole tree over a node's rows: split while any split lowers the squared error.

    All nodes of a level are split together: the first levels on histograms, the others on rows that are
    sorted once and then dealt to the children. Features that rows of a ``group`` share are split on units,
    the rows of a node with the same values of all of them; a unit is parted where a node is split on another feature.
    """
    width = bins.shape[1]
    common = None if group is None else histograms.shared_of(bins, group)
    sizes = np.array([int(bins[:, i].max(initial=0)) + 1 for i in range(width)], np.int64)
    rest = np.arange(width) if common is None else common.rest(width)
    narrow, wide = (rest[sizes[rest] <= NARROW], rest[sizes[rest] > NARROW]) if common else (rest[:0], rest)
    bins = np.asfortranarray(bins)
    few, side, shared = bins[:, narrow], _Side(wide, bins[:, wide]), None
    if common:
        shared, unit = _Side(common.columns, common.bins), common.unit
    where = np.zeros(width, np.int64)  # place of a feature among those of its kind
    for columns in (narrow, wide, common.columns if common else rest[:0]):
        where[columns] = np.arange(len(columns))
    kind = np.zeros(width, np.int64)
    kind[wide] = 1
    if common:
        kind[common.columns] = 2
    levels, made = [], 1
    rank, nodes = np.zeros(len(label), np.int32), 1
    while nodes:  # rows of a node are side by side
        first = np.concatenate([[0], np.flatnonzero(np.diff(rank)) + 1])
        sums, totals = np.add.reduceat(weight * label, first), np.add.reduceat(weight, first)
        mixed = np.minimum.reduceat(label, first) < np.maximum.reduceat(label, first)
        value = np.where(mixed, sums / totals, label[first])
        found = np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(nodes)
        if mixed.any():
            if len(wide):
                found = side.splits(rank, weight, label, sums, totals)
            if sizes[narrow].max(initial=0) > 1:
                own = _narrow_splits(few, int(sizes[narrow].max()), rank, weight, label - (sums / totals)[rank], sums, totals)
                found = _better(found, (np.where(own[0] >= 0, narrow[own[0]], -1), *own[1:]), sums, totals)
            if shared:
                many = len(shared.bins)
                unit_rank = np.empty(many, np.int32)
                unit_rank[unit] = rank
                unit_weight = np.bincount(unit, weight, many)
                unit_label = np.bincount(unit, weight * label, many) / unit_weight
                found = _better(found, shared.splits(unit_rank, unit_weight, unit_label, sums, totals), sums, totals)
        feature, cut, gain = found
        split = np.flatnonzero((feature >= 0) & mixed)
        left = np.zeros(nodes, np.int64)
        left[split] = made + 2 * np.arange(len(split))
        feature[~mixed] = -1
        levels.append((feature, cut, left, np.where(left > 0, left + 1, 0), value, np.where(left > 0, gain, 0.0)))
        made += 2 * len(split)
        place = np.full(nodes, -1)
        place[split] = np.arange(len(split))
        nodes = 2 * len(split)
        if not nodes:
            break
        chosen = np.maximum(feature, 0)
        of, at = kind[chosen][rank], where[chosen][rank]
        mine = np.zeros(len(rank), np.int64)
        for k, (table, row) in enumerate(((few, None), (side.bins, None), (shared and shared.bins, common and unit))):
            here = np.flatnonzero(of == k)
            if len(here):
                mine[here] = table[here if row is None else row[here], at[here]]
        right = mine > cut[rank]
        child = np.where(place[rank] >= 0, 2 * place[rank] + right, -1).astype(np.int32)
        rows = _dealt(np.arange(len(rank)), child, nodes)
        new_place = np.zeros(len(rank), np.int64)
        new_place[rows] = np.arange(len(rows))
        rank = child[rows]
        if shared:
            goes = np.zeros((2, len(shared.bins)), bool)
            goes[right[rows].astype(np.int64), unit[rows]] = True
            count = goes.sum(axis=0)
            start = np.cumsum(count) - count
            unit = start[unit[rows]] + (right[rows] & goes[0][unit[rows]])
            unit_rank = np.empty(int(count.sum()), np.int32)
            unit_rank[unit] = rank
            shared.dealt(start, count, unit_rank, nodes)
        stays = np.zeros(len(child), np.int64)
        stays[rows] = 1
        few, label, weight = _taken(few, rows), label[rows], weight[rows]
        side.moved(rows, new_place, stays, rank, nodes)
    kinds = np.int32, np.int16, np.int32, np.int32, np.float64, np.float64
    return Tree(*[np.concatenate(each).astype(kind) for each, kind in zip(zip(*levels), kinds)])


@dataclass(frozen=True)
class ForestSpec:
    trees: int = 200
    seed: int = 7
    hand_over: int = HAND_OVER


def _upper(blocks, width: int, size: int, spec: ForestSpec) -> list[Tree]:
    """Upper levels of each tree: nodes whose rows are above the byte bound are split, the rest are leaves."""
    row_bytes = width + 16
    nodes: list[list[dict]] = [[{}] for _ in range(spec.trees)]
    seed = spec.seed

    def totals(part):
        rows = 0
        for block in part:
            rows += len(block.label)
        return [rows]

    rows = blocks.mapPartitions(totals).treeReduce(lambda a, b: a + b)
    waiting = [(t, 0) for t in range(spec.trees)] if rows * row_bytes > spec.hand_over else []
    group = max(1, JOB_BYTES // (2 * 8 * width * size))
    while waiting:
        now, waiting = waiting[:group], waiting[group:]
        wanted: dict[int, list[int]] = {}
        for i, (t, _) in enumerate(now):
            wanted.setdefault(t, []).append(i)
        shapes = {}
        for t, own in wanted.items():
            number = np.full(len(nodes[t]), -1)
            number[[now[i][1] for i in own]] = np.arange(len(own))
            shapes[t] = histograms.as_tree(nodes[t]), number

        def local(part, n=len(now), wanted=wanted, shapes=shapes):
            total = None
            for block in part:
                total = np.zeros((2, n, width, size)) if total is None else total
                for t, own in wanted.items():
                    weight = poisson_weights(block.key, t, seed)
                    tree, number = shapes[t]
                    node = np.where(weight > 0, number[tree.leaves(block)], -1)
                    total[:, own] += histograms.sums_by_bin(block, node, (weight * block.label, weight), len(own), size)
            return total

        best = lambda sums, columns: node_splits(sums, columns, _GAIN)
        found = first_of(histograms.split_by_features(blocks, local, np.arange(width), best), _GAIN)
        for (t, node), (total, split) in zip(now, found):
            if not split:
                continue
            gain, feature, cut, left = split
            place = len(nodes[t])
            nodes[t][node].update(feature=feature, cut=cut, gain=gain, left=place, right=place + 1)
            nodes[t] += [{}, {}]
            sides = (left, total - left)
            waiting += [(t, place + k) for k in (0, 1) if sides[k][1] * row_bytes > spec.hand_over]
    return [histograms.as_tree(each) for each in nodes]


def _routed(table: DataFrame, upper: Sequence[Tree], width: int, weights: int | None) -> DataFrame:
    """Rows of every block by tree and upper leaf: tree, node, the block's first key; key, bins, label, weight and group as bytes.

    With ``weights`` (the seed) rows of weight zero stay out; without it every row goes to every tree.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bins = np.frombuffer(row["bins"], np.uint8).reshape(row["n"], width)
                label, key, group = np.frombuffer(row["label"]), np.frombuffer(row["key"], np.int64), np.frombuffer(row["group"], np.int64)
                for t, tree in enumerate(upper):
                    weight = np.ones(len(key)) if weights is None else poisson_weights(key, t, weights)
                    ends = tree.leaves(bins)
                    for node in np.unique(ends[weight > 0]):
                        at = np.flatnonzero((ends == node) & (weight > 0))
                        cells = [key[at], bins[at], label[at], weight[at].astype(np.uint8), group[at]]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([t], pa.int32()), pa.array([int(node)]), pa.array([int(key[0])])]
                            + [pa.array([c.tobytes()], pa.binary()) for c in cells],
                            ["tree", "node", "block", "key", "bins", "label", "weight", "group"],
                        )

    return table.mapInArrow(deal, "tree int, node long, block long, key binary, bins binary, label binary, weight binary, group binary")


def _finished(width: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        column = lambda name, kind: np.frombuffer(b"".join(group.column(name).to_pylist()), kind)
        order = np.argsort(column("key", np.int64), kind="stable")  # blocks come in any order
        bins, label, weight = column("bins", np.uint8).reshape(-1, width)[order], column("label", float)[order], column("weight", np.uint8)[order]
        tree = finish(bins, label, weight.astype(float), column("group", np.int64)[order])
        t, node = (k.as_py() for k in key)
        return pa.table({"tree": pa.array([t], pa.int32()), "node": [node], "subtree": [pickle.dumps(tree)]})

    return run


class ForestModel(Transformer):
    """Upper levels of the trees, and the table of their subtrees."""

    def __init__(self, edges: list[np.ndarray], upper: list[Tree], subtrees: DataFrame, output: str):
        super().__init__()
        self.edges, self.upper, self.subtrees, self.output = edges, upper, subtrees, output

    def _transform(self, dataset: DataFrame) -> DataFrame:
        width = len(self.edges)
        rows = staged(dataset.withColumn("_row", F.monotonically_increasing_id()), "to_score")
        table = histograms.block_table(rows.withColumn("_label", F.lit(0.0)), self.edges, "_label", F.col("_row"))
        routed = _routed(table, self.upper, width, None).select("tree", "node", "block", "key", "bins")

        def predicted(_: tuple, dealt: pa.Table, own: pa.Table) -> pa.Table:
            if not dealt.num_rows:
                return pa.table({"block": pa.array([], pa.int64()), "key": pa.array([], pa.binary()), "value": pa.array([], pa.binary())})
            tree: Tree = pickle.loads(own.column("subtree")[0].as_py())
            values = [
                tree.predict(np.frombuffer(cell, np.uint8).reshape(-1, width)).tobytes() for cell in dealt.column("bins").to_pylist()
            ]
            return pa.table({"block": dealt.column("block"), "key": dealt.column("key"), "value": pa.array(values, pa.binary())})

        def added(_: tuple, group: pa.Table) -> pa.Table:
            keys, values = (np.frombuffer(b"".join(group.column(c).to_pylist()), kind) for c, kind in (("key", np.int64), ("value", float)))
            row, at = np.unique(keys, return_inverse=True)
            return pa.table({"_row": row, "total": np.bincount(at, values, len(row))})

        # a subtree meets all its rows at once: as a join it would be copied for each block of rows
        values = routed.groupBy("tree", "node").cogroup(self.subtrees.groupBy("tree", "node"))
        sums = values.applyInArrow(predicted, "block long, key binary, value binary").groupBy("block")
        means = sums.applyInArrow(added, "_row long, total double").select("_row", (F.col("total") / len(self.upper)).alias(self.output))
        return rows.join(means, "_row", "left").drop("_row")


def fit_forest(rows: DataFrame, label: str, width: int, spec: ForestSpec, key: Column, output: str) -> ForestModel:
    """Fit on ``rows`` (vector ``features``, ``label``, no nulls); rows of equal ``key`` get equal weights."""
    shared_dir(rows.sparkSession)
    rows = rows.select("features", label, key.alias("_key"), histograms.group_of(rows.columns, f"meta_{INSTANCE}").alias("_group"))
    edges = histograms.bin_edges(rows, width)
    near = histograms.gathered(rows, "_group")
    table = staged(histograms.block_table(near, edges, label, F.col("_key"), F.col("_group")), "blocks")
    blocks = histograms.loaded(table, width, 0.0, histograms.tasks_for(rows))
    upper = _upper(blocks, width, histograms.most_bins(edges), spec)
    blocks.unpersist()
    routed = _routed(table, upper, width, spec.seed)
    schema = "tree int, node long, subtree binary"
    subtrees = staged(routed.groupBy("tree", "node").applyInArrow(_finished(width), schema), "subtrees")
    return ForestModel(edges, upper, subtrees, output)


class Forest(Estimator):
    """Pipeline stage that fits ``fit_forest``; rows are told apart by their ``meta_`` columns."""

    def __init__(self, spec: ForestSpec, width: int, label: str, output: str):
        super().__init__()
        self.spec, self.width, self.label, self.output = spec, width, label, output

    def _fit(self, dataset: DataFrame) -> ForestModel:
        meta = [F.col(c) for c in dataset.columns if c.startswith("meta_")]
        key = F.xxhash64(*meta) if meta else F.xxhash64(vector_to_array("features"))
        return fit_forest(dataset, self.label, self.width, self.spec, key, self.output)
