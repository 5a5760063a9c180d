"""Gradient boosting with second-order gains, level by level or leaf by leaf.

A node's gain from a split is G_l^2/(H_l + L2) + G_r^2/(H_r + L2) - G^2/(H + L2), with G and H the sums
of gradients and hessians of the squared error, and a leaf predicts -G/(H + L2) times the rate.
Columns are drawn once for each tree. Leaves wait in a queue: by gain for leaf-wise (best-first)
growth, by depth for level-wise growth. One Spark job gives the best splits of the children of all
leaves that may still be split; histograms stay with the tasks (``histograms.split_by_features``).
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Estimator, Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.operators import histograms
from trialloom.operators.clean import INSTANCE
from trialloom.operators.histograms import Block, Tree
from trialloom.session import shared_dir, staged

#: Trees after which predictions so far are kept.
KEEP_EVERY = 10
#: Tasks' worth of rows, and bytes of them, up to which one task boosts them all: a round over more is worth its jobs.
WHOLE_TASKS, WHOLE_BYTES = 4, 64 << 20


@dataclass(frozen=True)
class Boosting:
    """What a booster is fitted with."""

    rounds: int
    rate: float
    depth: int
    l2: float
    columns: float = 1.0
    leaf_wise: bool = False
    most_leaves: int = 1 << 30
    least_rows: int = 1
    least_hessian: float = 0.0
    seed: int = 0


@dataclass
class Leaf:
    """A leaf that may be split: its place in the tree, sums and best split."""

    at: int
    depth: int
    total: np.ndarray
    split: tuple[float, int, int, np.ndarray] | None = None
    children: list[Leaf] = field(default_factory=list)


def slack(score: float) -> float:
    """Differences between gains that rounding alone may make."""
    return 1e-10 * (1.0 + score)


def first_best(gain: np.ndarray, slack: float) -> tuple[int, int] | None:
    """First place (feature, cut) of the largest gain, whatever order its sums were added in; None if it is no gain."""
    best = gain.max(initial=-np.inf)
    if not best > slack:
        return None
    return divmod(int(np.argmax(gain >= best - slack)), gain.shape[1])


def best_split(sums: np.ndarray, total: np.ndarray, columns: np.ndarray, spec: Boosting):
    """Largest gain over ``columns`` and cuts, its feature and cut, and the sums to the left; or None.

    ``sums`` holds gradients and hessians per (feature, bin); ties go to the smaller feature and cut.
    """
    left = np.cumsum(sums[:, columns], axis=2)[:, :, :-1]
    g, h = left
    right_g, right_h = total[0] - g, total[1] - h
    fits = (h >= max(spec.least_rows, spec.least_hessian)) & (right_h >= max(spec.least_rows, spec.least_hessian))
    fits &= (h > 0.5) & (right_h > 0.5)  # each hessian is one, so both sides have rows
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = g * g / (h + spec.l2) + right_g * right_g / (right_h + spec.l2) - total[0] ** 2 / (total[1] + spec.l2)
    gain = np.where(fits, gain, -np.inf)
    spot = first_best(gain, slack(total[0] ** 2 / (total[1] + spec.l2)))
    if spot is None:
        return None
    feature, cut = spot
    return float(gain[feature, cut]), int(columns[feature]), int(cut), left[:, feature, cut].copy()


def node_splits(sums: np.ndarray, columns: np.ndarray, spec: Boosting) -> list[tuple]:
    """Of each node the total and the best split over ``columns``, whose histograms ``sums`` holds."""
    out = []
    for node in range(sums.shape[1]):
        total = sums[:, node, 0].sum(axis=1)
        found = best_split(sums[:, node], total, np.arange(len(columns)), spec)
        out.append((total, found and (found[0], int(columns[found[1]]), *found[2:])))
    return out


def first_of(groups: Sequence[list[tuple]], spec: Boosting) -> list[tuple]:
    """The best split of each node over groups of features in their order."""
    out = []
    for found in zip(*groups):
        total = found[0][0]
        splits = [split for _, split in found if split]
        least = max((split[0] for split in splits), default=0.0) - slack(total[0] ** 2 / (total[1] + spec.l2) if total[1] else 0.0)
        out.append((total, next((split for split in splits if split[0] >= least), None)))
    return out


def _local_sums(blocks, since: Sequence[Tree], partial: Tree, wanted: np.ndarray, columns: np.ndarray, size: int) -> np.ndarray | None:
    total = None
    for block in blocks:
        gradient = reduce(lambda m, tree: m + tree.predict(block), since, block.margin) - block.label
        node = wanted[partial.leaves(block)]
        one = histograms.sums_by_bin(block, node, (gradient, None), int(wanted.max()) + 1, size, columns)
        total = one if total is None else total + one
    return total


def _splits(blocks, since: Sequence[Tree], partial: Tree, wanted: np.ndarray, columns: np.ndarray, spec: Boosting, size: int) -> list[tuple]:
    """Totals and best splits of the nodes of ``partial`` that ``wanted`` numbers from 0."""
    if isinstance(blocks, list):
        return node_splits(_local_sums(blocks, since, partial, wanted, columns, size), columns, spec)
    groups = histograms.split_by_features(
        blocks,
        lambda part: _local_sums(part, since, partial, wanted, columns, size),
        columns,
        lambda sums, own: node_splits(sums, own, spec),
    )
    return first_of(groups, spec)


def grow(blocks, since: Sequence[Tree], columns: np.ndarray, spec: Boosting, size: int) -> Tree:
    """One tree for the gradients of the blocks' margins plus the trees ``since``."""
    nodes: list[dict] = [{}]

    def value(total: np.ndarray) -> float:
        return float(-spec.rate * total[0] / (total[1] + spec.l2))

    def splits_of(wanted: Sequence[int]) -> list[tuple]:
        number = np.full(len(nodes), -1)
        number[list(wanted)] = np.arange(len(wanted))
        return _splits(blocks, since, histograms.as_tree(nodes), number, columns, spec, size)

    queue: list[tuple] = []

    def offer(leaf: Leaf) -> None:
        nodes[leaf.at]["value"] = value(leaf.total)
        if leaf.depth < spec.depth and leaf.split:
            heapq.heappush(queue, (-leaf.split[0] if spec.leaf_wise else leaf.depth, leaf.at, leaf))

    offer(Leaf(0, 0, *splits_of([0])[0]))
    leaves = 1
    while queue and leaves < spec.most_leaves:
        if not queue[0][2].children:
            _open([entry[2] for entry in heapq.nsmallest(spec.most_leaves - leaves, queue)], nodes, splits_of, spec)
        leaf = heapq.heappop(queue)[2]
        gain, feature, cut, _ = leaf.split
        left, right = leaf.children
        # the children have their places already; only now is the leaf an inner node of the result
        nodes[leaf.at].update(chosen=True, gain=gain)
        leaves += 1
        offer(left)
        offer(right)
    return histograms.as_tree(_chosen(nodes))


def _open(waiting: list[Leaf], nodes: list[dict], splits_of, spec: Boosting) -> None:
    """Children of waiting leaves, with their best splits where they may be split themselves, in one job."""
    deeper: list[Leaf] = []
    for leaf in waiting:
        if leaf.children:
            continue
        _, feature, cut, left = leaf.split
        for total in (left, leaf.total - left):
            leaf.children.append(Leaf(len(nodes), leaf.depth + 1, total))
            nodes.append({"value": 0.0})
        nodes[leaf.at].update(feature=feature, cut=cut, left=leaf.children[0].at, right=leaf.children[1].at)
        if leaf.depth + 1 < spec.depth:
            deeper += leaf.children
    if deeper:
        for leaf, (_, split) in zip(deeper, splits_of([leaf.at for leaf in deeper])):
            leaf.split = split


def _chosen(nodes: list[dict]) -> list[dict]:
    """The tree without the splits that were looked at but not taken, its nodes numbered anew."""
    out: list[dict] = []

    def add(at: int) -> int:
        node, place = nodes[at], len(out)
        out.append({"value": node.get("value", 0.0)})
        if node.get("chosen"):
            out[place].update(feature=node["feature"], cut=node["cut"], gain=node["gain"])
            out[place].update(left=add(node["left"]), right=add(node["right"]))
        return place

    add(0)
    return out


def _moved(block: Block, since: Sequence[Tree]) -> Block:
    return replace(block, margin=reduce(lambda m, tree: m + tree.predict(block), since, block.margin))


def _joined(blocks) -> list[Block]:
    parts = [*blocks]
    return [histograms.joined(parts)] if parts else []


def _rounds(blocks, width: int, size: int, spec: Boosting) -> list[Tree]:
    """All trees; ``blocks`` are an RDD, or a list inside a task that has all of them."""
    here = isinstance(blocks, list)
    trees: list[Tree] = []
    since: list[Tree] = []
    drawn = max(1, int(spec.columns * width))
    for number in range(spec.rounds):
        columns = np.sort(np.random.default_rng([spec.seed, number]).permutation(width)[:drawn])
        since.append(grow(blocks, since, columns, spec, size))
        trees.append(since[-1])
        if here:
            blocks, since = [_moved(block, since) for block in blocks], []
        elif len(since) == KEEP_EVERY and number + 1 < spec.rounds:
            moved = blocks.map(lambda block, since=tuple(since): _moved(block, since)).persist(StorageLevel.MEMORY_AND_DISK)
            moved.count()
            blocks.unpersist()
            blocks, since = moved, []
    if not here:
        blocks.unpersist()
    return trees


def boost(rows: DataFrame, label: str, width: int, spec: Boosting) -> BoostedModel:
    """Fit a booster on ``rows`` (vector ``features`` and ``label``, no nulls), starting from the mean label.

    Rows worth a few tasks only (``WHOLE_TASKS`` of ``histograms.TASK_ROWS``) are boosted inside one task, with the
    same trees: a round has up to five jobs, which take longer than reading so few rows on one core.
    """
    shared_dir(rows.sparkSession)
    tasks = histograms.tasks_for(rows)
    rows = rows.select("features", label, histograms.group_of(rows.columns, f"meta_{INSTANCE}").alias("_group"))
    edges = histograms.bin_edges(rows, width)
    size = histograms.most_bins(edges)
    table = staged(histograms.block_table(histograms.gathered(rows, "_group"), edges, label, group=F.col("_group")), "blocks")
    start = float(rows.agg(F.avg(label)).first()[0] or 0.0)
    blocks = histograms.loaded(table, width, start, tasks, keyed=False)
    if tasks <= WHOLE_TASKS and tasks * histograms.TASK_ROWS * (width + 24) <= WHOLE_BYTES:
        whole = blocks.coalesce(1).mapPartitions(lambda part: [_rounds(_joined(part), width, size, spec)])
        return BoostedModel(edges, whole.collect()[0], start)
    return BoostedModel(edges, _rounds(blocks, width, size, spec), start)


class BoostedModel(Transformer):
    """A start value and trees over binned features; predictions are their sum."""

    def __init__(self, edges: list[np.ndarray], trees: list[Tree], start: float, output: str = "prediction"):
        super().__init__()
        self.edges, self.trees, self.start, self.output = edges, trees, start, output

    def splits(self) -> list[tuple[int, float]]:
        """Feature and gain of every split."""
        inner = [np.flatnonzero(tree.feature >= 0) for tree in self.trees]
        return [(int(t.feature[i]), float(t.gain[i])) for t, at in zip(self.trees, inner) for i in at]

    def predicted(self, matrix: np.ndarray) -> np.ndarray:
        bins = histograms.binned(matrix, self.edges)
        return reduce(lambda m, tree: m + tree.predict(bins), self.trees, np.full(len(bins), self.start))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        predicted = self.predicted

        @F.pandas_udf("double")
        def sums(x: pd.Series) -> pd.Series:
            return pd.Series(predicted(np.stack(x.to_numpy())) if len(x) else [])

        return dataset.withColumn(self.output, sums(vector_to_array("features")))


class Booster(Estimator):
    """Pipeline stage that fits ``boost`` on ``features`` and ``label``."""

    def __init__(self, spec: Boosting, width: int, label: str, output: str):
        super().__init__()
        self.spec, self.width, self.label, self.output = spec, width, label, output

    def _fit(self, dataset: DataFrame) -> BoostedModel:
        model = boost(dataset, self.label, self.width, self.spec)
        model.output = self.output
        return model
