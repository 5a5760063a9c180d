"""Boosters and forest against plain Python on small tables."""

import dataclasses
import heapq
import itertools

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from trialloom.operators import boosting, forest, histograms
from trialloom.operators.boosting import Boosting


def table(spark, x, y):
    rows = [(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    frame = spark.createDataFrame(rows, "meta_row long, f array<double>, label double")
    return frame.select("meta_row", array_to_vector("f").alias("features"), "label")


def data(seed, n=120, width=4):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 9, (n, width)).astype(float)
    y = np.round(x[:, 0] * (x[:, 1] > 4) + 2.0 * (x[:, 2] > 6) + rng.normal(size=n), 3)
    return x, y


def plain_split(x, g, spec):
    """Best (gain, feature, threshold) of rows with gradients g, all hessians one."""
    best = None
    score = lambda v: v.sum() ** 2 / (len(v) + spec.l2)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for a, b in itertools.pairwise(values):
            left = x[:, f] <= (a + b) / 2
            if min(left.sum(), (~left).sum()) < max(1, spec.least_rows, spec.least_hessian):
                continue
            gain = score(g[left]) + score(g[~left]) - score(g)
            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                best = (gain, f, (a + b) / 2)
    return best


def plain_tree(x, g, spec):
    """Prediction of one tree for every row, and its splits, by trying every split of every leaf."""
    out, splits, leaves, count = np.zeros(len(g)), [], [], itertools.count()

    def offer(rows, depth):
        out[rows] = -spec.rate * g[rows].sum() / (len(rows) + spec.l2)
        found = plain_split(x[rows], g[rows], spec) if depth < spec.depth else None
        if found:
            heapq.heappush(leaves, (-found[0] if spec.leaf_wise else depth, next(count), found, rows, depth))

    offer(np.arange(len(g)), 0)
    n = 1
    while leaves and n < spec.most_leaves:
        _, _, found, rows, depth = heapq.heappop(leaves)
        left = x[rows, found[1]] <= found[2]
        splits.append((found[1], round(found[0], 6)))
        offer(rows[left], depth + 1)
        offer(rows[~left], depth + 1)
        n += 1
    return out, splits


SPECS = {
    "level": Boosting(1, 0.01, 5, 0.01, least_hessian=2),
    "leaf": Boosting(1, 0.2, 3, 0.01, leaf_wise=True, most_leaves=31, least_rows=20),
    "few_leaves": Boosting(1, 0.5, 4, 0.01, leaf_wise=True, most_leaves=4),
    "few_leaves_by_level": Boosting(1, 0.5, 4, 0.01, most_leaves=4),
}


@pytest.mark.parametrize("name", SPECS)
def test_one_round_equals_plain_python(spark, name):
    x, y = data(11)
    spec = SPECS[name]
    model = boosting.boost(table(spark, x, y), "label", 4, spec)
    want, splits = plain_tree(x, y.mean() - y, spec)
    np.testing.assert_allclose(model.predicted(x), y.mean() + want, atol=1e-9)
    assert sorted((f, round(g, 6)) for f, g in model.splits()) == sorted(splits) and len(splits) > 2


def test_best_first_and_level_wise_growth_differ(spark):
    x, y = data(11)
    rows = table(spark, x, y)
    leaf, level = (boosting.boost(rows, "label", 4, SPECS[n]).splits() for n in ("few_leaves", "few_leaves_by_level"))
    assert len(leaf) == len(level) == 3 and sum(g for _, g in leaf) > sum(g for _, g in level)


def test_rounds_add_up_over_kept_blocks(spark):
    """More rounds than the blocks go without being kept anew, over several partitions."""
    x, y = data(3, n=90)
    spec = Boosting(boosting.KEEP_EVERY * 2 + 3, 0.3, 2, 0.01)
    histograms_rows, histograms.TASK_ROWS = histograms.TASK_ROWS, 20
    try:
        model = boosting.boost(table(spark, x, y), "label", 4, spec)
    finally:
        histograms.TASK_ROWS = histograms_rows
    now = np.full(len(y), y.mean())
    for _ in range(spec.rounds):
        now = now + plain_tree(x, now - y, spec)[0]
    np.testing.assert_allclose(model.predicted(x), now, atol=1e-7)
    model.output = "p"
    got = {r.meta_row: r.p for r in model.transform(table(spark, x, y)).collect()}
    np.testing.assert_allclose([got[i] for i in range(len(y))], now, atol=1e-7)


def test_columns_are_drawn_once_for_each_tree(spark):
    x, y = data(5, width=6)
    model = boosting.boost(table(spark, x, y), "label", 6, Boosting(6, 0.5, 4, 0.01, columns=0.34, seed=1))
    used = [set(t.feature[t.feature >= 0].tolist()) for t in model.trees]
    assert all(len(u) <= 2 for u in used) and len(set().union(*used)) > 2


def test_bins_of_few_and_many_values(spark):
    rng = np.random.default_rng(0)
    x = np.column_stack([rng.integers(0, 5, 4000), rng.normal(size=4000), np.zeros(4000)])
    edges = histograms.bin_edges(table(spark, x, x[:, 0]), 3)
    assert edges[0].tolist() == [0.5, 1.5, 2.5, 3.5] and len(edges[2]) == 0
    bins = histograms.binned(x, edges)
    counts = np.bincount(bins[:, 1])
    assert 200 < len(counts) <= histograms.MAX_BINS and counts.max() < 60


def plain_forest(x, y, weight):
    """Value of every row by one fully grown tree."""
    out = np.zeros(len(y))
    waiting = [np.arange(len(y))]
    while waiting:
        rows = waiting.pop()
        here = rows[weight[rows] > 0]
        out[rows] = np.average(y[here], weights=weight[here])
        best = None
        score = lambda r: (weight[r] * y[r]).sum() ** 2 / weight[r].sum()
        for f in range(x.shape[1]):
            for a, b in itertools.pairwise(np.unique(x[here, f])):
                left = here[x[here, f] <= a]
                right = here[x[here, f] > a]
                gain = score(left) + score(right) - score(here)
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, f, a)
        if best:
            left = x[rows, best[1]] <= best[2]
            waiting += [rows[left], rows[~left]]
    return out


@pytest.mark.parametrize("bound", [1 << 30, 700])
def test_forest_equals_plain_trees(spark, bound):
    """With the small bound the upper levels come from histograms and only small nodes are handed over."""
    x, y = data(7, n=80, width=3)
    rows = table(spark, x, y)
    spec = forest.ForestSpec(trees=5, seed=3, hand_over=bound)
    model = forest.fit_forest(rows, "label", 3, spec, F.xxhash64("meta_row"), "p")
    got = {r.meta_row: r.p for r in model.transform(rows).collect()}
    keys = np.array([r[0] for r in rows.orderBy("meta_row").select(F.xxhash64("meta_row")).collect()])
    want = sum(plain_forest(x, y, forest.poisson_weights(keys, t, 3)) for t in range(5)) / 5
    np.testing.assert_allclose([got[i] for i in range(len(y))], want, atol=1e-9)
    assert (model.subtrees.count() > 10) == (bound == 700)


def test_poisson_weights():
    keys = np.random.default_rng(1).integers(-(2**63), 2**63, 20_000)
    weight = forest.poisson_weights(keys, 4, 7)
    assert abs(weight.mean() - 1) < 0.03 and abs(weight.var() - 1) < 0.05
    assert (weight == forest.poisson_weights(keys, 4, 7)).all() and (weight != forest.poisson_weights(keys, 5, 7)).any()


def test_trees_as_deep_as_the_rows_ask(spark):
    x = np.arange(200.0)[:, None]
    tree = forest.finish(histograms.binned(x, [np.arange(0.5, 199)]), np.cumsum(np.arange(200.0) ** 6), np.ones(200))
    assert len(np.flatnonzero(tree.feature < 0)) == 200  # every row alone


def test_forest_of_many_rows_splits_a_level_at_once():
    """A level's nodes share their array steps: 30,000 rows that all end alone take a bounded number of them."""
    rng = np.random.default_rng(2)
    bins = rng.integers(0, 200, (30_000, 3)).astype(np.uint8)
    label, weight = rng.normal(size=len(bins)), rng.integers(1, 4, len(bins)).astype(float)
    calls = []
    kept, forest._sorted_splits = forest._sorted_splits, lambda *a: calls.append(1) or kept(*a)
    try:
        tree = forest.finish(bins, label, weight)
    finally:
        forest._sorted_splits = kept
    assert len(calls) < 100 and (tree.feature < 0).sum() > 29_000
    own = tree.predict(bins)
    _, at = np.unique(bins, axis=0, return_inverse=True)
    means = np.bincount(at.ravel(), weight * label) / np.bincount(at.ravel(), weight)
    np.testing.assert_allclose(own, means[at.ravel()], atol=1e-9)


def test_a_subtree_is_sent_once_for_all_blocks_of_rows(spark):
    """Scoring a handed-over tree joins no copy of it to each block."""
    x, y = data(9, n=60, width=3)
    rows = table(spark, x, y)
    model = forest.fit_forest(rows, "label", 3, forest.ForestSpec(trees=2, seed=1), F.xxhash64("meta_row"), "p")
    plan = model.transform(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "subtree" in plan


def test_histograms_stay_with_the_tasks(spark, monkeypatch):
    """What the driver gets from a level is one split for each node and group of features."""
    x, y = data(4, n=90)
    monkeypatch.setattr(histograms, "TASK_ROWS", 20)
    seen = []
    kept = boosting.first_of
    monkeypatch.setattr(boosting, "first_of", lambda groups, spec: seen.append(groups) or kept(groups, spec))
    model = boosting.boost(table(spark, x, y), "label", 4, SPECS["level"])
    want, _ = plain_tree(x, y.mean() - y, SPECS["level"])
    np.testing.assert_allclose(model.predicted(x), y.mean() + want, atol=1e-9)
    assert seen and all(len(total) == 2 and (not split or len(split) == 4) for groups in seen for g in groups for total, split in g)


def test_quantile_edges_of_thinned_values(monkeypatch):
    values = np.random.default_rng(3).normal(size=50_000)
    kept, counts = histograms._thinned(values, np.ones(len(values), np.int64), 1000)
    assert len(kept) == 1000 and counts.sum() == len(values)
    place = np.searchsorted(np.sort(values), kept, side="right")
    assert np.abs(place - np.cumsum(counts)).max() == 0 and counts.max() <= 51
    whole, counts = histograms._thinned(np.array([3.0, 1.0, 3.0]), np.array([1, 2, 4]), 1000)
    assert whole.tolist() == [1.0, 3.0] and counts.tolist() == [2, 5]


@pytest.mark.parametrize("name", SPECS)
def test_rows_of_a_few_tasks_are_boosted_in_one(spark, monkeypatch, name):
    """No job for each level of a tree where the rows are few; the trees are those of the jobs."""
    x, y = data(6, n=90)
    monkeypatch.setattr(histograms, "TASK_ROWS", 30)
    spec = dataclasses.replace(SPECS[name], rounds=3)
    rows = table(spark, x, y)
    calls = []
    kept = histograms.split_by_features
    monkeypatch.setattr(histograms, "split_by_features", lambda *a: calls.append(1) or kept(*a))
    here = boosting.boost(rows, "label", 4, spec)
    assert not calls
    monkeypatch.setattr(boosting, "WHOLE_TASKS", 0)
    spread = boosting.boost(rows, "label", 4, spec)
    assert calls
    np.testing.assert_allclose(here.predicted(x), spread.predicted(x), atol=1e-9)
    assert [(f, round(g, 6)) for f, g in here.splits()] == [(f, round(g, 6)) for f, g in spread.splits()]


def test_wide_rows_are_not_boosted_in_one_task(spark, monkeypatch):
    x, y = data(6, n=90)
    monkeypatch.setattr(histograms, "TASK_ROWS", 30)
    monkeypatch.setattr(boosting, "WHOLE_BYTES", 90 * (4 + 24) - 1)
    calls = []
    kept = histograms.split_by_features
    monkeypatch.setattr(histograms, "split_by_features", lambda *a: calls.append(1) or kept(*a))
    boosting.boost(table(spark, x, y), "label", 4, SPECS["leaf"])
    assert calls


@pytest.mark.parametrize("common", [0, 4, 8])
def test_rows_of_a_common_bin_are_not_sorted(common):
    """A bin with most rows, lowest, in the middle or highest, is made up from the others: the tree is the plain one."""
    rng = np.random.default_rng(common)
    x = np.where(rng.random((400, 4)) < 0.8, common, rng.integers(0, 9, (400, 4))).astype(float)
    x[:, 3] = rng.integers(0, 9, 400)  # no common bin
    y = np.round(x[:, 0] - 2.0 * (x[:, 1] > 5) + rng.normal(size=400), 3)
    weight = rng.integers(0, 4, 400).astype(float)
    own = weight > 0
    sizes = []
    kept = forest._sorted_splits
    forest._sorted_splits = lambda *a: sizes.append(sum(map(len, a[1]))) or kept(*a)
    try:
        tree = forest.finish(x[own].astype(np.uint8), y[own], weight[own])
    finally:
        forest._sorted_splits = kept
    np.testing.assert_allclose(tree.predict(x.astype(np.uint8)), plain_forest(x, y, weight), atol=1e-9)
    assert sizes[0] < 2 * own.sum()  # of four features; one is sorted whole


def instances(seed, n=40, of=32, odd=0):
    """Rows of n instances with ``of`` bundles each: six features of the instance, five of the bundle, one of both; labels."""
    rng = np.random.default_rng(seed)
    own, bundle = np.repeat(np.arange(n), of), np.tile(np.arange(of), n)
    profile = rng.integers(0, 30, (n, 6))
    bits = (bundle[:, None] >> np.arange(5)) & 1
    x = np.column_stack([profile[own, :3], bits, profile[own, 3:], profile[own, 0] + 3 * bits.sum(1)]).astype(float)
    x[rng.choice(len(x), odd, replace=False), 0] += 1  # rows that differ from their instance
    y = np.round(profile[own, 1] * 0.3 + bits[:, 0] * (profile[own, 4] > 12) + rng.normal(size=len(own)), 3)
    return x, y, own


@pytest.mark.parametrize("odd", [0, 1])
def test_tree_over_units_of_instances_equals_that_over_rows(monkeypatch, odd):
    x, y, own = instances(4, odd=odd)
    weight = forest.poisson_weights(np.arange(len(y)), 1, 7)
    k = weight > 0
    bins, y, weight, own = x[k].astype(np.uint8), y[k], weight[k], own[k]
    shared = histograms.shared_of(bins, own)
    assert set(shared.columns) == {0, 1, 2, 8, 9, 10} and 40 <= len(shared.bins) <= 41  # one odd row is a unit of its own
    np.testing.assert_array_equal(shared.bins[shared.unit], bins[:, shared.columns])
    for most in (forest.MOST_DENSE, 0):  # with histograms first, and sorted from the root on
        monkeypatch.setattr(forest, "MOST_DENSE", most)
        plain, seen = forest.finish(bins, y, weight), []
        splits = forest._Side.splits
        monkeypatch.setattr(forest._Side, "splits", lambda side, rank, *more: seen.append((len(side.columns), len(rank))) or splits(side, rank, *more))
        tree = forest.finish(bins, y, weight, own)
        monkeypatch.setattr(forest._Side, "splits", splits)
        for name in ("feature", "cut", "left", "right"):
            np.testing.assert_array_equal(getattr(tree, name), getattr(plain, name))
        np.testing.assert_allclose(tree.value, plain.value)
        np.testing.assert_allclose(tree.gain, plain.gain, rtol=1e-6, atol=1e-9)
        assert seen[1] == (6, len(shared.bins))  # the instance's features were read for each unit, not for each row


def test_rows_without_anything_shared_stay_rows():
    x, _, own = instances(5)
    bins = x.astype(np.uint8)
    assert histograms.shared_of(bins, np.arange(len(bins))) is None
    assert histograms.shared_of(np.random.default_rng(0).integers(0, 9, bins.shape).astype(np.uint8), own) is None
    assert histograms.shared_of(bins[:2], own[:2]) is None


@pytest.mark.parametrize("rows_of_a_task", [histograms.TASK_ROWS, 100])
def test_booster_over_units_equals_plain_python(spark, monkeypatch, rows_of_a_task):
    """In one task, and by jobs; instances ride along as the key of a row."""
    x, y, own = instances(6, n=30, of=16, odd=1)
    rows = [(f"i{g}", [float(v) for v in r], float(t)) for g, r, t in zip(own, x, y)]
    frame = spark.createDataFrame(rows, "meta_instance_id string, f array<double>, label double")
    frame = frame.select("meta_instance_id", array_to_vector("f").alias("features"), "label")
    monkeypatch.setattr(histograms, "TASK_ROWS", rows_of_a_task)
    kinds = []
    loaded = histograms.loaded

    def seen(*args, **more):
        blocks = loaded(*args, **more)
        kinds.append([(len(b.label), None if b.shared is None else len(b.shared.bins)) for b in blocks.collect()])
        return blocks

    monkeypatch.setattr(histograms, "loaded", seen)
    spec = dataclasses.replace(SPECS["leaf"], rounds=3, least_rows=5)
    model = boosting.boost(frame, "label", x.shape[1], spec)
    now = np.full(len(y), y.mean())
    for _ in range(spec.rounds):
        now = now + plain_tree(x, now - y, spec)[0]
    np.testing.assert_allclose(model.predicted(x), now, atol=1e-7)
    blocks = kinds[0]
    assert sum(n for n, _ in blocks) == len(y) and (len(blocks) > 1) == (rows_of_a_task == 100)
    assert all(units is not None and units * 4 <= n for n, units in blocks)


def test_small_and_large_trees_read_blocks_as_they_read_rows():
    x, y, own = instances(8)
    bins = x.astype(np.uint8)
    block = histograms.block_of(bins, y, own, np.zeros(len(y)), own)
    assert block.shared and block.bins.shape[1] == 6
    whole, group = block.whole()
    np.testing.assert_array_equal(whole, bins)
    assert len(np.unique(group)) == len(block.shared.bins)
    for rows in (40, len(y)):
        tree = forest.finish(bins[:rows], y[:rows], np.ones(rows))
        assert (len(tree.feature) <= histograms.FEW_NODES) == (rows == 40)
        np.testing.assert_array_equal(tree.leaves(block), tree.leaves(bins))
        np.testing.assert_array_equal(tree.predict(block), tree.predict(bins))
    node = np.where(np.arange(len(y)) % 3 == 2, -1, np.arange(len(y)) % 3)
    np.testing.assert_allclose(
        histograms.sums_by_bin(block, node, (y, None), 2, 70, [11, 0, 4, 9]),
        histograms.block_histograms(bins, node, (y, None), 2, 70, [11, 0, 4, 9]),
    )
