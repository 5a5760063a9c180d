"""Top lists against all products in plain Python."""

import math
from random import Random

import numpy as np
import pytest

from trialloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>"


def plain_top(rows, wanted, k, scale=256):
    good = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    found = []
    for q, v in {(i, tuple(v)) for i, v in good if wanted(i)}:
        scores = [(-sum(a * b for a, b in zip(v, c)), i) for i, c in good if i != q and len(c) == len(v)]
        found += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(found)


def test_small_tiles_give_all_products(spark, monkeypatch):
    draw = Random(3)
    rows = [(i, [float(np.float32(draw.uniform(-1, 1))) for _ in range(6)]) for i in range(300)]
    rows += [(i, [0.5] * 6) for i in range(300, 400)]  # a very common vector
    rows += [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [(950, [1.0, 2.0]), (1000, [2.0, 1.0]), (1050, []), (905, [])]
    vectors = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", rank int, score int")
    monkeypatch.setattr(topk, "TILE_ROWS", 7)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    got = sorted(map(tuple, topk.top_k(vectors, vectors.where("vec_id % 50 = 0")).collect()))
    assert got == plain_top(rows, lambda i: i % 50 == 0, 5)


def test_large_components_stay_exact(spark):
    rows = [(0, [3e7, 1.0]), (1, [3e7, 3.0]), (2, [3e7, 2.0]), (50, [-1e12, 5e11]), (3, [1e12, 1e12]), (4, [1e30, 0.0])]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    got = sorted(map(tuple, topk.top_k(*[spark.createDataFrame(rows, SCHEMA)] * 2).collect()))
    want = [(q, r, i, max(-topk.LONG, min(topk.LONG, s))) for q, r, i, s in plain_top(rows, lambda i: True, 5)]
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in want]


def test_few_candidates_and_empty(spark):
    one = spark.createDataFrame([(0, [1.0])], SCHEMA)
    assert topk.top_k(one, one).collect() == []
    assert topk.top_k(one.limit(0), one).collect() == [] and topk.top_k(one, one.limit(0)).collect() == []
    two = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (7, [-0.001]), (7, [-0.001])], SCHEMA)
    got = sorted(map(tuple, topk.top_k(two, two).collect()))
    assert got == [(0, 1, 7, -256), (0, 2, 7, -256), (7, 1, 0, -256), (7, 2, 0, -256)]


@pytest.mark.parametrize("k", [1, 3, 9])
def test_best_breaks_ties_by_column(k):
    draw = np.random.default_rng(k)
    scores = draw.integers(0, 4, (20, 8))
    row, column = topk.best(scores, np.arange(8), np.full(20, 3), k)
    for i in range(20):
        want = sorted((c for c in range(8) if c != 3), key=lambda c: (-scores[i, c], c))[:k]
        assert column[row == i].tolist() == want


def test_query_matches_sql(spark):
    from tests.compare import connect, differences
    from trialloom.llm.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.001"
    _, problems = differences(spark, connect(sf), "op4", QUERIES["op4_exact_topk"], ORACLES["op4_exact_topk"], sf)
    assert not problems
