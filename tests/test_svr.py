"""Support-vector regression against a plain solver of the kernel dual."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from trialloom.operators import histograms, svr


def rows_of(seed, n=60, width=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    return x, np.sin(2 * x[:, 0]) * 3 + x[:, 1] + 4 + 0.1 * rng.normal(size=n)


def frame(spark, x, y):
    rows = [(i, r.tolist(), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "meta_row long, f array<double>, label double").select(
        "meta_row", array_to_vector("f").alias("scaled"), "label"
    )


def plain_objective(x, y, spec):
    """Optimum of the primal by projected descent on the kernel dual, one variable after the other."""
    gamma = 1 / x.shape[1]
    square = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    k = np.exp(-gamma * square) + svr.INTERCEPT**2
    beta = np.zeros(len(y))
    for _ in range(3000):
        for i in range(len(y)):
            z = beta[i] - (k[i] @ beta - y[i]) / k[i, i]
            z = np.sign(z) * max(0.0, abs(z) - spec.tube / k[i, i])
            beta[i] = min(spec.penalty, max(-spec.penalty, z))
    fitted = k @ beta
    primal = 0.5 * beta @ fitted + spec.penalty * np.maximum(0, np.abs(y - fitted) - spec.tube).sum()
    return primal, fitted


@pytest.mark.parametrize("task_rows", [1000, 20])
def test_objective_is_that_of_a_plain_solver(spark, monkeypatch, task_rows):
    """With all rows as landmarks the kernel is exact; in one task and spread over three."""
    monkeypatch.setattr(histograms, "TASK_ROWS", task_rows)
    x, y = rows_of(1)
    spec = svr.SvrSpec(landmarks=60, gap=1e-4, rounds=400 if task_rows > 100 else 120)
    if task_rows < 100:
        spec = svr.SvrSpec(landmarks=60, gap=2e-2, rounds=60)
    model = svr.fit_svr(frame(spark, x, y), "scaled", "label", 3, spec, ["meta_row"])
    primal, fitted = plain_objective(x, y - y.mean(), spec)
    fitted = fitted + y.mean()
    assert model.gap <= spec.gap  # the optimality condition
    assert primal - 1e-6 <= model.objective <= primal * (1 + 2 * spec.gap)
    got = {r.meta_row: r.prediction for r in model.transform(frame(spark, x, y)).collect()}
    assert np.abs(np.array([got[i] for i in range(len(y))]) - fitted).mean() < (0.05 if task_rows > 100 else 0.3)


def test_few_landmarks_repeated_rows_and_one_value(spark):
    x, y = rows_of(2, n=40)
    x = np.concatenate([x, x[:5]])
    y = np.concatenate([y, y[:5]])
    model = svr.fit_svr(frame(spark, x, y), "scaled", "label", 3, svr.SvrSpec(landmarks=8), [])
    assert model.marks.points.shape == (8, 3) and model.gap <= 1e-3
    flat = svr.fit_svr(frame(spark, x, np.full(45, 2.0)), "scaled", "label", 3, svr.SvrSpec(landmarks=8), [])
    got = [r.prediction for r in flat.transform(frame(spark, x, y)).collect()]
    assert max(abs(p - 2.0) for p in got) < 0.15


def test_many_rows_take_few_passes(monkeypatch):
    """The passes over rows in several tasks don't grow with them, and the gap is reached."""
    for n in (500, 20_000):
        x, y = rows_of(3, n=n)
        spec, passes = svr.SvrSpec(landmarks=40), []
        marks = svr.Landmarks(x[:40])
        mapped, label = marks.map(x), y - y.mean()

        def sums(weights, wide):
            passes.append(wide)
            halves = [svr.rounded_sums(mapped[i::2], label[i::2], weights, wide, spec) for i in (0, 1)]
            return halves[0] + halves[1]

        weights, primal, gap = svr._solve(sums, mapped.shape[1], float(np.abs(label).mean()), spec)
        exact = 0.5 * weights @ weights + np.maximum(0, np.abs(label - mapped @ weights) - spec.tube).sum()
        assert gap <= spec.gap and abs(primal - exact) < 1e-6 * exact and len(passes) < 80


def test_rows_of_one_label_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(histograms, "TASK_ROWS", 20)
    x, _ = rows_of(2, n=45)
    model = svr.fit_svr(frame(spark, x, np.full(45, 2.0)), "scaled", "label", 3, svr.SvrSpec(landmarks=8), [])
    assert model.gap <= 1e-3 and max(abs(r.prediction - 2.0) for r in model.transform(frame(spark, x, x[:, 0])).collect()) < 0.15
