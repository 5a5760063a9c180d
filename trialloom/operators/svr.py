"""Support-vector regression: epsilon-insensitive loss over landmark (Nystroem) features.

The RBF kernel's map is taken at a bounded number of landmark rows; beyond those every row counts.
Rows worth one task are solved in the dual, which has one variable for each row, by coordinate descent.
More rows are solved in the weights, whose number is bounded by the landmarks: Newton steps on the loss
with its corners rounded off over a width that shrinks, one pass over the rows for each step. The
rounded loss' slopes are dual variables, so each pass gives the gap between primal and dual
objective, which says when to stop and bounds how far from the optimum the weights are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Estimator, Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.operators.histograms import feature_matrix, tasks_for
from trialloom.session import shared_dir, staged

#: Value of the constant feature that stands for the intercept of centred labels.
INTERCEPT = 1.0
#: By how much the rounding's width shrinks, and the share of the gap not due to it below which it does.
SHRINK, WORTH = 0.4, 0.5


@dataclass(frozen=True)
class SvrSpec:
    """Penalty and tube of the loss, landmarks, and when to stop."""

    penalty: float = 1.0
    tube: float = 0.1
    landmarks: int = 256
    rounds: int = 300
    gap: float = 1e-3


@dataclass(frozen=True)
class Rows:
    """Mapped rows, their labels and dual variables, and by how much they moved the weights."""

    mapped: np.ndarray
    label: np.ndarray
    dual: np.ndarray
    moved: np.ndarray


class Landmarks:
    """The kernel's map: similarity to the landmarks, whitened, and a constant."""

    def __init__(self, points: np.ndarray) -> None:
        self.points, self.gamma = points, 1.0 / max(1, points.shape[1])
        values, vectors = np.linalg.eigh(self.kernel(points))
        kept = values > 1e-10 * max(1.0, values.max(initial=0.0))
        self.whiten = vectors[:, kept] / np.sqrt(values[kept])

    def kernel(self, x: np.ndarray) -> np.ndarray:
        square = (x * x).sum(axis=1)[:, None] - 2.0 * x @ self.points.T + (self.points * self.points).sum(axis=1)
        return np.exp(-self.gamma * np.maximum(square, 0.0))

    def map(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([self.kernel(x) @ self.whiten, np.full(len(x), INTERCEPT)])


def descend(rows: Rows, weights: np.ndarray, spec: SvrSpec, order: np.random.Generator) -> Rows:
    """One pass over the rows; ``moved`` is what the weights have to change by."""
    dual, local = rows.dual.copy(), weights.copy()
    curve = (rows.mapped * rows.mapped).sum(axis=1)
    for i in order.permutation(len(dual)):
        x = rows.mapped[i]
        slope = float(local @ x) - rows.label[i]
        best = dual[i] - slope / curve[i]
        best = np.sign(best) * max(0.0, abs(best) - spec.tube / curve[i])
        best = min(spec.penalty, max(-spec.penalty, best))
        if best != dual[i]:
            local += (best - dual[i]) * x
            dual[i] = best
    return replace(rows, dual=dual, moved=(dual - rows.dual) @ rows.mapped)


def parts(rows: Rows, weights: np.ndarray, spec: SvrSpec) -> np.ndarray:
    """The rows' share of the loss and of the dual objective, without the weights' own terms."""
    loss = np.maximum(0.0, np.abs(rows.label - rows.mapped @ weights) - spec.tube).sum() * spec.penalty
    return np.array([loss, rows.dual @ rows.label - spec.tube * np.abs(rows.dual).sum()])


def _gap(share: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Primal objective, and the gap to the dual one in relation to it."""
    half = 0.5 * float(weights @ weights)
    primal, dual = share[0] + half, share[1] - half
    return primal, (primal - dual) / max(1.0, abs(primal))


def solve_here(rows: Rows, width: int, spec: SvrSpec) -> tuple[np.ndarray, float, float]:
    """Weights, objective and gap of rows that are all in one task."""
    weights, order = np.zeros(width), np.random.default_rng(0)
    for _ in range(spec.rounds):
        rows = descend(rows, weights, spec, order)
        weights = weights + rows.moved
        primal, gap = _gap(parts(rows, weights, spec), weights)
        if gap <= spec.gap:
            break
    return weights, primal, gap


@dataclass
class Rounded:
    """Sums over rows at some weights and width: loss, rounded loss, dual objective, moved weights and curvature."""

    loss: float
    rounded: float
    dual: float
    moved: np.ndarray
    curve: np.ndarray

    def __add__(self, other: Rounded) -> Rounded:
        return Rounded(*(getattr(self, f) + getattr(other, f) for f in ("loss", "rounded", "dual", "moved", "curve")))


def rounded_sums(mapped: np.ndarray, label: np.ndarray, weights: np.ndarray, wide: float, spec: SvrSpec) -> Rounded:
    """The loss past the tube is a parabola over ``wide`` and a line from there on."""
    off = label - mapped @ weights
    past = np.maximum(0.0, np.abs(off) - spec.tube)
    bent = (past > 0) & (past < wide)
    dual = spec.penalty * np.sign(off) * np.minimum(past / wide, 1.0)
    inside = mapped[bent]
    return Rounded(
        spec.penalty * past.sum(),
        spec.penalty * np.where(past < wide, past * past / (2 * wide), past - wide / 2).sum(),
        dual @ label - spec.tube * np.abs(dual).sum(),
        dual @ mapped,
        spec.penalty / wide * (inside.T @ inside),
    )


def _solve(sums, width: int, wide: float, spec: SvrSpec) -> tuple[np.ndarray, float, float]:
    """Weights, objective and gap; ``sums(weights, wide)`` adds ``rounded_sums`` up over all rows."""
    weights, wide = np.zeros(width), max(wide, spec.tube, 1e-9)
    best, found, bound = np.inf, weights, -np.inf
    now = sums(weights, wide)
    for _ in range(spec.rounds):
        half = 0.5 * float(weights @ weights)
        primal, dual = now.loss + half, now.dual - 0.5 * float(now.moved @ now.moved)
        if primal < best:
            best, found = primal, weights
        bound = max(bound, dual)
        if best - bound <= spec.gap * max(1.0, abs(best)):
            break
        slope = weights - now.moved
        step = -np.linalg.solve(np.eye(width) + now.curve, slope)
        promise = -float(slope @ step)
        # half the slope's square is the gap of the rounded loss, the rest of the gap is due to the rounding
        if 0.5 * float(slope @ slope) <= WORTH * (primal - dual):
            wide *= SHRINK
            weights = weights + step
            now = sums(weights, wide)
            continue
        share, before = 1.0, now.rounded + half
        while True:
            moved = weights + share * step
            now = sums(moved, wide)
            if now.rounded + 0.5 * float(moved @ moved) <= before - 1e-4 * share * promise or share < 1e-6:
                break
            share *= 0.3
        weights = moved
    return found, best, (best - bound) / max(1.0, abs(best))


def fit_svr(rows: DataFrame, features: str, label: str, width: int, spec: SvrSpec, key: Sequence[str] = ()) -> SvrModel:
    """Fit on ``rows`` (scaled vector column ``features``, ``label``, no nulls).

    Landmarks are the rows with the smallest hash of the ``key`` columns (of the features without
    any), so the same rows give the same model.
    """
    shared_dir(rows.sparkSession)
    tasks = tasks_for(rows)
    spot = F.xxhash64(*key) if key else F.xxhash64(vector_to_array(features))
    wanted = rows.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"), spot.alias("spot"))
    table = staged(wanted.repartition(tasks, "spot"), "svr_rows")
    first = table.orderBy("spot", "y").limit(spec.landmarks).select("x").collect()
    marks = Landmarks(np.array([r.x for r in first], float).reshape(len(first), width))
    own = marks.whiten.shape[1] + 1

    center = float(table.agg(F.avg("y")).first()[0] or 0.0)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = feature_matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], ["x", "y"])

    # rows are kept as they are and mapped in each pass: mapped ones would take several times the memory
    records = table.select("x", "y").mapInArrow(cut, "x binary, y binary").coalesce(tasks).rdd
    blocks = records.map(lambda r: (np.frombuffer(r.x).reshape(-1, width), np.frombuffer(r.y) - center)).persist(StorageLevel.MEMORY_AND_DISK)
    if tasks == 1:

        def whole(part):
            x, y = (np.concatenate(each) for each in zip(*part))
            yield solve_here(Rows(marks.map(x), y, np.zeros(len(y)), np.zeros(own)), own, spec)

        weights, primal, gap = blocks.coalesce(1).mapPartitions(whole).collect()[0]
    else:

        def sums(now: np.ndarray, wide: float) -> Rounded:
            return blocks.map(lambda pair: rounded_sums(marks.map(pair[0]), pair[1], now, wide, spec)).treeReduce(lambda a, b: a + b)

        off = float(table.agg(F.avg(F.abs(F.col("y") - center))).first()[0])
        weights, primal, gap = _solve(sums, own, off, spec)
    blocks.unpersist()
    return SvrModel(marks, weights, center, primal, gap, features)


class SvrModel(Transformer):
    """Landmarks and weights, with the objective reached and the gap it was left with."""

    def __init__(
        self, marks: Landmarks, weights: np.ndarray, center: float, objective: float, gap: float, features: str, output: str = "prediction"
    ):
        super().__init__()
        self.marks, self.weights, self.center, self.objective, self.gap = marks, weights, center, objective, gap
        self.features, self.output = features, output

    def _transform(self, dataset: DataFrame) -> DataFrame:
        marks, weights, center = self.marks, self.weights, self.center

        @F.pandas_udf("double")
        def value(x: pd.Series) -> pd.Series:
            return pd.Series(marks.map(np.stack(x.to_numpy())) @ weights + center if len(x) else [])

        return dataset.withColumn(self.output, value(vector_to_array(self.features)))


class Svr(Estimator):
    """Pipeline stage that fits ``fit_svr`` on the scaled features."""

    def __init__(self, spec: SvrSpec, width: int, features: str, label: str, output: str):
        super().__init__()
        self.spec, self.width, self.features, self.label, self.output = spec, width, features, label, output

    def _fit(self, dataset: DataFrame) -> SvrModel:
        key = [c for c in dataset.columns if c.startswith("meta_")]
        model = fit_svr(dataset, self.features, self.label, self.width, self.spec, key)
        model.output = self.output
        return model
