"""Quality by naive Bayes support vectors.

Indicators of n-grams are scaled by the log of their class-count ratios, and a linear model is
fitted on the scaled vectors (of unit length) with hinge loss by dual coordinate descent. The
score is the logistic of the margin, its slope fitted to the labels.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from operator import eq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.llm.labelled import SAMPLE_ROWS, counted, held_out, matrix, sample
from trialloom.llm.texts import word_pieces

TOKEN = regex.compile(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+")
#: n-grams kept (those with the largest weight of evidence), in how many examples at least, the
#: smoothing of counts, the bound of the dual variables, and the passes over the examples.
FEATURES, LEAST, SMOOTHING, BOUND, PASSES = 30_000, 5, 1.0, 1.0, 30
THRESHOLD = 0.3
#: n-grams of a word that comes again at once: twice, and four times.
AGAIN = {"= =": b"\1", "= = = =": b"\1\1\1"}


def ngrams(text: str | None) -> set[str]:
    """Words, runs of signs and their pairs, each once; and marks of words said again at once."""
    found: set[str] = set()
    tokens: list[str] = []
    for piece in word_pieces(text or ""):
        tokens = tokens[-3:] + TOKEN.findall(piece.lower())  # pairs and runs go on across the cut
        found.update(tokens)
        found.update(map(" ".join, zip(tokens, tokens[1:])))
        same = bytes(map(eq, tokens, tokens[1:]))
        found.update(name for name, run in AGAIN.items() if run in same)
    return found


class Model:
    """Ratios and weights of n-grams, and the line from margins to scores."""

    def __init__(self, grams: dict[str, tuple[float, float]], bias: float, slope: float, offset: float) -> None:
        self.grams, self.bias, self.slope, self.offset = grams, bias, slope, offset

    def score(self, text: str | None) -> float:
        own = [self.grams[g] for g in ngrams(text) if g in self.grams]
        length = math.sqrt(1 + math.fsum(r * r for r, _ in own))
        margin = math.fsum(r * w for r, w in own) / length + self.bias
        total = self.slope * margin + self.offset
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, total))))


def dual_descent(sign: np.ndarray, at: list[np.ndarray], values: list[np.ndarray], width: int, bound: float, passes: int):
    """Weights and bias of the hinge-loss fit; each step solves one dual variable exactly."""
    weights, bias, dual = np.zeros(width), 0.0, np.zeros(len(sign))
    square = np.array([1 + v @ v for v in values])
    draw = np.random.default_rng(7)
    for _ in range(passes):
        moved = 0.0
        for i in draw.permutation(len(sign)):
            slope = sign[i] * (weights[at[i]] @ values[i] + bias) - 1
            new = min(max(dual[i] - slope / square[i], 0.0), bound)
            step, dual[i] = (new - dual[i]) * sign[i], new
            if step:
                weights[at[i]] += step * values[i]
                bias += step
                moved += abs(step)
        if moved < 1e-6 * len(sign):
            break
    return weights, bias


def line(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic fit of labels to margins, by damped Newton steps."""
    x = np.c_[margin, np.ones(len(margin))]
    found = np.array([1.0, 0.0])
    target = np.where(label == 1, (label.sum() + 1) / (label.sum() + 2), 1 / (len(label) - label.sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ found, -700, 700)))
        second = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(second, x.T @ (p - target))
        found -= step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return float(found[0]), float(found[1])


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", divisor: int = 5, value: int = 0, rows: int = SAMPLE_ROWS
) -> Model:
    """Model of a bounded sample of labelled rows that aren't held out.

    Without rows of both labels the score is the share of ones, or 0.5 without any.
    """
    examples = sample(docs, labels, label, divisor, value, rows)
    total, ones = examples.selectExpr("count(*)", "coalesce(sum(label), 0)").first()
    if not 0 < ones < total:
        share = (ones + 1) / (total + 2) if total else 0.5
        return Model({}, 0.0, 1.0, math.log(share / (1 - share)))
    zeros, a = total - ones, SMOOTHING
    ratio = F.log((F.col("ones") + a) / (ones + 2 * a)) - F.log((F.col("zeros") + a) / (zeros + 2 * a))
    best = counted(examples, ngrams, LEAST).withColumn("ratio", ratio)
    best = best.orderBy((F.abs("ratio") * F.sqrt(F.expr("ones + zeros"))).desc(), "feature").limit(FEATURES)
    kept = [tuple(r) for r in best.select("feature", "ratio").collect()]
    index = {g: i for i, (g, _) in enumerate(kept)}
    ratios = np.array([r for _, r in kept])
    known, at = matrix(examples, ngrams, index)
    values = [ratios[x] / math.sqrt(1 + ratios[x] @ ratios[x]) for x in at]
    weights, bias = dual_descent(np.where(known == 1, 1.0, -1.0), at, values, len(kept), BOUND, PASSES)
    slope, offset = line(np.array([weights[x] @ v + bias for x, v in zip(at, values)]), known)
    grams = {g: (r, float(weights[i])) for i, (g, r) in enumerate(kept)}
    return Model(grams, bias, slope, offset)


_loaded: dict[str, Model] = {}


class Scorer:
    """A model as Spark columns; its n-grams are bounded and broadcast."""

    def __init__(self, spark: SparkSession, model: Model) -> None:
        content = pickle.dumps((model.grams, model.bias, model.slope, model.offset))
        name, held = hashlib.sha256(content).hexdigest(), spark.sparkContext.broadcast(content)

        def load() -> Model:
            if name not in _loaded:
                _loaded.clear()
                _loaded[name] = Model(*pickle.loads(held.value))
            return _loaded[name]

        self.load = load

    def score(self, text: Column) -> Column:
        load = self.load

        @F.arrow_udf("double")
        def column(texts: pa.Array) -> pa.Array:
            return pa.array([load().score(x) for x in texts.to_pylist()], pa.float64())

        return column(text)


def scored(docs: DataFrame, labels: DataFrame, divisor: int = 5, value: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, by ``labels.quality``.

    A null text scores as an empty one. Repeated rows give repeated results; a null doc_id is not
    held out; columns besides doc_id and text (and doc_id and quality of ``labels``) are not read;
    empty tables give empty tables.
    """
    scorer = Scorer(docs.sparkSession, fit(docs, labels, "quality", divisor, value))
    found = docs.select(
        "doc_id", held_out(F.col("doc_id"), divisor, value).alias("held_out"), scorer.score(F.col("text")).alias("score")
    )
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
