"""Toxicity by a counterfactually regularised linear classifier.

Features are a text's distinct words and the beginnings of words. The fit minimises logistic
loss plus a penalty on score changes: in the labelled sentences that mention an identity term,
the term is swapped for the others of its group, and the squared change of the score is added.
Identity terms then cannot carry the verdict, so neutral mentions of a group are not flagged.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.llm.labelled import SAMPLE_ROWS, counted, features, held_out, matrix, sample
from trialloom.llm.texts import pieces

WORD = regex.compile(r"\p{L}+")
SENTENCE = regex.compile(r"[.!?\n]+")
#: Groups of terms that may be swapped for one another; a parameter.
IDENTITY = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("female", "male"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("african", "european", "american", "arab"),
    ("gay", "lesbian", "straight", "bisexual"), ("transgender", "cisgender"),
    ("immigrants", "refugees", "natives", "citizens"), ("old", "young"),
    ("frauen", "männer"), ("christen", "muslime", "juden"), ("schwarze", "weiße"),
    ("femmes", "hommes"), ("chrétiens", "musulmans", "juifs"), ("noirs", "blancs"),
    ("mujeres", "hombres"), ("cristianos", "musulmanes", "judíos"), ("negros", "blancos"),
)
BEGINNINGS = (3, 4, 5, 6, 7)
#: Features kept (those that tell the labels apart most), in how many examples at least, the
#: weights of the ridge and of the swap penalty, and the steps of the fit.
FEATURES, LEAST, RIDGE, SWAP, STEPS = 4096, 3, 1.0, 1.0, 250
THRESHOLD, CACHED_WORDS = 0.3, 300_000


def word_features(word: str) -> list[str]:
    return [word + "$", *(word[:n] for n in BEGINNINGS if len(word) > n)]


def words(text: str | None) -> set[str]:
    found: set[str] = set()
    for piece in pieces(text or ""):
        found.update(WORD.findall(piece.lower()))
    return found


def text_features(text: str | None) -> set[str]:
    return {f for w in words(text) for f in word_features(w)}


def swaps(text: str | None, groups: Iterable[Iterable[str]] = IDENTITY) -> list[str]:
    """``term swapped`` for every sentence and swap; nothing after the blank if the sentence has both."""
    partner = {t: [o for o in group if o != t] for group in groups for t in group}
    found = []
    for piece in pieces(text or ""):
        for sentence in SENTENCE.split(piece.lower()):
            own = set(WORD.findall(sentence))
            for term in own & partner.keys():
                found += [f"{term} {'' if other in own else other}" for other in partner[term]]
    return found


class Model:
    """Weights of features; a text's score is the logistic of the sum over its distinct words."""

    def __init__(self, weights: dict[str, float], bias: float) -> None:
        self.weights, self.bias = weights, bias
        self.cache: dict[str, float] = {}

    def word(self, word: str) -> float:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) >= CACHED_WORDS:
                self.cache.clear()
            found = self.cache[word] = sum(self.weights.get(f, 0.0) for f in word_features(word))
        return found

    def score(self, text: str | None) -> float:
        total = self.bias + math.fsum(map(self.word, words(text)))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, total))))


def descend(label, rows, pairs, width: int, ridge: float, swap: float, steps: int) -> np.ndarray:
    """Weights (the last one is the bias) of the penalised logistic fit, by Adam steps.

    ``pairs`` lists (times, added features, removed features) of the swaps.
    """
    n, lengths = len(label), np.array([len(x) for x in rows], np.int64)
    at = np.concatenate(rows) if n else np.array([], np.int64)
    owner = np.repeat(np.arange(n), lengths)
    change = np.zeros((len(pairs), width))
    for i, (_, added, removed) in enumerate(pairs):
        np.add.at(change[i], added, 1.0)
        np.add.at(change[i], removed, -1.0)
    times = np.array([x for x, _, _ in pairs], float)
    weights, first, second = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        total = np.bincount(owner, weights[at], n) + weights[-1]
        wrong = 1 / (1 + np.exp(-np.clip(total, -700, 700))) - label
        slope = np.r_[np.bincount(at, wrong[owner], width) + ridge * weights[:-1], wrong.sum()]
        if len(pairs):
            slope[:-1] += 2 * swap * (times * (change @ weights[:-1])) @ change
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        rate = 0.05 * (1.0 if step < 0.7 * steps else 0.2)
        weights -= rate * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return weights


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", divisor: int = 4, value: int = 2,
    rows: int = SAMPLE_ROWS, groups: Iterable[Iterable[str]] = IDENTITY, swap: float = SWAP,
) -> Model:
    """Model of a bounded sample of labelled rows that aren't held out.

    Without rows of both labels the score is the share of ones, or 0.5 without any.
    """
    examples = sample(docs, labels, label, divisor, value, rows)
    total, ones = examples.selectExpr("count(*)", "coalesce(sum(label), 0)").first()
    if not 0 < ones < total:
        share = min(max((ones + 1) / (total + 2), 1e-6), 1 - 1e-6) if total else 0.5
        return Model({}, math.log(share / (1 - share)))
    zeros = total - ones
    strength = F.abs(F.col("ones") * zeros - F.col("zeros") * ones) / F.sqrt(
        F.expr("ones + zeros").cast("double") * (total - F.expr("ones + zeros") + 1) + 1
    )
    best = counted(examples, text_features, LEAST).orderBy(strength.desc(), "feature").limit(FEATURES)
    names = [r[0] for r in best.select("feature").collect()]
    index = {f: i for i, f in enumerate(names)}
    groups = tuple(map(tuple, groups))
    swapped = features(F.col("text"), lambda x: swaps(x, groups))
    mentions = examples.select(F.explode(swapped).alias("swap")).groupBy("swap").count().collect()
    pairs = []
    for text, times in sorted(mentions):
        term, _, other = text.partition(" ")
        added = [index[f] for f in (word_features(other) if other else []) if f in index]
        pairs.append((times, added, [index[f] for f in word_features(term) if f in index]))
    weights = descend(*matrix(examples, text_features_known(index), index), pairs, len(names), RIDGE, swap, STEPS)
    return Model({f: float(weights[i]) for f, i in index.items() if weights[i]}, float(weights[-1]))


def text_features_known(index: dict[str, int]):
    """A feature counts once for every distinct word that has it, as in scoring."""

    def own(text: str) -> list[str]:
        return [f for w in words(text) for f in word_features(w) if f in index]

    return own


_loaded: dict[str, Model] = {}


class Scorer:
    """A model as Spark columns; its weights are bounded and broadcast."""

    def __init__(self, spark: SparkSession, model: Model) -> None:
        content = pickle.dumps((model.weights, model.bias))
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


def scored(docs: DataFrame, labels: DataFrame, divisor: int = 4, value: int = 2, **fitting) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, by ``labels.toxic``.

    A null text scores as an empty one: the logistic of the bias. Repeated rows give repeated
    results; a null doc_id is not held out; columns besides doc_id and text (and doc_id and toxic
    of ``labels``) are not read; empty tables give empty tables.
    """
    scorer = Scorer(docs.sparkSession, fit(docs, labels, "toxic", divisor, value, **fitting))
    found = docs.select(
        "doc_id", held_out(F.col("doc_id"), divisor, value).alias("held_out"), scorer.score(F.col("text")).alias("score")
    )
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_harmless(docs: DataFrame, learn: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that score below the threshold; the model learns from ``learn``."""
    scorer = Scorer(docs.sparkSession, fit(learn, labels))
    return docs.where(scorer.score(F.col("text")) < THRESHOLD)
