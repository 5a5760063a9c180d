"""Toxicity and quality: held-out figures, the swap penalty, the dual fit, and edges."""

import math

import numpy as np
import pytest

from tests.llm.test_langid import is_held_out
from trialloom.llm import quality, toxicity

SF = "/root/testdata/sf0.1"


def figures(spark, name, label, divisor, value):
    from trialloom.llm.queries import QUERIES

    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES[name](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == is_held_out(r.doc_id, divisor, value) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    told = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    count = lambda p, t: sum(x == (p, t) for x in told)
    return count(1, 1), count(1, 0), count(0, 1), count(0, 0)


def test_toxicity_held_out(spark):
    hit, false, missed, _ = figures(spark, "op3_toxicity", "toxic", 4, 2)
    assert hit >= 0.9 * (hit + missed) and hit >= 0.95 * (hit + false)


def test_quality_held_out(spark):
    hit, false, missed, right = figures(spark, "op6_quality", "quality", 5, 0)
    assert hit >= 0.98 * (hit + missed) and right >= 0.85 * (right + false)


def tables(spark, texts, label):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, (t, _) in enumerate(texts)], "doc_id long, text string, score int, label string")
    labels = spark.createDataFrame([(i, y, 0) for i, (_, y) in enumerate(texts)], f"doc_id long, {label} int, text int")
    return docs, labels


def test_swaps_of_sentences():
    got = toxicity.swaps("Muslims came. Jews and muslims met! no one", [("muslims", "jews", "hindus")])
    assert sorted(got) == sorted(["muslims jews", "muslims hindus", "jews ", "jews hindus", "muslims ", "muslims hindus"])


def test_swap_penalty_spares_neutral_mentions(spark):
    """One group is mentioned mostly in toxic texts; the penalty takes that from its name."""
    texts = []
    for i in range(400):
        if i % 4 == 0:
            texts.append((f"the muslims are idiots number {i}", 1))
        elif i % 40 == 1:
            texts.append((f"the muslims met friends number {i}", 0))
        else:
            texts.append((f"the christians met friends number {i}", 0))
    docs, labels = tables(spark, texts, "toxic")
    groups = [("muslims", "christians")]
    plain = toxicity.fit(docs, labels, groups=groups, swap=0.0)
    fair = toxicity.fit(docs, labels, groups=groups, swap=1.0)
    gap = lambda m: abs(m.word("muslims") - m.word("christians"))
    assert gap(fair) < 0.1 * gap(plain)
    assert fair.score("the muslims met") < toxicity.THRESHOLD < fair.score("the christians are idiots")
    assert plain.score("muslims") > fair.score("muslims")


def test_descend_finds_the_least():
    """The slope of the penalised loss vanishes at the weights found."""
    rows, label = [np.array([0, 1]), np.array([1]), np.array([0, 2]), np.array([2])], np.array([1, 0, 1, 0])
    pairs, ridge, swap = [(3, [0], [2])], 0.5, 0.7
    found = toxicity.descend(label, rows, pairs, 3, ridge, swap, 4000)

    def loss(w):
        total = np.array([w[r].sum() + w[-1] for r in rows])
        return np.log1p(np.exp(-(2 * label - 1) * total)).sum() + ridge / 2 * (w[:-1] ** 2).sum() + swap * 3 * (w[0] - w[2]) ** 2

    for k in range(4):
        step = np.eye(4)[k] * 1e-4
        assert loss(found) <= loss(found + step) + 1e-6 and loss(found) <= loss(found - step) + 1e-6


def test_dual_descent_reaches_the_primal():
    draw = np.random.default_rng(1)
    x, sign = draw.normal(size=(60, 4)), np.where(draw.random(60) < 0.5, 1.0, -1.0)
    x[:, 0] += sign
    at, bound = [np.arange(4)] * 60, 0.5
    weights, bias = quality.dual_descent(sign, at, list(x), 4, bound, 3000)
    loss = lambda w, b: 0.5 * (w @ w + b * b) + bound * np.maximum(0, 1 - sign * (x @ w + b)).sum()
    best = loss(weights, bias)
    for _ in range(300):
        step = draw.normal(size=5) * 0.02
        assert best <= loss(weights + step[:4], bias + step[4]) + 1e-3


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_edges(spark, module, label):
    texts = [("bad words here " + str(i), 1) for i in range(40)] + [("fine text there " + str(i), 0) for i in range(40)]
    texts += [(None, 1), ("", 0), ("bad " * 50_000, 1), ("bad " * 50_000, 1), ("fine text", None)]
    docs, labels = tables(spark, texts, label)
    docs = docs.unionAll(docs.limit(3)).unionAll(docs.selectExpr("cast(null as long)", "text", "score", "label").limit(1))
    labels = labels.unionAll(labels.limit(5)).unionAll(labels.selectExpr("cast(null as long)", label, "text").limit(1))
    got = module.scored(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[80].score == by_id[81].score and not by_id[None].held_out
    assert by_id[0].score > by_id[50].score and by_id[82].score == by_id[83].score
    assert module.scored(docs.limit(0), labels).collect() == []
    assert {r.score for r in module.scored(docs, labels.limit(0)).collect()} == {0.5}
    ones = module.scored(docs, labels.where(f"{label} = 1")).collect()
    assert len({r.score for r in ones}) == 1 and ones[0].score > 0.5


def test_repeated_words_are_seen():
    assert "= =" in quality.ngrams("a b b") and "= = = =" not in quality.ngrams("a b b b")
    assert "= = = =" in quality.ngrams("x y y y y") and "= =" not in quality.ngrams("a b a b")
    model = quality.Model({"a b": (2.0, 1.0)}, 0.0, 1.0, 0.0)
    assert model.score("a b") == pytest.approx(1 / (1 + math.exp(-2 / math.sqrt(5))))


def test_ngrams_go_on_across_the_cut_of_a_long_text(monkeypatch):
    from trialloom.llm import texts

    text = "a b  c\n d d d d e " + " ".join(f"w{i}" for i in range(40))
    whole = quality.ngrams(text)
    for size in (1, 3, 5, 8, 13):
        monkeypatch.setattr(texts, "PIECE", size)
        assert quality.ngrams(text) == whole


def test_sample_is_bounded_in_rows(spark):
    from trialloom.llm import labelled

    docs = spark.range(2000).selectExpr("id % 4 as doc_id", "concat('text ', id) as text")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, toxic int")
    rows = labelled.sample(docs, labels, "toxic", 5, 9, rows=10).collect()
    assert len(rows) == 4 and len({r.text for r in rows}) == 4
