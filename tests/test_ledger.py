"""Finished fits are recorded, and only missing ones are made again.

The shared folder may outlive a test run, so every run uses names of its own.
"""

from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from trialloom.operators import models
from trialloom.operators.ledger import Ledger, at_once, fingerprint
from trialloom.plans import model_queries


def test_entries_are_made_once_and_only_whole_ones_count(spark):
    made = []

    def make(broken=False):
        made.append(broken)
        yield_first = {"a": spark.range(3)}
        if broken:
            yield_first["b"] = spark.range(1).select(F.raise_error(F.lit("lost")))
        return yield_first

    here = uuid4().hex
    ledger = Ledger(spark, fingerprint(spark.range(5), here))
    entry = ledger.entry(("x", 1), make)
    assert ledger.entry(("x", 1), make) == entry and made == [False]
    assert ledger.read(entry, "a").count() == 3
    with pytest.raises(Exception, match="lost"):  # table a was written, b was lost: not whole
        ledger.entry(("x", 2), lambda: make(True))
    other = Ledger(spark, fingerprint(spark.range(5).repartition(3), here))  # a driver that starts again
    assert other.whole(other.entry(("x", 2), make)) and made == [False, True, False]
    assert fingerprint(spark.range(6), "here") != fingerprint(spark.range(5), "here") != fingerprint(spark.range(5), "there")


def test_jobs_run_side_by_side_and_errors_are_kept(spark):
    groups = []

    def job(n):
        groups.append(spark.sparkContext.getLocalProperty("spark.jobGroup.id"))
        assert spark.range(10).count() == 10
        if n == 2:
            raise ValueError("no")

    errors = at_once(spark, {("job", n): (job, n) for n in range(4)}, 3)
    assert list(errors) == [("job", 2)] and str(errors[("job", 2)]) == "no"
    assert sorted(groups) == [f"job {n}" for n in range(4)]


def test_sweep_after_a_lost_fit_makes_only_that_one(spark):
    run = uuid4().hex
    rows = spark.createDataFrame(
        [(f"{run} i{i // 4}", str(i % 4), float(i % 7), float(i % 7 + i % 4)) for i in range(60)],
        f"meta_instance_id string, meta_valid_selection string, size double, {models.LABEL} double",
    )
    calls = []
    linear = models.model_registry(2)["linear_regression"]

    def counted(name):
        def stages(width):
            calls.append(name)
            if name == "second" and len([c for c in calls if c == "second"]) == 1:
                raise RuntimeError("driver lost this one")
            return linear(width)

        return stages

    registry = {"first": counted("first"), "second": counted("second")}
    first = models.model_sweep(rows, ["size"], registry=registry, importance_of=())
    assert set(first.failures) == {"second"} and {r.model for r in first.summary.collect()} == {"first"}
    assert sorted(calls) == ["first", "first", "second", "second"]
    calls.clear()
    registry = {"first": counted("first"), "second": lambda width: calls.append("again") or linear(width)}
    again = models.model_sweep(rows, ["size"], registry=registry, importance_of=())
    assert not again.failures and {r.model for r in again.summary.collect()} == {"first", "second"}
    assert calls == ["again"]  # the scheme of "second" that was lost; all others were read


def test_a_failed_fit_fails_the_queries_that_do_not_return_errors(spark, monkeypatch):
    run = uuid4().hex
    rows = spark.createDataFrame(
        [(f"{run} i{i // 4}", str(i % 4), float(i % 7), float(i % 7 + i % 4)) for i in range(60)],
        f"meta_instance_id string, meta_valid_selection string, size double, {models.LABEL} double",
    )
    linear = models.model_registry(2)["linear_regression"]

    def lost(width):
        raise RuntimeError("lost executor")

    fits = models.Fits(rows)
    monkeypatch.setattr(model_queries, "fits_of", lambda *_: (fits, ["size"]))
    registry = {"first": linear, "second": lost}
    monkeypatch.setattr(models, "model_registry", lambda rounds=2: registry)
    for query in (model_queries.model_sweep_summary, model_queries.model_sweep):
        with pytest.raises(RuntimeError, match="second.*lost executor"):
            query(spark, "")
    registry["second"] = linear  # the fits of the first are read from the ledger
    assert {r.model for r in model_queries.model_sweep_summary(spark, "").collect()} == {"first", "second"}

    monkeypatch.setattr(models, "_boosted", lambda *_: lost)
    for query in (model_queries.ablation_sweep_summary, model_queries.ablation_sweep):
        with pytest.raises(RuntimeError, match="lost executor"):
            query(spark, "")
