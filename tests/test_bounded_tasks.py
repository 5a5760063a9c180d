"""Groups are collected in tasks of bounded size, and CSV logs come in bounded files."""

import pytest

from trialloom.functions import joining
from trialloom.operators import solution
from trialloom.sources import sinks, trial_log
from trialloom.session import new_path


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def tables(spark):
    node = spark.createDataFrame([(s, i, i % 2) for s in range(40) for i in range(3)], "s long, i int, k int")
    visit = node.where("not (s % 5 = 0 and i = 1)")
    team = spark.createDataFrame([(s, k, int(k < 2)) for s in range(40) for k in range(3)], "s long, k int, used int")
    arc = spark.createDataFrame([(s, 0, a, b) for s in range(40) for a, b in ((7, 0), (0, 8) if s % 4 else (0, 1))], "s long, k int, i int, j int")
    assign = node.selectExpr("s", "i", "s % 7 as m")
    usage = spark.createDataFrame([(m, p, 1 + m % 2) for m in range(7) for p in (m % 3, 5)], "m long, p int, units int")
    stock = spark.createDataFrame([(p, 3) for p in (0, 1, 2, 5)], "p int, cap int")
    return {
        "served_summary": lambda: solution.served_summary(node, visit, team),
        "audit_flow": lambda: solution.audit_flow(arc, team, 7, 8),
        "audit_inventory": lambda: solution.audit_inventory(assign, usage, stock),
    }


@pytest.mark.parametrize("name", ["served_summary", "audit_flow", "audit_inventory"])
def test_many_rows_are_dealt_out_before_they_are_grouped(spark, monkeypatch, name):
    make = tables(spark)[name]
    plain = make()
    assert "RepartitionByExpression" not in plan_of(plain)
    monkeypatch.setattr(joining, "DEALT_ROWS", 1)
    many = make()
    assert "RepartitionByExpression" in plan_of(many)
    assert sorted(plain.collect()) == sorted(many.collect()) and plain.count()


def test_csv_files_hold_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(sinks, "CSV_ROWS", 10)
    path = new_path(spark, "csv")
    rows = spark.createDataFrame([(float(i), f"[[{i} 1]\n [2 3]]") for i in range(95)], "full_runtime double, note string").coalesce(1)
    sinks.write_csv(rows, path)
    back = trial_log.scan_trial_log(spark, path)
    assert len(back.inputFiles()) == 10
    assert sorted((float(r.full_runtime), r.note) for r in back.collect()) == [tuple(r) for r in rows.collect()]
