"""Radix selection: the order of the bits, quantiles against numpy, and the plan."""

import math
import struct
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialloom.functions import ordering, selection
from trialloom.functions.selection import select_quantiles, with_order_bits

PROBS = {"low": 0.0, "a": 0.25, "b": 0.5, "c": 0.9, "high": 1.0}


def _bits(x: float) -> int:
    whole = struct.unpack(">q", struct.pack(">d", abs(x)))[0]
    return -whole if x < 0 else whole


def test_bits_are_those_of_the_format(spark):
    rng = np.random.default_rng(11)
    powers = [math.ldexp(1.0, e) for e in range(-1074, 1024)]
    near = [f(p, to) for p in powers for f, to in ((np.nextafter, 0.0), (np.nextafter, math.inf))]
    drawn = rng.integers(0, 2047 << 52, 4000).view("float64").tolist()
    values = [float(v) for v in [0.0, *powers, *near, *drawn, sys.float_info.max, math.inf]]
    values += [-v for v in values]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = with_order_bits(df, "v").collect()
    assert len(got) == len(values)
    assert [r for r in got if r["_bits"] != _bits(r["v"])] == []


def test_nan_sorts_last_and_zeros_are_equal(spark):
    df = spark.createDataFrame([(math.nan,), (math.inf,), (-0.0,), (0.0,)], "v double")
    nan, inf, minus, plus = [r["_bits"] for r in with_order_bits(df, "v").collect()]
    assert nan > inf > plus == minus == 0


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    n = 3000
    # a third of the rows is one value of one group; magnitudes and signs differ
    value = rng.normal(0, 1, n) * 10.0 ** rng.integers(-12, 12, n)
    group = rng.choice(["a", "b", "c", "one"], n, p=[0.5, 0.3, 0.199, 0.001])
    value[: n // 3], group[: n // 3] = 2.5, "a"
    value[n // 3 : n // 2] = rng.integers(-4, 4, n // 2 - n // 3)
    return pd.DataFrame({"g": group, "v": value})


def test_quantiles_match_numpy(spark, frame):
    df = spark.createDataFrame(frame).withColumn("k", F.struct("g"))
    got = select_quantiles(df, "k", "v", PROBS).toPandas()
    want = frame.groupby("g")["v"].quantile(list(PROBS.values())).unstack()
    got.index = [k["g"] for k in got["k"]]
    np.testing.assert_allclose(got.sort_index()[list(PROBS)].to_numpy(), want.to_numpy(), rtol=1e-12)


@pytest.mark.parametrize("kind", ["double", "float", "long", "int", "decimal(12, 2)"])
def test_both_ways_give_the_same(spark, frame, kind, monkeypatch):
    df = spark.createDataFrame(frame).selectExpr("if(g = 'b', null, g) as g", f"cast(v % 1000 as {kind}) as v")
    count = [F.count("v").alias("n")]
    few = ordering.summarise(df, ["g"], count, {"v": PROBS})
    monkeypatch.setattr(selection, "MOST_GROUPS", 2)
    many = ordering.summarise(df, ["g"], count, {"v": PROBS})
    assert few.schema == many.schema
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))


def test_long_values_keep_all_digits(spark):
    """Neighbours beyond 2^53 stay apart."""
    df = spark.range(5).selectExpr("0 as g", "9007199254740993 + id as v")
    bits = [r["_bits"] for r in with_order_bits(df, "v").orderBy("v").collect()]
    assert bits == [9007199254740993 + i for i in range(5)]


def test_groups_without_values_and_empty_tables(spark):
    rows = spark.createDataFrame([("a", None), ("a", None), ("b", 4.0)], "g string, v double")
    got = ordering.summarise(rows, ["g"], [F.count("*").alias("n")], {"v": {"m": 0.5}}).collect()
    assert {(r["g"], r["n"], r["m"]) for r in got} == {("a", 2, None), ("b", 1, 4.0)}
    empty = rows.where("false")
    assert ordering.summarise(empty, ["g"], [F.count("*").alias("n")], {"v": {"m": 0.5}}).count() == 0
    assert select_quantiles(empty, "g", "v", PROBS).count() == 0


@pytest.mark.parametrize("parts", [1, 50, 1 << 22])
def test_every_depth_gives_the_same(spark, frame, monkeypatch, parts):
    """Two passes or three, and bins of one value that are not opened."""
    monkeypatch.setattr(selection, "MOST_PARTS", parts)
    got = select_quantiles(spark.createDataFrame(frame), "g", "v", PROBS).toPandas().set_index("g").sort_index()
    want = frame.groupby("g")["v"].quantile(list(PROBS.values())).unstack().sort_index()
    np.testing.assert_allclose(got[list(PROBS)].to_numpy(), want.to_numpy(), rtol=1e-12)


def test_too_many_groups_are_left_to_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(selection, "MOST_GROUPS", 9)
    rows = spark.range(100).selectExpr("id % 10 as g", "cast(id as double) as v")
    assert select_quantiles(rows, "g", "v", PROBS) is None
    assert select_quantiles(rows.where("g < 9"), "g", "v", PROBS).count() == 9


def test_no_value_is_exchanged(spark, frame, monkeypatch):
    """All that is shuffled are rows of an aggregate, in every pass."""
    kept = []
    real = selection._opened
    monkeypatch.setattr(selection, "_opened", lambda df, group: kept.append(real(df, group)) or kept[-1])
    monkeypatch.setattr(selection, "MOST_PARTS", 1)
    noise = spark.range(4000).selectExpr("id % 2 as g", "1 + rand(1) / 2147483648 as v")
    select_quantiles(noise, "g", "v", PROBS)
    assert len(kept) == len(selection.SHIFTS)
    for bins in kept:
        plan = bins._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "rangepartitioning" not in plan
        lines = plan.splitlines()
        lowest = max(i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line)
        assert "HashAggregate" in lines[lowest + 1] and "partial_count" in lines[lowest + 1]
