"""Arrays, instances, policies, task metrics, signal and models on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialloom.functions import arrays
from trialloom.operators import features, instances, leaderboard, models, policies, signal, solution, tasks

BASE = "(0, 0, 0, 0, 0, 0)"


def log(spark, rows):
    return spark.createDataFrame(
        [(i, b, v, "p", "S1", "I5") for i, b, v in rows],
        "instance_id string, valid_selection string, full_runtime double, "
        "scale_phase string, scale_stage string, size_signature string",
    )


def stats(spark, *cells):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    return [tuple(r)[2:] for r in arrays.with_stats(df, {"x": "c"}).orderBy("i").collect()]


def test_numbers_in_a_cell(spark):
    df = spark.createDataFrame([("[ 1 2. .5 -3e2\n 4.25]",), ("",), (None,)], "c string")
    got = [r["n"] for r in df.select(arrays.extract_numbers(F.col("c")).alias("n")).collect()]
    assert got == [[1.0, 2.0, 0.5, -300.0, 4.25], [], []]


def test_array_statistics_at_the_edges(spark):
    empty, none, one, flat, two, three, tie = stats(spark, "", None, "[5]", "[2 2 2 2]", "[1 3]", "[1 2 9]", "[3 1 3 1 7]")
    assert empty == none == (None, None, None, None)
    assert one == (5.0, 5.0, None, None)
    assert flat == (2.0, 2.0, None, None)
    assert two[:3] == (2.0, 1.0, 0.0) and two[3] == pytest.approx(-2.0)
    assert three[3] == pytest.approx(-1.5)
    assert tie[:2] == (3.0, 1.0)


def test_array_skew_and_kurtosis_match_the_formula(spark):
    x = np.array([1.0, 2.0, 4.0, 8.0, 16.0, 3.0])
    n, d = len(x), x - x.mean()
    m2, m3, m4 = (d**2).mean(), (d**3).mean(), (d**4).mean()
    skew = math.sqrt(n * (n - 1)) / (n - 2) * m3 / m2**1.5
    kurtosis = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / m2**2 - 3) + 6)
    (row,) = stats(spark, str(x))
    assert row[2] == pytest.approx(skew) and row[3] == pytest.approx(kurtosis)


def test_conflict_ratio_by_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for s in range(20):
        n = int(rng.integers(1, 7))
        early = rng.integers(0, 50, n)
        late = early + rng.integers(0, 50, n)
        travel = rng.integers(0, 40, (n + 2, n + 2))
        service = rng.integers(1, 9, 4)
        pairs = [(i, j) for i in range(n) for j in range(n) if i != j]
        hits = sum(early[i] + travel[i, j] + service.min() > late[j] for i, j in pairs)
        want = float(hits / len(pairs)) if pairs else None
        rows.append((s, early.tolist(), late.tolist(), travel.flatten().tolist(), service.tolist(), want))
    df = spark.createDataFrame(rows, "s int, e array<int>, l array<int>, t array<int>, v array<int>, want double")
    ratio = arrays.conflict_ratio(F.col("e"), F.col("l"), F.col("t"), F.col("v"))
    for r in df.select("want", ratio.alias("got")).collect():
        assert r["got"] == (pytest.approx(r["want"]) if r["want"] is not None else None)


@pytest.mark.parametrize("n", [1, 2, 5])
def test_symmetric_pairs_by_matrix(spark, n):
    rng = np.random.default_rng(n)
    size = n + 2
    upper = np.triu(rng.integers(1, 30, (size, size)), 1)
    full = upper + upper.T
    full[-1] = full[0]
    full[:, -1] = full[:, 0]
    order = [*range(1, n + 1), 0, n + 1]
    want = full[np.ix_(order, order)]
    half = [(7, i, j, int(upper[i, j])) for i in range(size) for j in range(size) if i < j]
    df = spark.createDataFrame(half, "s int, i int, j int, v int")
    got = {(r["i"], r["j"]): r["v"] for r in solution.symmetric_pairs(df, F.lit(n + 1)).collect()}
    assert got == {(i, j): int(want[i, j]) for i in range(size) for j in range(size)}


def test_progressions(spark):
    df = spark.createDataFrame([(10, 2, 3), (10, 2, 1), (10, 2, 0)], "a int, d int, n int")
    up = arrays.progression(F.col("a"), F.col("d"), F.col("n")).alias("up")
    down = arrays.falling_progression(F.col("a"), F.col("d"), F.col("n")).alias("down")
    assert [tuple(r) for r in df.select(up, down).collect()] == [([10, 12, 14], [16, 14, 12]), ([10], [12]), ([], [])]


def test_instance_summary_with_ties_and_no_baseline(spark):
    rows = [("a", BASE, 4.0), ("a", "(x)", 2.0), ("a", "(w)", 2.0), ("b", "(x)", 3.0), ("b", "(y)", 3.0)]
    got = {r["instance_id"]: r for r in instances.instance_summary(log(spark, rows)).collect()}
    assert (got["a"]["best_bundle"], got["a"]["worst_bundle"], got["a"]["best_vs_baseline_gain_pct"]) == ("(w)", BASE, 0.5)
    assert got["b"]["best_bundle"] == got["b"]["worst_bundle"] == "(x)"
    assert got["b"]["baseline_runtime"] is None and got["b"]["best_vs_baseline_gain"] is None
    assert got["b"]["runtime_std"] == 0.0


@pytest.mark.parametrize("complete", [True, False])
def test_tied_wins_all_count(spark, complete):
    rows = [("a", BASE, 1.0), ("a", "(1, 0, 0, 0, 0, 0)", 1.0 + 5e-6), ("a", "(1, 1, 0, 0, 0, 0)", 1.1)]
    table = leaderboard.bundle_leaderboard(log(spark, rows), complete=complete).collect()
    assert [r["win_count"] for r in table] == [1, 1, 0]
    assert [r["avg_rank"] for r in table] == [1.0, 2.0, 3.0]
    assert all(r["std_runtime"] is None for r in table)


def test_both_policy_routes_agree(spark):
    rows = [(f"i{i}", b, float((i * 7 + j * 5) % 11 + 1)) for i in range(9) for j, b in enumerate((BASE, "(x)", "(y)")) if (i, j) != (3, 0)]
    df = log(spark, rows)
    joined = (
        policies.policy_cases(df, policies.constant_choice(df), policies.BASELINE_POLICY)
        .unionByName(policies.policy_cases(df, policies.fastest_choice(df), policies.FASTEST_POLICY))
        .unionByName(policies.policy_cases(df, policies.random_choice(df), policies.RANDOM_POLICY))
    )
    single = policies.standard_cases(df).select(*joined.columns)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, single.collect()))
    assert single.where("regret < 0").count() == 0
    assert single.where("policy = 'baseline_bundle'").count() == 8


def scored(spark, rows):
    return spark.createDataFrame(rows, "instance_id string, valid_selection string, true_runtime double, pred_runtime double")


@pytest.mark.parametrize("small", [True, False])
def test_task_cases(spark, small):
    rows = [("a", f"({j})", float(t), float(p)) for j, (t, p) in enumerate([(5, 1), (4, 2), (1, 3), (2, 9)])]
    rows += [("b", "(0)", 1.0, 2.0), ("b", "(1)", 2.0, 2.0), ("c", "(0)", 1.0, 1.0)]
    got = {r["instance_id"]: r for r in tasks.task_cases(scored(spark, rows), small_groups=small).collect()}
    assert set(got) == {"a", "b"}
    a, b = got["a"], got["b"]
    assert (a["true_best_runtime"], a["pred_selected_runtime"], a["regret"]) == (1.0, 5.0, 4.0)
    assert (a["top1_hit"], a["top3_hit"], a["top5_hit"]) == (0, 1, 1)
    # Ranks 4 3 1 2 against 1 2 3 4: squared differences 9 + 1 + 4 + 4.
    assert a["spearman"] == pytest.approx(1 - 6 * 18 / (4 * 15))
    assert b["spearman"] is None and b["top1_hit"] == 1 and b["regret"] == 0.0


def test_no_cases_give_one_summary_row(spark):
    cases = tasks.task_cases(scored(spark, []), small_groups=True)
    (row,) = tasks.task_summary(cases).collect()
    assert row["instance_count"] == 0 and row["median_regret"] is None and row["avg_spearman"] is None


def test_regression_metrics(spark):
    row = tasks.regression_metrics(scored(spark, [("a", "x", 1.0, 2.0), ("a", "y", 3.0, 3.0)]), prefix="test_").first()
    assert row["test_mse"] == 0.5 and row["test_mae"] == 0.5 and row["test_r2"] == pytest.approx(0.5)


def test_candidate_screen_and_constant_signal(spark):
    rows = [(f"i{i}", "b", float(i), i, 1, str(i) if i else "", "word", None if i < 3 else i) for i in range(40)]
    df = spark.createDataFrame(
        rows, "instance_id string, valid_selection string, full_runtime double, up int, same int, text string, word string, gappy int"
    )
    assert signal.candidate_features(df) == ["up", "text"]
    more = df.selectExpr("*", "cast(up as decimal(9, 2)) as money", "up > 20 as flag")
    assert signal.candidate_features(more) == ["up", "text", "money", "flag"]
    got = {r["feature"]: r["pearson_with_runtime"] for r in signal.signal_to_measure(df, ["up", "same"]).collect()}
    assert got["up"] == pytest.approx(1.0) and got["same"] is None


def test_mixed_columns_are_encoded(spark, monkeypatch):
    df = spark.createDataFrame([("b", "1", "x"), ("a", "", None), ("b", "2.5", "x")], "w string, n string, c string")
    for bound in (100, 0):  # by broadcast and by salted keys
        monkeypatch.setattr(signal, "BROADCAST_CODES", bound)
        got = sorted(map(tuple, signal.encode_mixed(df).collect()), key=str)
        assert got == sorted([(1, 1.0, 0), (0, None, -1), (1, 2.5, 0)], key=str)


@pytest.fixture(scope="module")
def training(spark):
    rng = np.random.default_rng(5)
    rows = [
        ("p", f"S{i % 3}", "I5", i, f"({b})", f"p|{i}", float(i % 5 + b + rng.random()), float(i % 5), float(b), None)
        for i in range(30)
        for b in range(4)
    ]
    df = spark.createDataFrame(
        rows,
        "scale_phase string, scale_stage string, size_signature string, random_seed long, valid_selection string, "
        "instance_id string, full_runtime double, size double, bit double, hollow double",
    )
    return features.model_inputs(df)


def test_model_inputs(training):
    inputs, names = training
    assert names == ["scale_phase", "scale_stage", "size_signature", "size", "bit", "hollow"]
    assert {r["meta_scale_stage"] for r in inputs.collect()} == {"S0", "S1", "S2"}
    assert inputs.count() == 120


def test_sweep_notes_failures_and_goes_on(spark, training):
    inputs, names = training

    def broken(width):
        raise ValueError("no such learner")

    registry = {"broken": broken, **{k: v for k, v in models.model_registry(3).items() if k in ("boosted_a", "linear_regression")}}
    sweep = models.model_sweep(inputs, names, registry=registry, complete=True)
    assert [tuple(r) for r in sweep.errors.collect()] == [("broken", "no such learner")]
    rows = {r["model"]: r for r in sweep.summary.collect()}
    assert set(rows) == {"boosted_a", "linear_regression"}
    assert rows["linear_regression"]["group_test_r2"] > 0.8
    case = sweep.cases.where("model = 'linear_regression'")
    assert case.count() == math.ceil(0.33 * 30)
    assert case.where("top1_hit > top3_hit or top3_hit > top5_hit or regret < 0").count() == 0
    important = {r["feature"]: r for r in sweep.importances.collect()}
    assert important["hollow"]["gain_importance"] == 0 and important["hollow"]["split_importance"] == 0
    assert important["bit"]["gain_importance"] > 0 and important["bit"]["gain_rank"] <= 2


def test_kernel_model_is_repeatable(training):
    inputs, names = training
    stages = models.model_registry(3)["kernel"]
    runs = [
        sorted(tuple(r) for r in models.holdout(inputs, names, stages, "group")[2].select("instance_id", "valid_selection", "pred_runtime").collect())
        for _ in range(2)
    ]
    assert runs[0] == runs[1] and all(math.isfinite(r[2]) for r in runs[0])


def test_ablation_counts_present_features(training):
    inputs, names = training
    sweep = models.ablation_sweep(inputs, names, schemes={"none": [], "some": ["bit", "absent"]}, rounds=2, complete=True)
    assert {r["model"]: r["removed_feature_count"] for r in sweep.summary.collect()} == {"none": 0, "some": 1}


def test_hot_instance_is_spread(spark):
    """With a third of all rows in one instance, no task joins a large share of them."""
    from trialloom.functions.joining import salted_join

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        log = spark.range(48_000).selectExpr(
            "if(id % 3 = 0, 'hot', concat('i', id % 500)) as instance_id", "concat('(', id, ')') as valid_selection"
        )
        best = log.groupBy("instance_id").count()
        joined = salted_join(log, best, ["instance_id"], "left", "valid_selection")
        sizes = [r[1] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 48_000 and max(sizes) < 3 * 48_000 / 16
        assert joined.where("count is null").count() == 0
    finally:
        for key in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_audits_report_what_is_missing(spark):
    arc = spark.createDataFrame([(1, 0, 0, 1), (1, 0, 1, 2), (1, 0, 2, 0)], "s long, k int, i int, j int")
    start = spark.createDataFrame([(1, 0, 0, 0), (1, 0, 1, 50)], "s long, k int, i int, start int")
    assign = spark.createDataFrame([(1, 0, 9), (1, 1, 9), (1, 2, 9)], "s long, i int, m long")
    service = spark.createDataFrame([(9, 5)], "m long, time int")
    pair = spark.createDataFrame([(1, 0, 1, 3), (1, 1, 2, 3)], "s long, i int, j int, transfer int")
    node = spark.createDataFrame([(1, i, 0, 100) for i in range(3)], "s long, i int, early int, late int")
    found = {(r.i, r.j): (r.ready, r.begin) for r in solution.audit_sequence(arc, start, assign, service, pair).collect()}
    assert found == {(1, 2): (58, None), (2, 0): (None, 0)}
    visit = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 2, 0)], "s long, i int, k int")
    assert [(r.i, r.start) for r in solution.audit_window(visit, node, start).collect()] == [(2, None)]
    late = {(r.i, r.j): r.late_by_start for r in solution.audit_late_arcs(arc, start, node, assign, service, pair).collect()}
    assert late == {(2, 0): 1}
