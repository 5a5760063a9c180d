"""Reading, cleaning, splitting and sinks on small tables."""

import math
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from trialloom.columns import HEADERS, MODEL_DROP, SPLIT_SELECTION_DROP, header_of
from trialloom.functions import bundles as B
from trialloom.functions.numeric import to_number
from trialloom.operators import clean, profile, splits
from trialloom.plans import model_queries
from trialloom.session import new_path, shared_dir
from trialloom.sources import sinks, trial_log

COLUMNS = ["scale_phase", "scale_stage", "size_signature", "random_seed", "valid_selection", "full_runtime"]


def log(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in COLUMNS))


def trial(seed, bundle, runtime):
    return ("p", "S1", "I5", str(seed), f"({bundle})", runtime)


def test_fixed_lists():
    assert len(HEADERS) == 81 and len({k for k, _ in HEADERS}) == 81
    assert len(MODEL_DROP) == 39 and len(SPLIT_SELECTION_DROP) == 26
    assert header_of("early_start_mode") == "时间窗下界众数"
    assert header_of("runtime") == "求解时间"


def test_numbers_are_parsed_leniently(spark):
    texts = ["1", " 2.5 ", "-3e2", ".5", "7.", "", "abc", "3d", "nan", "Infinity", "1_0", None]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    got = [r["n"] for r in df.select(to_number("x").alias("n")).collect()]
    assert got == [1.0, 2.5, -300.0, 0.5, 7.0, None, None, None, None, None, None, None]


def test_cleaning_rules_in_order(spark):
    rows = [
        tuple(COLUMNS),
        trial(1, "a", "1.0"),
        trial(1, "a", "1.0"),
        trial(1, "b", "2.0"),
        trial(2, "a", "0.5"),  # at the minimum, so its instance becomes incomplete
        trial(2, "b", "2.0"),
        trial(3, "a", ""),
        trial(3, "b", "3.0"),
        trial("x", "b", "3.0"),
    ]
    kept = clean.clean_log(log(spark, rows), expected_bundles=2)
    assert sorted((r["instance_id"], r["valid_selection"]) for r in kept.collect()) == [
        ("p|S1|I5|1", "(a)"),
        ("p|S1|I5|1", "(b)"),
    ]
    assert clean.clean_log(log(spark, rows), require_complete=False).count() == 4


def test_quality_counts(spark):
    rows = [trial(1, "a", "1"), trial(1, "a", "1"), trial(2, "a", "")]
    df = clean.with_instance_id(log(spark, rows))
    row = profile.data_quality(df, expected=2).first()
    assert (row["row_count"], row["instance_count"], row["duplicate_row_count"]) == (3, 2, 1)
    assert (row["missing_target_count"], row["complete_instance_count"]) == (1, 1)
    assert (row["min_bundle_count_per_instance"], row["max_bundle_count_per_instance"]) == (1, 2)


def test_bundle_text_and_bits(spark):
    df = spark.range(64).select(F.col("id").cast("int").alias("n"), B.bundle_text("id").alias("valid_selection"))
    rows = B.with_active_counts(B.with_bits(df)).orderBy("n").collect()
    assert rows[0]["valid_selection"] == B.BASELINE_BUNDLE
    for r in rows:
        bits = [r[c] for c in B.BIT_COLUMNS]
        assert int("".join(map(str, bits)), 2) == r["n"]
        assert r["root_active_count"] == sum(bits[:3]) and r["later_active_count"] == sum(bits[3:])


def test_wrong_number_of_bits_is_an_error(spark):
    bad = spark.createDataFrame([("(0, 1)",)], "valid_selection string")
    with pytest.raises(Exception, match="6 bundle bits"):
        B.with_bits(bad).collect()


def test_model_size_matches_counting(spark):
    for i, m, n, k, bits in ((5, 3, 3, 4, 2), (9, 5, 5, 7, 0), (18, 10, 10, 12, 3)):
        df = spark.createDataFrame([(i, m, n, k, bits)], "i int, m int, n int, k int, b int")
        row = B.with_model_size(df, "i", "m", "n", "k", "b").first()
        places = i + 2
        variables = sum(1 for _ in range(places) for _ in range(m)) + sum(
            1 + sum(2 + places for _ in range(places)) for _ in range(k)
        )
        # Rules: services, depots, stock, durations, flow, sequence, windows, links.
        rules = (i + 1) + n + k + (2 * k + i * k) + places * places * k + 2 * i * k
        rules += places + 2 + i * k + 2 * k + 1
        assert row["base_num_vars"] == variables
        assert row["base_num_constrs"] == rules
        assert row["root_num_constrs"] == rules + bits * i * i * k


def test_missing_target_is_named(spark):
    with pytest.raises(KeyError, match="full_runtime"):
        trial_log.scan_trial_log(spark, "nowhere.csv", ["a", "b"])


@pytest.mark.parametrize("line_breaks", [True, False])
def test_scan_keeps_blanks_and_line_breaks(spark, line_breaks):
    cell = 'say "x", [1\n 2]' if line_breaks else 'say "x", [1 2]'
    rows = log(spark, [("p", "", cell, "1", "(a)", None), tuple(COLUMNS)])
    path = new_path(spark, "scan")
    sinks.write_csv(rows, path)
    back = trial_log.scan_trial_log(spark, path, COLUMNS, line_breaks=line_breaks)
    assert set(map(tuple, back.collect())) == {("p", "", cell, "1", "(a)", ""), tuple(COLUMNS)}


def test_headers_round_trip(spark):
    df = spark.createDataFrame([("1", "x", "y")], "id string, customer_num string, other string")
    printed = trial_log.to_headers(df)
    assert printed.columns == ["序号", "客户数"]
    assert trial_log.from_headers(printed).columns == ["id", "customer_num"]
    wide = df.selectExpr("*", "'p' as profit_median", "1 as bundle_bit_3", "'a' as instance_id")
    printed = trial_log.to_headers(wide, rest=True)
    assert printed.columns == ["序号", "客户数", "other", "利润中位数", "Feature3", "instance_id"]
    assert trial_log.from_headers(printed).columns == ["id", "customer_num", "other", "profit_median", "bundle_bit_3", "instance_id"]


def test_columns_come_from_the_file(spark):
    path = new_path(spark, "scan")
    sinks.write_csv(trial_log.to_headers(log(spark, [("p", "s", "g", "1", "(a)", "2.5")])), path)
    back = trial_log.from_headers(trial_log.scan_trial_log(spark, path))
    assert back.select(*COLUMNS).collect() == [("p", "s", "g", "1", "(a)", "2.5")]
    path = new_path(spark, "scan")
    sinks.write_csv(spark.createDataFrame([("1", "2")], "a string, b string"), path)
    with pytest.raises(KeyError, match="full_runtime.*'a', 'b'"):
        trial_log.scan_trial_log(spark, path)


def test_overwrite_replaces_one_date(spark):
    path = new_path(spark, "runs")
    sinks.overwrite_run(spark.range(3), path, "2026-01-01")
    sinks.overwrite_run(spark.range(5), path, "2026-01-02")
    sinks.overwrite_run(spark.range(2), path, "2026-01-02")
    counts = {str(r["run_date"]): r["count"] for r in spark.read.parquet(path).groupBy("run_date").count().collect()}
    assert counts == {"2026-01-01": 3, "2026-01-02": 2}


@pytest.mark.parametrize("n", [1, 2, 3, 10, 101])
def test_holdout_sizes_are_exact(spark, n):
    df = spark.range(n).select(F.col("id").cast("string").alias("instance_id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("valid_selection"))
    split = splits.group_holdout(df)
    sides = {r["split"]: r["n"] for r in split.groupBy("split").agg(F.count_distinct("instance_id").alias("n")).collect()}
    assert sides.get("test", 0) == math.ceil(0.33 * n)
    assert split.groupBy("instance_id").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    rows = splits.row_holdout(df)
    assert rows.where("split = 'test'").count() == math.ceil(0.33 * 2 * n)
    assert rows.exceptAll(splits.row_holdout(df)).count() == 0


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (40.0,), (39.99,), (1.0,), (None,)], "x double")
    bins = {r["bin"]: r["n"] for r in profile.histogram(df, "x").collect()}
    assert len(bins) == 40 and bins[1] == 1 and bins[2] == 1 and bins[40] == 2 and sum(bins.values()) == 4
    flat = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert {r["bin"]: r["n"] for r in profile.histogram(flat, "x").where("n > 0").collect()} == {21: 2}


def test_instance_keys_stay_apart(spark):
    """Seeds are kept digit for digit, and a missing part is visible."""
    rows = [("p", "s", "g", seed, "(0)", "1") for seed in ("1.5", "1", "1.0", " 7 ", "9007199254740993", "x1")]
    rows += [("p", None, "g", "1", "(0)", "1"), ("p", "g", None, "1", "(0)", "1")]
    keys = [r["instance_id"] for r in clean.with_instance_id(log(spark, rows)).collect()]
    assert keys == [
        "p|s|g|1.5", "p|s|g|1", "p|s|g|1", "p|s|g|7", "p|s|g|9007199254740993", "p|s|g|x1", "p|?|g|1", "p|g|?|1",
    ]


def test_staged_tables_can_be_dropped(spark):
    from trialloom.session import staged, written_tables

    kept = staged(spark.range(3), "kept")
    with written_tables(spark):
        gone = staged(spark.range(4), "gone")
        assert gone.count() == 4
        path = gone.inputFiles()[0]
    assert kept.count() == 3 and not os.path.exists(path.removeprefix("file://").removeprefix("file:"))


def test_augmented_sink_as_csv(spark):
    """Arrays are printed as JSON text, everything else as it is."""
    path = new_path(spark, "csv")
    sinks.write_dataset(spark.createDataFrame([("a", [1.5, 2.0], 3)], "k string, v array<double>, n int"), path, as_csv=True)
    (row,) = spark.read.option("header", True).csv(path).collect()
    assert (row["k"], row["v"], row["n"]) == ("a", "[1.5,2.0]", "3")


def test_csv_logs_of_a_query_are_packed_and_the_first_one_goes(spark, tmp_path):
    at = str(tmp_path)
    spark.range(128).selectExpr(
        "id as l_orderkey", "id % 64 as l_partkey", "id div 64 + 1 as l_suppkey", "1000.0 + 7 * id as l_extendedprice"
    ).write.parquet(f"{at}/lineitem.parquet")
    spark.range(1, 3).selectExpr("id as s_suppkey", "cast(id as int) as s_nationkey").write.parquet(f"{at}/supplier.parquet")
    numbers = "transform(sequence(1, 64), p -> cast((p * 37 + id * 11) % 101 / 100.0 as float)) as embedding"
    spark.range(1, 3).selectExpr("id as vec_id", numbers).write.parquet(f"{at}/embeddings.parquet")
    shared = Path(shared_dir(spark))
    before = {p.name for p in shared.iterdir()}
    rows = model_queries.csv_to_inputs(spark, at).collect()
    assert len(rows) == 128 and len({r.instance_id for r in rows}) == 2 and all(r.service_time_median is not None for r in rows)
    made = {p.name.partition("-")[0]: p for p in shared.iterdir() if p.name not in before}
    assert "printed" not in made and "log" in made
    files = list(made["derived"].glob("part-*"))
    assert files and all(f.name.endswith(".csv.gz") for f in files)
