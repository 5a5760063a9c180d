"""Queries on numbers inside cells, and on pair tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.columns import STAT_ARRAYS
from trialloom.functions import arrays
from trialloom.operators import profile, solution
from trialloom.plans.registry import query, rounded
from trialloom.plans.sql_views import ARRAYS, array_stats, numbers
from trialloom.sources import testbed

# Texts of three tables as cells: prose, pages with markup and dialogue, each in full.
_TEXTS = """SELECT 'documents' AS what, doc_id AS id, text FROM documents
            UNION ALL SELECT 'pages', page_id, html FROM pages
            UNION ALL SELECT 'conversations', conv_id * 1000 + turn, text FROM conversations"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def part(table: str, key: Column, text: str) -> DataFrame:
        return testbed.table(spark, sf_dir, table).select(
            F.lit(table).alias("what"), key.alias("id"), F.col(text).alias("text")
        )

    return (
        part("documents", F.col("doc_id"), "text")
        .unionByName(part("pages", F.col("page_id"), "html"))
        .unionByName(part("conversations", F.col("conv_id") * 1000 + F.col("turn"), "text"))
    )


@query(
    "extract_numbers",
    f"""SELECT what, id, len(x) AS found, list_min(x) AS least, list_max(x) AS most, x[1] AS head, x[-1] AS tail
        FROM (SELECT what, id, {numbers("coalesce(text, '')")} AS x FROM ({_TEXTS}) t) u""",
)
def extract_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    parsed = texts(spark, sf_dir).select("what", "id", arrays.extract_numbers(F.col("text")).alias("x"))
    return parsed.select(
        "what",
        "id",
        F.size(x).cast("long").alias("found"),
        F.array_min(x).alias("least"),
        F.array_max(x).alias("most"),
        F.get(x, F.lit(0)).alias("head"),
        F.try_element_at(x, F.lit(-1)).alias("tail"),
    )


_TEXT_STATS = array_stats(
    f"""SELECT id, what, unnest({numbers("text")}) AS x FROM ({_TEXTS}) t"""
)


def _text_stat(stat: str) -> str:
    shown = f"round(s.{stat}, 8)" if stat in ("skew", "kurtosis") else f"s.{stat}"
    return f"""SELECT t.what, t.id, {shown} AS {stat}
               FROM ({_TEXTS}) t LEFT JOIN ({_TEXT_STATS}) s ON s.what = t.what AND s.id = t.id"""


def _text_stats(spark: SparkSession, sf_dir: str, stat: str) -> DataFrame:
    """One statistic of the numbers in each text: from none and constants to thousands."""
    stats = arrays.with_stats(texts(spark, sf_dir), {"x": "text"})
    chosen = stats.select("what", "id", F.col(f"x_{stat}").alias(stat))
    return rounded(chosen) if stat in ("skew", "kurtosis") else chosen


@query("array_median", _text_stat("median"))
def array_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_stats(spark, sf_dir, "median")


@query("array_mode", _text_stat("mode"))
def array_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_stats(spark, sf_dir, "mode")


@query("array_skew", _text_stat("skew"))
def array_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_stats(spark, sf_dir, "skew")


@query("array_kurtosis", _text_stat("kurtosis"))
def array_kurtosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_stats(spark, sf_dir, "kurtosis")


@query(
    "stat_features",
    "SELECT random_seed, "
    + ", ".join(f"round({a}_{s}, 8) AS {a}_{s}" for a in ARRAYS for s in ("median", "mode", "skew", "kurtosis"))
    + " FROM {wide_stats}",
)
def stat_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = arrays.with_all_stats(testbed.cells(spark, sf_dir))
    return rounded(stats.drop("customer_num", "service_num", "product_num", *[a for a, _ in STAT_ARRAYS]))


_RULES = {
    "service_time": "service_num",
    "service_price": "service_num",
    "service_cost": "service_num",
    "inventory": "product_num",
    "weight": "customer_num",
    "early_start": "customer_num",
    "late_start": "customer_num",
    "Ser_Pro_corr": "service_num * product_num",
    "transfer_matrix": "(customer_num + 2) * (customer_num + 2)",
    "VariableCost": "(customer_num + 2) * (customer_num + 2)",
}


def _wrong(column: str) -> str:
    return f"CASE WHEN len({numbers(column)}) <> {_RULES[column]} THEN 1 ELSE 0 END"


@query(
    "length_mismatch",
    "SELECT random_seed, " + ", ".join(f"{_wrong(c)} AS {c}_mismatch" for c in _RULES) + " FROM {cells}",
)
def length_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = profile.length_mismatch(testbed.cells(spark, sf_dir))
    return flagged.select("random_seed", *[f"{c}_mismatch" for c, _ in profile.LENGTH_RULES])


@query(
    "length_checks",
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS checked_rows, CAST(sum({_wrong(c)}) AS BIGINT) AS mismatch_count,
                   round(avg({_wrong(c)}), 8) AS mismatch_rate FROM {{cells}}"""
        for c in _RULES
    ),
)
def length_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.length_checks(testbed.cells(spark, sf_dir)))


@query(
    "array_moments",
    """SELECT random_seed, round(avg(x), 8) AS mean, round(stddev_pop(x), 8) AS std,
              round(quantile_cont(x, 0.25), 8) AS low4, round(quantile_cont(x, 0.75), 8) AS high4
       FROM (SELECT random_seed, CAST(unnest(v) AS DOUBLE) AS x FROM {ints}) t GROUP BY 1""",
)
def array_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = testbed.vectors(spark, sf_dir).select("vec_id", F.sort_array("vals").alias("o"))
    centred = ordered.withColumn("mean", arrays.mean(F.col("o")))
    o = F.col("o")
    return rounded(
        centred.select(
            F.col("vec_id").alias("random_seed"),
            "mean",
            arrays.deviation(o, F.col("mean")).alias("std"),
            arrays.quantile(o, 0.25).alias("low4"),
            arrays.quantile(o, 0.75).alias("high4"),
        )
    )


def _listed(array: Column) -> Column:
    return F.array_join(array.cast("array<bigint>").cast("array<string>"), " ")


@query(
    "vector_diff",
    "SELECT random_seed, array_to_string(list_transform(range(1, 33), lambda i: v[i] - v[32 + i]), ' ') AS diff FROM {ints}",
)
def vector_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = arrays.difference(F.slice("vals", 1, 32), F.slice("vals", 33, 32))
    return testbed.vectors(spark, sf_dir).select(F.col("vec_id").alias("random_seed"), _listed(diff).alias("diff"))


@query("matrix_flatten", "SELECT random_seed, array_to_string(v, ' ') AS flat FROM {ints}")
def matrix_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array(*[F.slice("vals", 8 * r + 1, 8) for r in range(8)])
    matrices = testbed.vectors(spark, sf_dir).select("vec_id", rows.alias("matrix"))
    return matrices.select(
        F.col("vec_id").alias("random_seed"), _listed(arrays.flat(F.col("matrix"))).alias("flat")
    )


@query(
    "progressions",
    """SELECT p_partkey, array_to_string(list_transform(range(0, p_size % 12), lambda i: p_partkey + i * (1 + p_size % 3)), ' ') AS rising,
              array_to_string(list_transform(range(0, p_size % 12), lambda i: p_partkey + (p_size % 12 - i) * (1 + p_size % 3)), ' ') AS falling,
              repeat(array_to_string(list_transform(range(0, p_size % 12), lambda i: p_partkey + i * (1 + p_size % 3)), ' ') || ';', 3) AS matrix
       FROM part""",
)
def progressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, step = F.col("p_partkey"), 1 + F.col("p_size") % 3
    n = (F.col("p_size") % 12).cast("int")
    rising = arrays.progression(start, step, n)
    matrix = F.transform(arrays.repeated_rows(rising, F.lit(3)), lambda row: F.concat(_listed(row), F.lit(";")))
    return testbed.table(spark, sf_dir, "part").select(
        "p_partkey",
        _listed(rising).alias("rising"),
        _listed(arrays.falling_progression(start, step, n)).alias("falling"),
        F.array_join(matrix, "").alias("matrix"),
    )


_CELLS = """SELECT vec_id AS s, CAST((p - 1) // 8 AS INTEGER) AS i, CAST((p - 1) % 8 AS INTEGER) AS j,
                   CAST(floor(abs(CAST(embedding[p] AS DOUBLE)) * 1000) AS INTEGER) AS v
            FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS p FROM embeddings) t"""


@query(
    "symmetric_pairs",
    f"""WITH half AS (SELECT * FROM ({_CELLS}) c WHERE i < j),
             full_pairs AS (SELECT s, i, j, v FROM half UNION ALL SELECT s, j, i, v FROM half
                            UNION ALL SELECT DISTINCT s, i, i, 0 FROM (SELECT s, i FROM half UNION ALL SELECT s, j FROM half) d),
             rows_copied AS (SELECT s, i, j, v FROM full_pairs WHERE i < 7
                             UNION ALL SELECT s, 7, j, v FROM full_pairs WHERE i = 0),
             depots_copied AS (SELECT s, i, j, v FROM rows_copied WHERE j < 7
                               UNION ALL SELECT s, i, 7, v FROM rows_copied WHERE j = 0)
        SELECT s, CASE i WHEN 0 THEN 6 WHEN 7 THEN 7 ELSE i - 1 END AS i,
               CASE j WHEN 0 THEN 6 WHEN 7 THEN 7 ELSE j - 1 END AS j, v FROM depots_copied""",
)
def symmetric_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solution.symmetric_pairs(testbed.matrix_pairs(spark, sf_dir), F.lit(7))


@query(
    "pair_product",
    f"""SELECT a.s, a.i, a.j, round(a.v * b.v * 0.75::DOUBLE, 8) AS v
        FROM ({_CELLS}) a JOIN (SELECT s, j AS i, i AS j, v FROM ({_CELLS}) t) b
          ON a.s = b.s AND a.i = b.i AND a.j = b.j""",
)
def pair_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each matrix times its transpose, cell by cell."""
    cells = testbed.matrix_pairs(spark, sf_dir)
    turned = cells.select("s", F.col("j").alias("i"), F.col("i").alias("j"), "v")
    return rounded(solution.pair_product(cells, turned, 0.75))


@query(
    "conflict_ratio",
    """WITH w AS (SELECT vec_id AS s, list_transform(embedding, lambda e: CAST(floor(abs(CAST(e AS DOUBLE)) * 1000) AS INTEGER)) AS v
                  FROM embeddings)
       SELECT s, round(avg(CASE WHEN v[i] + v[(i - 1) * 8 + j] + list_min(v[17:24]) > v[j] + v[8 + j] THEN 1 ELSE 0 END), 8) AS conflict_ratio
       FROM w, range(1, 7) a(i), range(1, 7) b(j) WHERE i <> j GROUP BY 1""",
)
def conflict_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = arrays.conflict_ratio(
        F.col("early_start"), F.col("late_start"), F.col("transfer_matrix"), F.col("service_time")
    )
    return rounded(testbed.window_instances(spark, sf_dir).select("s", ratio.alias("conflict_ratio")))
