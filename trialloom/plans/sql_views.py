"""SQL text of the test views, for the checks."""

from __future__ import annotations

import re

BUNDLE_TEXT = (
    "'(' || ((bundle_no >> 5) & 1) || ', ' || ((bundle_no >> 4) & 1) || ', ' || ((bundle_no >> 3) & 1)"
    " || ', ' || ((bundle_no >> 2) & 1) || ', ' || ((bundle_no >> 1) & 1) || ', ' || (bundle_no & 1) || ')'"
)

VIEWS: dict[str, str] = {}

VIEWS["sized"] = """
    SELECT s_suppkey AS random_seed, CAST(1 + 16 * s_nationkey AS INTEGER) AS ordinal,
           CAST(5 + s_suppkey % 14 AS INTEGER) AS customer_num, CAST(3 + s_suppkey % 8 AS INTEGER) AS service_num,
           CAST(3 + s_suppkey % 8 AS INTEGER) AS product_num, CAST(3 + s_suppkey % 10 AS INTEGER) AS team_num
    FROM supplier"""

VIEWS["inst"] = """
    SELECT *, CASE WHEN ordinal <= 300 THEN 'baseline_300' ELSE 'stress_100' END AS scale_phase,
           CASE WHEN ordinal <= 300 THEN 'S1' WHEN ordinal <= 325 THEN 'S2' WHEN ordinal <= 350 THEN 'S3'
                WHEN ordinal <= 375 THEN 'S4' ELSE 'S5' END AS scale_stage,
           'I' || customer_num || '_M' || service_num || '_N' || product_num || '_K' || team_num AS size_signature
    FROM {sized}"""

VIEWS["tl"] = f"""
    SELECT scale_phase || '|' || scale_stage || '|' || size_signature || '|' || random_seed AS instance_id,
           scale_phase, scale_stage, size_signature, random_seed, ordinal,
           customer_num, service_num, product_num, team_num, bundle_no,
           {BUNDLE_TEXT} AS valid_selection, full_runtime
    FROM (SELECT l_suppkey AS random_seed, CAST(l_partkey % 64 AS INTEGER) AS bundle_no,
                 min(l_extendedprice) / 1999.0 AS full_runtime
          FROM lineitem GROUP BY 1, 2) c
    JOIN {{inst}} USING (random_seed)"""

VIEWS["kept"] = "SELECT * FROM {tl} WHERE full_runtime > 0.5"

VIEWS["complete_ids"] = "SELECT instance_id FROM {kept} GROUP BY 1 HAVING count(*) = 64"

VIEWS["complete"] = "SELECT * FROM {kept} WHERE instance_id IN (SELECT instance_id FROM {complete_ids})"

VIEWS["standing"] = """
    SELECT *, CASE WHEN abs(full_runtime - best_runtime) <= 1e-8 + 1e-5 * abs(best_runtime) THEN 1 ELSE 0 END
              AS is_instance_best
    FROM (SELECT *, min(full_runtime) OVER (PARTITION BY instance_id) AS best_runtime,
                 rank() OVER (PARTITION BY instance_id ORDER BY full_runtime) AS rank_in_instance
          FROM {complete}) t"""

_RAW_FIELDS = """scale_phase, scale_stage, size_signature, CAST(random_seed AS VARCHAR) AS random_seed,
           valid_selection, {measure} AS full_runtime, CAST(customer_num AS VARCHAR) AS customer_num,
           CAST(service_num AS VARCHAR) AS service_num,
           '[[' || customer_num || ' ' || service_num || ']' || chr(10) || ' [' || team_num || ' ' || bundle_no || ']]' AS note"""
_SECONDS = (
    "CAST(CAST(floor(full_runtime * 1000) AS BIGINT) // 1000 AS VARCHAR) || '.' || "
    "lpad(CAST(CAST(floor(full_runtime * 1000) AS BIGINT) % 1000 AS VARCHAR), 3, '0')"
)
_good = _RAW_FIELDS.replace("{measure}", _SECONDS)
_bad = _RAW_FIELDS.replace("{measure}", "CASE WHEN bundle_no % 2 = 0 THEN '' ELSE 'abc' END")

VIEWS["raw"] = f"""
    SELECT {_good} FROM {{tl}}
    UNION ALL SELECT {_good} FROM {{tl}} WHERE random_seed % 7 = 0
    UNION ALL SELECT {_bad} FROM {{tl}} WHERE random_seed % 11 = 0
    UNION ALL SELECT 'scale_phase', 'scale_stage', 'size_signature', 'random_seed', 'valid_selection',
                     'full_runtime', 'customer_num', 'service_num', 'note'"""

VIEWS["headless"] = "SELECT * FROM {raw} WHERE full_runtime <> 'full_runtime'"
VIEWS["dedup"] = "SELECT DISTINCT * FROM {headless}"
VIEWS["coerced"] = """
    SELECT scale_phase, scale_stage, size_signature, try_cast(random_seed AS DOUBLE) AS random_seed,
           valid_selection, try_cast(full_runtime AS DOUBLE) AS full_runtime, customer_num, service_num, note
    FROM {dedup}"""
VIEWS["usable"] = "SELECT * FROM {coerced} WHERE full_runtime IS NOT NULL AND random_seed IS NOT NULL"
VIEWS["slow"] = """
    SELECT *, scale_phase || '|' || scale_stage || '|' || size_signature || '|' || CAST(random_seed AS BIGINT) AS instance_id
    FROM {usable} WHERE full_runtime > 0.5"""
VIEWS["clean"] = """
    SELECT * FROM {slow}
    WHERE instance_id IN (SELECT instance_id FROM {slow} GROUP BY 1 HAVING count(*) = 64)"""

VIEWS["group_draws"] = """
    SELECT instance_id, row_number() OVER (ORDER BY md5('7|' || instance_id)) AS place, count(*) OVER () AS n
    FROM (SELECT DISTINCT instance_id FROM {complete}) t"""
VIEWS["group_split"] = """
    SELECT c.*, CASE WHEN place <= ceil(0.33::DOUBLE * n) THEN 'test' ELSE 'train' END AS split
    FROM {complete} c JOIN {group_draws} USING (instance_id)"""
VIEWS["row_split"] = """
    SELECT *, CASE WHEN place <= ceil(0.33::DOUBLE * n) THEN 'test' ELSE 'train' END AS split
    FROM (SELECT *, row_number() OVER (ORDER BY md5('7|' || instance_id || '|' || valid_selection)) AS place,
                 count(*) OVER () AS n FROM {complete}) t"""
VIEWS["predicted"] = """
    SELECT g.*, full_runtime AS true_runtime, pred_runtime
    FROM {group_split} g LEFT JOIN (SELECT valid_selection, avg(full_runtime) AS pred_runtime
        FROM {group_split} WHERE split = 'train' GROUP BY 1) m USING (valid_selection)"""
VIEWS["predicted_rows"] = """
    SELECT g.*, full_runtime AS true_runtime, pred_runtime
    FROM {row_split} g LEFT JOIN (SELECT valid_selection, avg(full_runtime) AS pred_runtime
        FROM {row_split} WHERE split = 'train' GROUP BY 1) m USING (valid_selection)"""
VIEWS["held_out"] = "SELECT * FROM {predicted} WHERE split = 'test'"
VIEWS["ranked"] = """
    SELECT *, rank() OVER (PARTITION BY instance_id ORDER BY true_runtime)
                + (count(*) OVER (PARTITION BY instance_id, true_runtime) - 1) / 2.0::DOUBLE AS true_rank,
           rank() OVER (PARTITION BY instance_id ORDER BY pred_runtime)
                + (count(*) OVER (PARTITION BY instance_id, pred_runtime) - 1) / 2.0::DOUBLE AS pred_rank,
           row_number() OVER (PARTITION BY instance_id ORDER BY true_runtime, valid_selection) AS true_place,
           row_number() OVER (PARTITION BY instance_id ORDER BY pred_runtime, valid_selection) AS pred_place
    FROM {held_out}"""
VIEWS["cases"] = """
    SELECT instance_id, count(*) AS bundle_count, min(true_runtime) AS true_best_runtime,
           max(true_runtime) FILTER (WHERE pred_place = 1) AS pred_selected_runtime,
           max(pred_place) FILTER (WHERE true_place = 1) AS best_place,
           CASE WHEN stddev_pop(true_rank) > 0 AND stddev_pop(pred_rank) > 0 THEN corr(true_rank, pred_rank) END AS spearman
    FROM {ranked} GROUP BY 1 HAVING count(*) >= 2"""
VIEWS["instances"] = """
    SELECT instance_id, count(*) AS bundle_count,
           max(valid_selection) FILTER (WHERE up = 1) AS best_bundle,
           max(valid_selection) FILTER (WHERE down = 1) AS worst_bundle,
           min(full_runtime) AS best_runtime, max(full_runtime) AS worst_runtime, avg(full_runtime) AS mean_runtime,
           stddev_pop(full_runtime) AS runtime_std,
           min(full_runtime) FILTER (WHERE valid_selection = '(0, 0, 0, 0, 0, 0)') AS baseline_runtime,
           min(scale_phase) AS scale_phase, min(scale_stage) AS scale_stage, min(size_signature) AS size_signature
    FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY full_runtime, valid_selection) AS up,
                 row_number() OVER (PARTITION BY instance_id ORDER BY full_runtime DESC, valid_selection) AS down
          FROM {kept}) t
    GROUP BY 1"""

_PRINTED = "array_to_string(v[{a}:{b}], ' ')"


def _vector(first: int, last: int) -> str:
    return "'[' || " + _PRINTED.format(a=first, b=last) + " || ']'"


def _matrix(rows: int) -> str:
    lines = (_vector(8 * r + 1, 8 * r + 8) for r in range(rows))
    return "'[' || " + " || chr(10) || ' ' || ".join(lines) + " || ']'"


VIEWS["ints"] = """
    SELECT vec_id AS random_seed,
           list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * 1000) AS INTEGER)) AS v
    FROM embeddings"""
VIEWS["cells"] = f"""
    SELECT random_seed, CASE WHEN random_seed % 10 = 0 THEN 5 ELSE 6 END AS customer_num,
           8 AS service_num, 8 AS product_num,
           {_vector(1, 8)} AS service_time, {_vector(9, 16)} AS service_price, {_vector(17, 24)} AS service_cost,
           '[' || array_to_string(list_transform(range(1, 9), lambda i: v[8 + i] - v[16 + i]), ' ') || ']' AS profit,
           {_vector(25, 32)} AS inventory, {_vector(33, 38)} AS weight, {_vector(39, 44)} AS early_start,
           {_vector(45, 50)} AS late_start, {_matrix(6)} AS utility, {_matrix(8)} AS Ser_Pro_corr,
           {_matrix(8)} AS transfer_matrix, {_matrix(8)} AS VariableCost
    FROM {{ints}}"""
#: Fixed value: the pattern of a printed number.
NUMBER = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"


def numbers(cell: str) -> str:
    return f"CAST(regexp_extract_all({cell}, '{NUMBER}') AS DOUBLE[])"


def array_stats(source: str) -> str:
    """Median, mode, skew and kurtosis per (id, what) from rows (id, what, x)."""
    return f"""
        SELECT id, what, any_value(median) AS median, any_value(mode_x) AS mode,
               CASE WHEN any_value(flat) THEN NULL
                    WHEN any_value(n) > 2 THEN any_value(sqrt(n * (n - 1)) / (n - 2)) * avg(d * d * d) / power(avg(d * d), 1.5)
                    ELSE avg(d * d * d) / power(avg(d * d), 1.5) END AS skew,
               CASE WHEN any_value(flat) THEN NULL
                    WHEN any_value(n) > 3 THEN any_value((n - 1) / ((n - 2.0::DOUBLE) * (n - 3)))
                         * ((any_value(n) + 1) * (avg(d * d * d * d) / (avg(d * d) * avg(d * d)) - 3) + 6)
                    ELSE avg(d * d * d * d) / (avg(d * d) * avg(d * d)) - 3 END AS kurtosis
        FROM (SELECT id, what, n, mode_x, flat, (xs[(n + 1) // 2] + xs[n // 2 + 1]) / 2 AS median,
                     CASE WHEN flat THEN 0 ELSE x - avg(CASE WHEN flat THEN 0 ELSE x END) OVER (PARTITION BY id, what) END AS d
              FROM (SELECT id, what, x, count(*) OVER g AS n, list_sort(list(x) OVER g) AS xs,
                           min(x) OVER g = max(x) OVER g OR max(abs(x)) OVER g = 'inf'::DOUBLE AS flat,
                           first_value(x) OVER (PARTITION BY id, what ORDER BY times DESC, x) AS mode_x
                    FROM (SELECT id, what, x, count(*) OVER (PARTITION BY id, what, x) AS times FROM ({source}) s) t
                    WINDOW g AS (PARTITION BY id, what)) u) w
        GROUP BY id, what"""


ARRAYS = (
    "service_time service_price service_cost profit inventory weight early_start late_start utility "
    "Ser_Pro_corr transfer_matrix VariableCost"
).split()
VIEWS["cell_numbers"] = "\nUNION ALL ".join(
    f"SELECT random_seed AS id, '{a}' AS what, unnest({numbers(a)}) AS x FROM {{cells}}" for a in ARRAYS
)
VIEWS["cell_stats"] = array_stats("SELECT * FROM {cell_numbers}")
VIEWS["wide_stats"] = (
    "SELECT id AS random_seed, "
    + ", ".join(
        f"max({stat}) FILTER (WHERE what = '{a}') AS {a}_{stat}"
        for a in ARRAYS
        for stat in ("median", "mode", "skew", "kurtosis")
    )
    + " FROM {cell_stats} GROUP BY 1"
)

VIEWS["node"] = """
    SELECT s, i, m, CAST(i % 3 AS INTEGER) AS k, early, CAST(early + 5 + supp % 20 AS INTEGER) AS late,
           CAST(early + q % 9 AS INTEGER) AS start, CAST(1 + m % 4 AS INTEGER) AS weight, price / 100.0 AS utility
    FROM (SELECT l_orderkey AS s, l_linenumber - 1 AS i, min(l_partkey) AS m,
                 CAST(date_diff('day', DATE '1992-01-01', CAST(min(l_shipdate) AS DATE)) % 200 AS INTEGER) AS early,
                 CAST(floor(min(l_quantity)) AS INTEGER) AS q, min(l_suppkey) AS supp, min(l_extendedprice) AS price
          FROM lineitem GROUP BY 1, 2) t"""
VIEWS["service"] = """
    SELECT p_partkey AS m, p_retailprice AS price, p_retailprice * 0.75::DOUBLE AS cost,
           CAST(1 + p_size % 5 AS INTEGER) AS time FROM part"""
VIEWS["units_used"] = """
    SELECT p_partkey AS m, p_size % 10 AS p, 1 + p_size % 3 AS units FROM part
    UNION ALL SELECT p_partkey, (p_size + 1) % 10, 1 FROM part"""
VIEWS["stock"] = "SELECT DISTINCT p, 2 + p % 4 AS cap FROM {units_used}"
VIEWS["assign"] = """
    SELECT s, i, m, weight, utility FROM {node}
    UNION ALL SELECT s, i, m, weight, utility FROM {node} WHERE s % 10 = 0 AND i = 0"""
VIEWS["route"] = """
    SELECT s, k, i, lag(i) OVER r AS prev, lead(i) OVER r AS next
    FROM {node} WINDOW r AS (PARTITION BY s, k ORDER BY start, i)"""
VIEWS["arc"] = """
    SELECT s, k, 7 AS i, i AS j FROM {route} WHERE prev IS NULL
    UNION ALL SELECT s, k, i, next FROM {route} WHERE next IS NOT NULL
    UNION ALL SELECT s, k, i, 8 FROM {route} WHERE next IS NULL AND s % 10 <> 0
    UNION ALL SELECT s, k, next, i FROM {route} WHERE next IS NOT NULL AND s % 10 = 0
    UNION ALL SELECT s, k, i, i FROM {route} WHERE prev IS NULL AND s % 23 = 0"""
VIEWS["visit"] = "SELECT s, i, k FROM {node} WHERE NOT (s % 31 = 0 AND i = 1)"
VIEWS["team"] = """
    SELECT t.s, t.k, CASE WHEN n.s IS NULL AND NOT (t.s % 19 = 0 AND t.k = 3) THEN 0 ELSE 1 END AS used, 191 AS duration, 2.5::DOUBLE AS fixed
    FROM (SELECT s, CAST(k AS INTEGER) AS k FROM (SELECT DISTINCT s FROM {node}) x, range(4) r(k)) t
    LEFT JOIN (SELECT DISTINCT s, k FROM {node}) n ON n.s = t.s AND n.k = t.k"""
VIEWS["begun"] = """
    SELECT s, k, i, start FROM {node} WHERE NOT (s % 17 = 0 AND i = 2)
    UNION ALL SELECT DISTINCT s, k, 7, CASE WHEN s % 29 = 0 THEN 3 ELSE 0 END FROM {node}
    UNION ALL SELECT n.s, n.k, 8, 1 + max(n.start + v.time) FROM {node} n JOIN {service} v USING (m) GROUP BY 1, 2"""


def travel(i: str, j: str) -> str:
    return f"CASE WHEN {i} = {j} THEN 0 WHEN {i} >= 7 OR {j} >= 7 THEN 1 ELSE abs({i} - {j}) % 3 + 1 END"


VIEWS["served_time"] = """
    SELECT s, i, sum(time) AS time FROM {assign} JOIN {service} USING (m) GROUP BY 1, 2"""
VIEWS["timed"] = f"""
    SELECT a.s, a.k, a.i, a.j, x.start AS leave, y.start AS begin, {travel('a.i', 'a.j')} AS transfer,
           coalesce(v.time, 0) AS time
    FROM {{arc}} a LEFT JOIN {{begun}} x ON x.s = a.s AND x.k = a.k AND x.i = a.i
    LEFT JOIN {{begun}} y ON y.s = a.s AND y.k = a.k AND y.i = a.j
    LEFT JOIN {{served_time}} v ON v.s = a.s AND v.i = a.i"""
VIEWS["value_part"] = "SELECT s, sum(utility / price * weight) AS x FROM {assign} JOIN {service} USING (m) GROUP BY 1"
VIEWS["start_part"] = (
    "SELECT b.s, sum(b.start * n.weight) AS x FROM {begun} b JOIN {node} n ON n.s = b.s AND n.i = b.i GROUP BY 1"
)
VIEWS["profit_part"] = f"""
    SELECT s, sum(amount) AS x
    FROM (SELECT s, price - cost AS amount FROM {{assign}} JOIN {{service}} USING (m)
          UNION ALL SELECT s, -used * fixed FROM {{team}}
          UNION ALL SELECT s, -1.5::DOUBLE * ({travel('i', 'j')}) FROM {{arc}}) t GROUP BY 1"""
VIEWS["finish_part"] = "SELECT s, sum(start) AS x FROM {begun} WHERE i = 8 GROUP BY 1"

MODEL_SIZE = """
    (customer_num + 2) * service_num + team_num + 2 * (customer_num + 2) * team_num
      + (customer_num + 2) * (customer_num + 2) * team_num AS base_num_vars,
    (customer_num + 2) * (customer_num + 2) * team_num + 4 * customer_num * team_num + 5 * team_num
      + 2 * customer_num + product_num + 6 AS base_num_constrs,
    (customer_num + 2) * (customer_num + 2) * team_num + 4 * customer_num * team_num + 5 * team_num
      + 2 * customer_num + product_num + 6
      + (((bundle_no >> 5) & 1) + ((bundle_no >> 4) & 1) + ((bundle_no >> 3) & 1))
        * customer_num * customer_num * team_num AS root_num_constrs"""
VIEWS["model"] = f"""
    SELECT t.*, (bundle_no >> 5) & 1 AS bundle_bit_1, (bundle_no >> 4) & 1 AS bundle_bit_2,
           (bundle_no >> 3) & 1 AS bundle_bit_3, (bundle_no >> 2) & 1 AS bundle_bit_4,
           (bundle_no >> 1) & 1 AS bundle_bit_5, bundle_no & 1 AS bundle_bit_6,
           ((bundle_no >> 5) & 1) + ((bundle_no >> 4) & 1) + ((bundle_no >> 3) & 1) AS root_active_count,
           ((bundle_no >> 2) & 1) + ((bundle_no >> 1) & 1) + (bundle_no & 1) AS later_active_count,
           {MODEL_SIZE}, w.* EXCLUDE (random_seed),
           CASE WHEN abs(full_runtime - best) <= 1e-8 + 1e-5 * abs(best) THEN 1 ELSE 0 END AS is_best
    FROM (SELECT *, min(full_runtime) OVER (PARTITION BY instance_id) AS best FROM {{complete}}) t
    LEFT JOIN {{wide_stats}} w ON w.random_seed = t.random_seed"""
MODEL_COLUMNS = [
    *"scale_phase scale_stage size_signature random_seed ordinal customer_num service_num product_num".split(),
    *"team_num bundle_no".split(),
    *[f"bundle_bit_{i}" for i in range(1, 7)],
    *"root_active_count later_active_count base_num_vars base_num_constrs root_num_constrs".split(),
    *[f"{a}_{stat}" for a in ARRAYS for stat in ("median", "mode", "skew", "kurtosis")],
]


def per_feature(select: str) -> str:
    """One row per feature that passes the screen; ``x`` stands for the feature's number."""
    return "\nUNION ALL ".join(
        f"""SELECT '{c}' AS feature, {select} FROM (SELECT try_cast({c} AS DOUBLE) AS x, full_runtime, is_best FROM {{model}}) t
            HAVING count(x) >= 0.95 * count(*) AND count(DISTINCT x) > 1"""
        for c in MODEL_COLUMNS
    )


def _needed(text: str, found: list[str]) -> None:
    for name in re.findall(r"\{(\w+)\}", text):
        if name not in found:
            _needed(VIEWS[name], found)
            found.append(name)


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the views it names in braces, each after those it needs."""
    found: list[str] = []
    _needed(sql, found)

    def plain(text: str) -> str:
        return re.sub(r"\{(\w+)\}", r"\1", text)

    if not found:
        return sql
    # each view runs once, however often it is named
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({plain(VIEWS[name])})" for name in found)
    return f"WITH {ctes}\n{plain(sql)}"
