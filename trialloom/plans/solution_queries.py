"""Queries that score and audit routing decisions."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.operators import solution
from trialloom.plans.registry import query, rounded
from trialloom.session import staged
from trialloom.sources import testbed
from trialloom.sources.testbed import END_DEPOT, START_DEPOT


class Decisions:
    """The decision tables of one scale, each made on first use.

    Nodes, arcs and starts are written once, as stored decisions would be; a real audit
    reads its tables from storage.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def nodes(self) -> DataFrame:
        return staged(testbed.nodes(self.spark, self.sf_dir), "nodes")

    @cached_property
    def services(self) -> DataFrame:
        return testbed.services(self.spark, self.sf_dir)

    @cached_property
    def usage(self) -> DataFrame:
        return testbed.usage(self.spark, self.sf_dir)

    @cached_property
    def inventory(self) -> DataFrame:
        return testbed.inventory(self.spark, self.sf_dir)

    @cached_property
    def arcs(self) -> DataFrame:
        return staged(testbed.arcs(self.nodes), "arcs")

    @cached_property
    def starts(self) -> DataFrame:
        return staged(testbed.starts(self.nodes, self.services), "starts")

    @cached_property
    def assignments(self) -> DataFrame:
        return testbed.assignments(self.nodes)

    @cached_property
    def visits(self) -> DataFrame:
        return testbed.visits(self.nodes)

    @cached_property
    def teams(self) -> DataFrame:
        return testbed.teams(self.nodes)

    @cached_property
    def arc_pairs(self) -> DataFrame:
        return testbed.arc_pairs(self.arcs)


@query("score_value", "SELECT s, round(x, 6) AS value_score FROM {value_part}")
def score_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Decisions(spark, sf_dir)
    return rounded(solution.score_value(d.assignments, d.services), 6)


@query("score_start", "SELECT s, CAST(x AS BIGINT) AS start_score FROM {start_part}")
def score_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Decisions(spark, sf_dir)
    return solution.score_start(d.nodes, d.starts)


@query("score_profit", "SELECT s, round(x, 6) AS profit_score FROM {profit_part}")
def score_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Decisions(spark, sf_dir)
    return rounded(solution.score_profit(d.assignments, d.services, d.teams, d.arcs, d.arc_pairs), 6)


@query("score_finish", "SELECT s, CAST(x AS BIGINT) AS finish_score FROM {finish_part}")
def score_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solution.score_finish(Decisions(spark, sf_dir).starts, END_DEPOT)


@query(
    "score_total",
    """SELECT s, round(v.x, 6) AS value_score, CAST(coalesce(t.x, 0) AS DOUBLE) AS start_score,
              round(p.x, 6) AS profit_score, CAST(f.x AS DOUBLE) AS finish_score,
              round(v.x - coalesce(t.x, 0) + p.x, 6) AS total_score
       FROM {value_part} v LEFT JOIN {start_part} t USING (s) JOIN {profit_part} p USING (s) JOIN {finish_part} f USING (s)""",
)
def score_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Decisions(spark, sf_dir)
    return rounded(
        solution.score_total(
            solution.score_value(d.assignments, d.services),
            solution.score_start(d.nodes, d.starts),
            solution.score_profit(d.assignments, d.services, d.teams, d.arcs, d.arc_pairs),
            solution.score_finish(d.starts, END_DEPOT),
        ),
        6,
    )


@query(
    "audit_single",
    "SELECT s, i, count(*) AS services FROM {assign} GROUP BY 1, 2 HAVING count(*) > 1 OR i >= 7",
)
def audit_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solution.audit_single(Decisions(spark, sf_dir).assignments, START_DEPOT, END_DEPOT)


@query(
    "audit_inventory",
    """SELECT s, p, CAST(sum(units) AS BIGINT) AS used_units, cap
       FROM {assign} JOIN {units_used} USING (m) JOIN {stock} USING (p)
       GROUP BY s, p, cap HAVING sum(units) > cap""",
)
def audit_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Decisions(spark, sf_dir)
    return solution.audit_inventory(d.assignments, d.usage, d.inventory)


@query(
    "audit_duration",
    """SELECT t.s, t.k, b.start AS back, duration FROM {team} t JOIN {begun} b ON b.s = t.s AND b.k = t.k AND b.i = 8
       WHERE b.start > duration * used""",
)
def audit_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Decisions(spark, sf_dir)
    return solution.audit_duration(d.teams, d.starts, END_DEPOT)


@query(
    "audit_flow",
    """SELECT s, k, i, CAST(sum(net) AS BIGINT) AS imbalance
       FROM (SELECT s, k, i, 1 AS net FROM {arc} UNION ALL SELECT s, k, j, -1 FROM {arc}
             UNION ALL SELECT s, k, 7, -used FROM {team} UNION ALL SELECT s, k, 8, used FROM {team}) t
       GROUP BY 1, 2, 3 HAVING sum(net) <> 0""",
)
def audit_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Decisions(spark, sf_dir)
    return solution.audit_flow(d.arcs, d.teams, START_DEPOT, END_DEPOT)


@query(
    "audit_sequence",
    """SELECT s, k, i, j, CAST(leave + transfer + time AS BIGINT) AS ready, begin FROM {timed}
       WHERE coalesce(leave + transfer + time > begin, true)""",
)
def audit_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Decisions(spark, sf_dir)
    return solution.audit_sequence(d.arcs, d.starts, d.assignments, d.services, d.arc_pairs)


@query(
    "audit_window",
    """SELECT v.s, v.k, v.i, b.start, early, late
       FROM {visit} v JOIN {node} n ON n.s = v.s AND n.i = v.i
       LEFT JOIN {begun} b ON b.s = v.s AND b.k = v.k AND b.i = v.i
       WHERE b.start IS NULL OR b.start < early OR b.start > late""",
)
def audit_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Decisions(spark, sf_dir)
    return solution.audit_window(d.visits, d.nodes, d.starts)


@query(
    "audit_linking",
    """SELECT s, rule, count(*) AS violations FROM (
         SELECT coalesce(v.s, a.s) AS s, 'visits_equal_services' AS rule
         FROM (SELECT s, i, count(*) AS n FROM {visit} GROUP BY 1, 2) v
         FULL JOIN (SELECT s, i, count(*) AS n FROM {assign} GROUP BY 1, 2) a ON a.s = v.s AND a.i = v.i
         WHERE coalesce(v.n, 0) <> coalesce(a.n, 0)
         UNION ALL
         SELECT coalesce(v.s, a.s), 'visits_equal_arrivals'
         FROM (SELECT s, i, k, count(*) AS n FROM {visit} GROUP BY 1, 2, 3) v
         FULL JOIN (SELECT s, j AS i, k, count(*) AS n FROM {arc} WHERE j < 7 GROUP BY 1, 2, 3) a
           ON a.s = v.s AND a.i = v.i AND a.k = v.k
         WHERE coalesce(v.n, 0) <> coalesce(a.n, 0)
         UNION ALL SELECT s, 'no_loop_or_depot_arc' FROM {arc} WHERE i = j OR (i >= 7 AND j >= 7)
         UNION ALL SELECT t.s, 'used_when_visiting' FROM {team} t
         LEFT JOIN (SELECT DISTINCT s, k FROM {visit}) n ON n.s = t.s AND n.k = t.k
         WHERE t.used <> CASE WHEN n.s IS NULL THEN 0 ELSE 1 END
         UNION ALL SELECT s, 'start_depot_at_zero' FROM {begun} WHERE i = 7 GROUP BY 1 HAVING sum(start) <> 0) x
       GROUP BY 1, 2""",
)
def audit_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Decisions(spark, sf_dir)
    return solution.audit_linking(d.assignments, d.visits, d.arcs, d.teams, d.starts, START_DEPOT, END_DEPOT)


@query(
    "served_summary",
    """SELECT n.s, coalesce(v.c, 0) AS served_customers, n.c - coalesce(v.c, 0) AS unserved_customers,
              t.u AS used_teams, t.x AS idle_teams
       FROM (SELECT s, count(DISTINCT i) AS c FROM {node} GROUP BY 1) n
       LEFT JOIN (SELECT s, count(DISTINCT i) AS c FROM {visit} GROUP BY 1) v USING (s)
       JOIN (SELECT s, count(*) FILTER (WHERE used = 1) AS u, count(*) FILTER (WHERE used = 0) AS x
             FROM {team} GROUP BY 1) t USING (s)""",
)
def served_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Decisions(spark, sf_dir)
    return solution.served_summary(d.nodes, d.visits, d.teams)


@query(
    "audit_reverse",
    """SELECT s, k, least(i, j) AS a, greatest(i, j) AS b, count(*) AS arcs FROM {arc} WHERE i < 7 AND j < 7
       GROUP BY 1, 2, 3, 4 HAVING count(*) > 1""",
)
def audit_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solution.audit_reverse(Decisions(spark, sf_dir).arcs, START_DEPOT, END_DEPOT)


@query(
    "audit_late_arcs",
    """SELECT s, k, i, j, by_start AS late_by_start, by_window AS late_by_window FROM (
         SELECT t.s, t.k, t.i, t.j, CASE WHEN coalesce(leave + time + transfer > b.late, true) THEN 1 ELSE 0 END AS by_start,
                CASE WHEN a.early + (SELECT min(time) FROM {service}) + transfer > b.late THEN 1 ELSE 0 END AS by_window
         FROM {timed} t JOIN {node} a ON a.s = t.s AND a.i = t.i JOIN {node} b ON b.s = t.s AND b.i = t.j) x
       WHERE by_start = 1 OR by_window = 1""",
)
def audit_late_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Decisions(spark, sf_dir)
    return solution.audit_late_arcs(d.arcs, d.starts, d.nodes, d.assignments, d.services, d.arc_pairs)


@query(
    "first_crossing",
    """SELECT run, event_id, round(gap, 2) AS gap, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM (
         SELECT *, row_number() OVER (PARTITION BY run ORDER BY ts, event_id) AS place FROM (
           SELECT user_id AS run, event_id, ts, round(abs(200.0::DOUBLE - value) / 200.0::DOUBLE, 2) AS gap FROM events) g
         WHERE gap <= 0.15::DOUBLE) t WHERE place = 1""",
)
def first_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    crossed = solution.first_crossing(testbed.progress(spark, sf_dir))
    return crossed.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
