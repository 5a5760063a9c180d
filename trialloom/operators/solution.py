"""Scores and rule audits of routing decisions already made, for many instances at once.

Tables: assign (s, i, m, ...), arc (s, k, i, j), visit (s, i, k), start (s, k, i, start),
team (s, k, used, duration, fixed), node (s, i, early, late, weight, ...), service
(m, price, cost, time), usage (m, p, units), inventory (p, cap), pair (s, i, j, transfer,
cost). ``s`` is the instance, ``i`` and ``j`` its places, ``k`` its teams.

Scores are sums per instance after lookups by key, so they combine before the shuffle.
Audits that compare two tables add signed contributions and group once, in place of full
outer joins. Every arc lookup joins on (instance, place), which spreads a large instance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.functions.joining import dealt

# Weights of the four scores, the gap that counts as crossed and its floor.
SCORE_WEIGHTS = (1, -1, 1, 0)
CROSSING_GAP = 0.15
GAP_FLOOR = 1e-9


def score_value(assign: DataFrame, service: DataFrame) -> DataFrame:
    """Utility per price, weighted by customer."""
    return (
        assign.join(service.select("m", "price"), "m")
        .groupBy("s")
        .agg(F.sum(F.col("utility") / F.col("price") * F.col("weight")).alias("value_score"))
    )


def score_start(node: DataFrame, start: DataFrame) -> DataFrame:
    """Weighted start times of customers; depots have no weight and drop out of the join."""
    return (
        start.join(node.select("s", "i", "weight"), ["s", "i"])
        .groupBy("s")
        .agg(F.sum(F.col("start") * F.col("weight")).alias("start_score"))
    )


def score_profit(assign: DataFrame, service: DataFrame, team: DataFrame, arc: DataFrame, pair: DataFrame) -> DataFrame:
    """Margins less fixed team costs and arc costs, as one union of signed amounts.

    An arc without a pair row and a service without a price have no amount to add;
    ``audit_sequence`` reports such arcs.
    """
    margins = assign.join(service.select("m", (F.col("price") - F.col("cost")).alias("amount")), "m")
    fixed = team.select("s", (-F.col("used") * F.col("fixed")).alias("amount"))
    travel = arc.join(pair.select("s", "i", "j", "cost"), ["s", "i", "j"]).select(
        "s", (-F.col("cost")).alias("amount")
    )
    parts = [margins.select("s", "amount"), fixed, travel]
    return _union(parts).groupBy("s").agg(F.sum("amount").alias("profit_score"))


def score_finish(start: DataFrame, end_depot: int) -> DataFrame:
    return start.where(F.col("i") == end_depot).groupBy("s").agg(F.sum("start").alias("finish_score"))


def score_total(
    value: DataFrame, start: DataFrame, profit: DataFrame, finish: DataFrame, weights=SCORE_WEIGHTS
) -> DataFrame:
    """All four scores and their weighted total per instance, missing parts as 0."""
    named = {"value_score": value, "start_score": start, "profit_score": profit, "finish_score": finish}
    parts = [df.select("s", F.lit(n).alias("part"), F.col(n).cast("double").alias("x")) for n, df in named.items()]
    table = _union(parts).groupBy("s").agg(
        *[F.coalesce(F.sum(F.when(F.col("part") == n, F.col("x"))), F.lit(0.0)).alias(n) for n in named]
    )
    total = reduce(lambda a, b: a + b, [F.col(n) * float(w) for n, w in zip(named, weights)])
    return table.withColumn("total_score", total)


def audit_single(assign: DataFrame, start_depot: int, end_depot: int) -> DataFrame:
    """Customers with more than one service, and depots with any."""
    counted = assign.groupBy("s", "i").agg(F.count(F.lit(1)).alias("services"))
    depot = F.col("i").isin(start_depot, end_depot)
    return counted.where((F.col("services") > 1) | depot)


def audit_inventory(assign: DataFrame, usage: DataFrame, inventory: DataFrame) -> DataFrame:
    """Products of an instance used beyond their stock.

    Services are counted per instance before they meet the usage table, to which each product's
    stock is attached, so the sums don't move again to the few products.
    """
    rows = assign.count()
    chosen = dealt(assign.select("s", "m"), rows, "s", "m").groupBy("s", "m").agg(F.count(F.lit(1)).alias("n"))
    stocked = usage.join(inventory, "p")
    units, services = usage.agg(F.count(F.lit(1)), F.count_distinct("m")).first()
    used = (
        dealt(chosen.join(stocked, "m"), rows * -(-units // max(1, services)), "s", "p", "cap")
        .groupBy("s", "p", "cap")
        .agg(F.sum(F.col("n") * F.col("units")).alias("used_units"))
    )
    return used.where(F.col("used_units") > F.col("cap")).select("p", "s", "used_units", "cap")


def audit_duration(team: DataFrame, start: DataFrame, end_depot: int) -> DataFrame:
    """Teams back later than their working time, or at all when unused."""
    back = start.where(F.col("i") == end_depot).select("s", "k", F.col("start").alias("back"))
    return (
        team.join(back, ["s", "k"])
        .where(F.col("back") > F.col("duration") * F.col("used"))
        .select("s", "k", "back", "duration")
    )


def audit_flow(arc: DataFrame, team: DataFrame, start_depot: int, end_depot: int) -> DataFrame:
    """Places where the arcs out less the arcs in are not what the team's use demands."""
    leaving = arc.select("s", "k", "i", F.lit(1).alias("net"))
    arriving = arc.select("s", "k", F.col("j").alias("i"), F.lit(-1).alias("net"))
    wanted = team.select(
        "s",
        "k",
        F.explode(
            F.array(
                F.struct(F.lit(start_depot).alias("i"), (-F.col("used")).alias("net")),
                F.struct(F.lit(end_depot).alias("i"), F.col("used").alias("net")),
            )
        ).alias("w"),
    ).select("s", "k", "w.i", "w.net")
    rows = 2 * (arc.count() + team.count())
    return (
        dealt(_union([leaving, arriving, wanted]), rows, "s", "k", "i")
        .groupBy("s", "k", "i")
        .agg(F.sum("net").alias("imbalance"))
        .where(F.col("imbalance") != 0)
    )


def _service_time(assign: DataFrame, service: DataFrame) -> DataFrame:
    return assign.join(service.select("m", "time"), "m").groupBy("s", "i").agg(F.sum("time").alias("time"))


def _at(df: DataFrame, end: str, **columns: str) -> DataFrame:
    """Columns of a place table renamed for one end (i or j) of an arc."""
    return df.select("s", F.col("i").alias(end), *[F.col(c).alias(n) for n, c in columns.items()])


def audit_sequence(
    arc: DataFrame, start: DataFrame, assign: DataFrame, service: DataFrame, pair: DataFrame
) -> DataFrame:
    """Arcs whose end starts before the team can be there, or for which that can't be told.

    An arc with no start at either end, or with no travel time, has nulls where they are missing.
    """
    leave = start.select("s", "k", "i", F.col("start").alias("leave"))
    reach = start.select("s", "k", F.col("i").alias("j"), F.col("start").alias("begin"))
    timed = (
        arc.join(leave, ["s", "k", "i"], "left")
        .join(reach, ["s", "k", "j"], "left")
        .join(pair.select("s", "i", "j", "transfer"), ["s", "i", "j"], "left")
        .join(_service_time(assign, service), ["s", "i"], "left")
    )
    ready = F.col("leave") + F.col("transfer") + F.coalesce("time", F.lit(0))
    late = F.coalesce(F.col("ready") > F.col("begin"), F.lit(True))
    return timed.withColumn("ready", ready).where(late).select(
        "s", "k", "i", "j", "ready", "begin"
    )


def audit_window(visit: DataFrame, node: DataFrame, start: DataFrame) -> DataFrame:
    """Visited customers that start outside their time window, or have no start at all."""
    return (
        visit.join(start, ["s", "k", "i"], "left")
        .join(node.select("s", "i", "early", "late"), ["s", "i"])
        .where(F.coalesce(~F.col("start").between(F.col("early"), F.col("late")), F.lit(True)))
        .select("s", "k", "i", "start", "early", "late")
    )


def audit_linking(
    assign: DataFrame,
    visit: DataFrame,
    arc: DataFrame,
    team: DataFrame,
    start: DataFrame,
    start_depot: int,
    end_depot: int,
) -> DataFrame:
    """Violations of the rules that tie the tables together, counted per instance and rule."""
    customer = ~F.col("i").isin(start_depot, end_depot)

    def unbalanced(rule: str, keys: list[str], *parts: DataFrame) -> DataFrame:
        sums = _union(list(parts)).groupBy(*keys).agg(F.sum("n").alias("n")).where(F.col("n") != 0)
        return sums.select("s", F.lit(rule).alias("rule"))

    one, minus = F.lit(1).alias("n"), F.lit(-1).alias("n")
    visits_vs_services = unbalanced(
        "visits_equal_services", ["s", "i"], visit.select("s", "i", one), assign.select("s", "i", minus)
    )
    visits_vs_arcs = unbalanced(
        "visits_equal_arrivals",
        ["s", "i", "k"],
        visit.where(customer).select("s", "i", "k", one),
        arc.select("s", F.col("j").alias("i"), "k", minus).where(customer),
    )
    depots = F.array(F.lit(start_depot), F.lit(end_depot))
    loops = arc.where(
        (F.col("i") == F.col("j"))
        | (F.array_contains(depots, F.col("i")) & F.array_contains(depots, F.col("j")))
    ).select("s", F.lit("no_loop_or_depot_arc").alias("rule"))
    busy = visit.where(customer).groupBy("s", "k").agg(F.lit(-1).alias("n"))
    used_vs_visits = unbalanced(
        "used_when_visiting", ["s", "k"], team.select("s", "k", F.col("used").alias("n")), busy
    )
    depot_start = (
        start.where(F.col("i") == start_depot)
        .groupBy("s")
        .agg(F.sum("start").alias("n"))
        .where(F.col("n") != 0)
        .select("s", F.lit("start_depot_at_zero").alias("rule"))
    )
    return (
        _union([visits_vs_services, visits_vs_arcs, loops, used_vs_visits, depot_start])
        .groupBy("s", "rule")
        .agg(F.count(F.lit(1)).alias("violations"))
    )


def served_summary(node: DataFrame, visit: DataFrame, team: DataFrame) -> DataFrame:
    """Served and unserved customers, used and idle teams per instance."""
    places = _union(
        [
            node.select("s", F.lit("customer").alias("what"), F.col("i").alias("x")),
            visit.select("s", F.lit("served").alias("what"), F.col("i").alias("x")),
        ]
    )
    facts = _union(
        [
            dealt(places, node.count() + visit.count(), "s", "what", "x").distinct(),
            team.select("s", F.when(F.col("used") > 0, "used").otherwise("idle").alias("what"), F.col("k").alias("x")),
        ]
    )
    counts = facts.groupBy("s").agg(
        *[F.count_if(F.col("what") == w).alias(w) for w in ("customer", "served", "used", "idle")]
    )
    return counts.select(
        "s",
        F.col("served").alias("served_customers"),
        (F.col("customer") - F.col("served")).alias("unserved_customers"),
        F.col("used").alias("used_teams"),
        F.col("idle").alias("idle_teams"),
    )


def audit_reverse(arc: DataFrame, start_depot: int, end_depot: int) -> DataFrame:
    """Customer pairs a team drives in both directions, or the same way twice.

    Both directions fall on the same unordered pair, so one group-by finds them.
    """
    depots = (start_depot, end_depot)
    customers = arc.where(~F.col("i").isin(*depots) & ~F.col("j").isin(*depots))
    return (
        customers.groupBy("s", "k", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
        .agg(F.count(F.lit(1)).alias("arcs"))
        .where(F.col("arcs") > 1)
    )


def audit_late_arcs(
    arc: DataFrame,
    start: DataFrame,
    node: DataFrame,
    assign: DataFrame,
    service: DataFrame,
    pair: DataFrame,
) -> DataFrame:
    """Customer arcs that arrive after the latest start, by actual and by earliest departure.

    ``late_by_start`` uses the actual start and service, ``late_by_window`` the earliest
    start with the shortest of all services. An arc for which that can't be told, as a start
    or a travel time is missing, counts as late.
    """
    shortest = service.agg(F.min("time")).scalar()
    timed = (
        arc.join(start.select("s", "k", "i", "start"), ["s", "k", "i"], "left")
        .join(_at(node, "i", early="early"), ["s", "i"])
        .join(_at(node, "j", late="late"), ["s", "j"])
        .join(pair.select("s", "i", "j", "transfer"), ["s", "i", "j"], "left")
        .join(_service_time(assign, service), ["s", "i"], "left")
    )
    by_start = F.col("start") + F.coalesce("time", F.lit(0)) + F.col("transfer") > F.col("late")
    by_window = F.col("early") + shortest + F.col("transfer") > F.col("late")
    by_start, by_window = F.coalesce(by_start, F.lit(True)), F.coalesce(by_window, F.lit(True))
    return (
        timed.select(
            "s", "k", "i", "j", by_start.cast("int").alias("late_by_start"), by_window.cast("int").alias("late_by_window")
        )
        .where((F.col("late_by_start") == 1) | (F.col("late_by_window") == 1))
    )


def optimality_gap(best: Column, bound: Column) -> Column:
    return F.round(F.abs(bound - best) / F.greatest(F.abs(bound), F.lit(GAP_FLOOR)), 2)


def first_crossing(progress: DataFrame, limit: float = CROSSING_GAP) -> DataFrame:
    """Each run's earliest event with a gap within the limit; runs that never cross drop out."""
    crossed = progress.withColumn("gap", optimality_gap(F.col("best"), F.col("bound"))).where(
        F.col("gap") <= limit
    )
    return crossed.groupBy("run").agg(
        F.min("ts").alias("ts"), F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"),
        F.min_by("gap", F.struct("ts", "event_id")).alias("gap"),
    )


def symmetric_pairs(half: DataFrame, last: Column) -> DataFrame:
    """Full symmetric table from the pairs i < j over places 0 (depot), 1..n, n + 1 (depot).

    The second depot takes over the first one's row, so both lie at distance 0 from each
    other and from themselves. Customers become 0..n-1 and the depots n and n + 1.
    ``last`` is the number n + 1 of the second depot. Each half pair yields its few full
    pairs on its own, so nothing is joined.
    """
    i, j, v = F.col("i"), F.col("j"), F.col("v")

    def label(x: Column) -> Column:
        return F.when(x == 0, last - 1).when(x == last, last).otherwise(x - 1)

    def cell(a: Column, b: Column, value: Column) -> Column:
        return F.struct(label(a).cast("int").alias("i"), label(b).cast("int").alias("j"), value.alias("v"))

    inner = F.array(cell(i, j, v), cell(j, i, v))
    # A pair of the first depot also serves the second one, and gives the customer's diagonal.
    depot = F.array(cell(i, j, v), cell(j, i, v), cell(last, j, v), cell(j, last, v), cell(j, j, F.lit(0)))
    zero = F.lit(0)
    between = F.array(
        cell(zero, zero, zero), cell(zero, last, zero), cell(last, zero, zero), cell(last, last, zero)
    )
    cells = (
        F.when((i == 0) & (j == last), between)
        .when(i == 0, depot)
        .when(j == last, F.array().cast("array<struct<i:int,j:int,v:int>>"))
        .otherwise(inner)
    )
    return half.where(i < j).select("s", F.explode(cells).alias("c")).select("s", "c.i", "c.j", "c.v")


def pair_product(a: DataFrame, b: DataFrame, constant: float) -> DataFrame:
    """Cell by cell product of two pair tables and a constant."""
    return a.join(b.withColumnRenamed("v", "w"), ["s", "i", "j"]).select(
        "s", "i", "j", (F.col("v") * F.col("w") * F.lit(constant)).alias("v")
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
