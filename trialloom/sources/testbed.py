"""Trial-log views derived from the TPC-H-like test tables.

All views read whole tables. ``%`` below maps a key onto a bundle, service or product
number; no row is left out.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialloom.columns import HEADERS
from trialloom.functions import bundles as B
from trialloom.functions.joining import dealt

MAX_LINE = 7  # l_linenumber runs from 1 to 7
START_DEPOT = MAX_LINE
END_DEPOT = MAX_LINE + 1
TEAMS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TL: one row per (supplier as instance, part number mod 64 as bundle)."""
    cells = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_suppkey").alias("random_seed"),
            (F.col("l_partkey") % B.EXPECTED_BUNDLES).cast("int").alias("bundle_no"),
        )
        .agg((F.min("l_extendedprice") / 1999.0).alias("full_runtime"))
    )
    instances = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey as random_seed",
        "1 + 16 * s_nationkey as ordinal",
        "cast(5 + s_suppkey % 14 as int) as customer_num",
        "cast(3 + s_suppkey % 8 as int) as service_num",
        "cast(3 + s_suppkey % 8 as int) as product_num",
        "cast(3 + s_suppkey % 10 as int) as team_num",
    )
    described = instances.select(
        "*",
        B.phase_of("ordinal").alias("scale_phase"),
        B.stage_of("ordinal").alias("scale_stage"),
        B.size_signature("customer_num", "service_num", "product_num", "team_num").alias("size_signature"),
    )
    return cells.join(described, "random_seed").select(
        F.expr("concat_ws('|', scale_phase, scale_stage, size_signature, random_seed)").alias("instance_id"),
        "scale_phase",
        "scale_stage",
        "size_signature",
        "random_seed",
        "ordinal",
        "customer_num",
        "service_num",
        "product_num",
        "team_num",
        "bundle_no",
        B.bundle_text("bundle_no").alias("valid_selection"),
        "full_runtime",
    )


RAW_COLUMNS = [
    "scale_phase",
    "scale_stage",
    "size_signature",
    "random_seed",
    "valid_selection",
    "full_runtime",
    "customer_num",
    "service_num",
    "note",
]


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RAW: TL as text, with copies, unusable measures and one repeated header row.

    Every 7th instance appears twice; every 11th gains rows with a blank or wordy
    measure; ``note`` holds a matrix cell with a line break.
    """
    milli = "cast(floor(full_runtime * 1000) as bigint)"
    seconds = f"format_string('%d.%03d', {milli} div 1000, {milli} % 1000)"
    measures = (
        f"explode(concat(array_repeat({seconds}, if(random_seed % 7 = 0, 2, 1)), "
        "array_repeat(if(bundle_no % 2 = 0, '', 'abc'), if(random_seed % 11 = 0, 1, 0))))"
    )
    note = "format_string('[[%d %d]\\n [%d %d]]', customer_num, service_num, team_num, bundle_no)"
    made = {"full_runtime": measures, "note": note}
    rows = trials(spark, sf_dir).selectExpr(
        *[f"{made.get(c, f'cast({c} as string)')} as {c}" for c in RAW_COLUMNS]
    )
    header = spark.range(1).selectExpr(*[f"'{c}' as {c}" for c in RAW_COLUMNS])
    return rows.unionByName(header)


def _vector_cell(start: int, length: int) -> str:
    return f"concat('[', array_join(slice(v, {start}, {length}), ' '), ']')"


def _matrix_cell(rows: int, columns: int) -> str:
    lines = ", ".join(_vector_cell(r * columns + 1, columns) for r in range(rows))
    return f"concat('[', concat_ws('\\n ', {lines}), ']')"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CELLS: printed vectors and matrices, from the 64 numbers of each embedding.

    Each row stands for an instance of six customers and eight services; every tenth
    claims five customers, so that the length rules find mismatches.
    """
    printed = "transform(embedding, e -> cast(cast(floor(cast(e as double) * 1000) as int) as string))"
    gains = "transform(sequence(8, 15), p -> cast(int(v[p]) - int(v[p + 8]) as string))"
    return (
        table(spark, sf_dir, "embeddings")
        .selectExpr("vec_id as random_seed", f"{printed} as v")
        .selectExpr(
            "random_seed",
            "if(random_seed % 10 = 0, 5, 6) as customer_num",
            "8 as service_num",
            "8 as product_num",
            f"{_vector_cell(1, 8)} as service_time",
            f"{_vector_cell(9, 8)} as service_price",
            f"{_vector_cell(17, 8)} as service_cost",
            f"concat('[', array_join({gains}, ' '), ']') as profit",
            f"{_vector_cell(25, 8)} as inventory",
            f"{_vector_cell(33, 6)} as weight",
            f"{_vector_cell(39, 6)} as early_start",
            f"{_vector_cell(45, 6)} as late_start",
            f"{_matrix_cell(6, 8)} as utility",
            f"{_matrix_cell(8, 8)} as Ser_Pro_corr",
            f"{_matrix_cell(8, 8)} as transfer_matrix",
            f"{_matrix_cell(8, 8)} as VariableCost",
        )
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as whole numbers: ``vec_id`` and an array of 64."""
    v = F.transform("embedding", lambda e: F.floor(e.cast("double") * 1000).cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", v.alias("vals"))


# --- decisions -----------------------------------------------------------------------


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SOL node: one served customer per (order as instance, line number)."""
    days = F.datediff(F.min("l_shipdate"), F.lit("1992-01-01").cast("date"))
    lines = table(spark, sf_dir, "lineitem")
    used = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity", "l_suppkey", "l_extendedprice")
    return (
        dealt(used, lines.count(), "l_orderkey", "l_linenumber")
        .groupBy(F.col("l_orderkey").alias("s"), (F.col("l_linenumber") - 1).alias("i"))
        .agg(
            F.min("l_partkey").alias("m"),
            (days % 200).alias("early"),
            F.min("l_quantity").cast("int").alias("q"),
            F.min("l_suppkey").alias("supp"),
            F.min("l_extendedprice").alias("price"),
        )
        .select(
            "s",
            "i",
            "m",
            (F.col("i") % (TEAMS - 1)).alias("k"),
            "early",
            (F.col("early") + 5 + F.col("supp") % 20).cast("int").alias("late"),
            (F.col("early") + F.col("q") % 9).cast("int").alias("start"),
            (1 + F.col("m") % 4).cast("int").alias("weight"),
            (F.col("price") / 100.0).alias("utility"),
        )
    )


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SOL service: each part as a service with price, cost and time."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("m"),
        F.col("p_retailprice").alias("price"),
        (F.col("p_retailprice") * 0.75).alias("cost"),
        (1 + F.col("p_size") % 5).cast("int").alias("time"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SOL usage: units of two products that each service consumes."""
    size = F.col("p_size")
    return (
        table(spark, sf_dir, "part")
        .select(
            F.col("p_partkey").alias("m"),
            F.explode(
                F.array(
                    F.struct((size % 10).alias("p"), (1 + size % 3).alias("units")),
                    F.struct(((size + 1) % 10).alias("p"), F.lit(1).alias("units")),
                )
            ).alias("u"),
        )
        .select("m", "u.p", "u.units")
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SOL inventory: the stock of each product that any service consumes."""
    return usage(spark, sf_dir).select("p").distinct().select("p", (2 + F.col("p") % 4).alias("cap"))


def assignments(node: DataFrame) -> DataFrame:
    """SOL assign: the chosen service per customer; every tenth instance serves node 0 twice."""
    copies = F.when((F.col("s") % 10 == 0) & (F.col("i") == 0), 2).otherwise(1)
    return (
        node.select("s", "i", "m", "weight", "utility", F.explode(F.sequence(F.lit(1), copies)).alias("copy"))
        .drop("copy")
    )


def arcs(node: DataFrame) -> DataFrame:
    """SOL arc: each team's route through its customers by (start, node), depots at the ends.

    A team has at most seven customers, since nodes are unique per line number. Every
    tenth instance loses its arcs into the end depot and gains reversed customer arcs; every
    23rd gains a loop.
    """
    route = Window.partitionBy("s", "k").orderBy("start", "i")
    step = (
        node.select(
            "s",
            "k",
            "i",
            F.lag("i").over(route).alias("prev"),
            F.lead("i").over(route).alias("next"),
        )
        .withColumn("faulty", F.col("s") % 10 == 0)
    )

    def arc(i: Column, j: Column, when: Column) -> Column:
        return F.when(when, F.struct(i.cast("int").alias("i"), j.cast("int").alias("j")))

    i, prev, nxt, faulty = F.col("i"), F.col("prev"), F.col("next"), F.col("faulty")
    moves = F.array(
        arc(F.lit(START_DEPOT), i, prev.isNull()),
        arc(i, nxt, nxt.isNotNull()),
        arc(i, F.lit(END_DEPOT), nxt.isNull() & ~faulty),
        arc(nxt, i, nxt.isNotNull() & faulty),
        arc(i, i, prev.isNull() & (F.col("s") % 23 == 0)),
    )
    return (
        step.select("s", "k", F.explode(F.array_compact(moves)).alias("a"))
        .select("s", "k", "a.i", "a.j")
    )


def starts(node: DataFrame, service: DataFrame) -> DataFrame:
    """SOL start: T(i, k) for the customers and both depots of every used team.

    Every 17th instance lacks the start of node 2; in every 29th, teams leave the depot at 3.
    """
    timed = node.join(service, "m").select("s", "k", "i", "start", "time")
    depots = timed.groupBy("s", "k").agg((1 + F.max(F.col("start") + F.col("time"))).alias("end")).select(
        "s",
        "k",
        F.explode(
            F.array(
                F.struct(F.lit(START_DEPOT).alias("i"), F.when(F.col("s") % 29 == 0, 3).otherwise(0).alias("start")),
                F.struct(F.lit(END_DEPOT).alias("i"), F.col("end").alias("start")),
            )
        ).alias("d"),
    )
    known = node.where(~((F.col("s") % 17 == 0) & (F.col("i") == 2)))
    return known.select("s", "k", "i", "start").unionByName(depots.select("s", "k", "d.i", "d.start"))


def visits(node: DataFrame) -> DataFrame:
    """SOL visit: Y(i, k); every 31st instance leaves node 1 unserved."""
    return node.where(~((F.col("s") % 31 == 0) & (F.col("i") == 1))).select("s", "i", "k")


def teams(node: DataFrame) -> DataFrame:
    """SOL team: teams of each instance; the last one is idle, in every 19th said to be used."""
    busy = dealt(node.select("s", "k"), node.count(), "s").groupBy("s").agg(
        F.array(*[F.max(F.col("k") == k) for k in range(TEAMS)]).alias("busy")
    )
    claimed = F.when((F.col("s") % 19 == 0) & (F.col("k") == TEAMS - 1), 1).otherwise(0)
    return busy.select("s", F.posexplode("busy").alias("k", "own")).select(
        "s",
        "k",
        F.when(F.col("s").isNotNull() & F.col("own"), 1).otherwise(claimed).alias("used"),
        F.lit(191).alias("duration"),
        F.lit(2.5).alias("fixed"),
    )


def transfer(i: Column, j: Column) -> Column:
    """Travel between two places of an order: 1 to and from depots, else by position."""
    depot = (i >= START_DEPOT) | (j >= START_DEPOT)
    return F.when(i == j, 0).when(depot, 1).otherwise(F.abs(i - j) % 3 + 1)


def arc_pairs(arc: DataFrame) -> DataFrame:
    """SOL pair: travel time and cost of the pairs the routes use."""
    return (
        arc.select("s", "i", "j")
        .distinct()
        .withColumn("transfer", transfer(F.col("i"), F.col("j")))
        .withColumn("cost", F.col("transfer") * 1.5)
    )


def matrix_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding read as an 8 x 8 matrix: one row per cell (s, i, j, v)."""
    return (
        table(spark, sf_dir, "embeddings")
        .select(F.col("vec_id").alias("s"), F.posexplode("embedding").alias("pos", "e"))
        .select(
            "s",
            F.floor(F.col("pos") / 8).cast("int").alias("i"),
            (F.col("pos") % 8).alias("j"),
            F.floor(F.abs(F.col("e").cast("double")) * 1000).cast("int").alias("v"),
        )
    )


def window_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six customers per embedding with time windows and an 8 x 8 travel matrix, as arrays."""
    v = F.transform("embedding", lambda e: F.floor(F.abs(e.cast("double")) * 1000).cast("int"))
    base = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("s"), v.alias("v"))
    early = F.slice("v", 1, 6)
    return base.select(
        "s",
        F.col("v").alias("transfer_matrix"),
        early.alias("early_start"),
        F.zip_with(early, F.slice("v", 9, 6), lambda a, b: a + b).alias("late_start"),
        F.slice("v", 17, 8).alias("service_time"),
    )


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUNS: progress events of each user's run towards the bound 200."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), "event_id", "ts", F.col("value").alias("best"), F.lit(200.0).alias("bound")
    )


def printed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 81 columns of a trial log as text under their printed headers.

    Trials and their cells give what they have; other numbers are made from the instance's sizes.
    """
    known = trials(spark, sf_dir).join(
        cells(spark, sf_dir).drop("customer_num", "service_num", "product_num"), "random_seed", "left"
    )
    filler = {c: f"cast(customer_num * {n} + service_num as string)" for n, (c, _) in enumerate(HEADERS)}
    return known.selectExpr(
        *[f"cast({c} as string) as `{h}`" if c in known.columns else f"{filler[c]} as `{h}`" for c, h in HEADERS]
    )
