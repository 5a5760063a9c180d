"""Six-bit option bundles and the size descriptors of an instance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
BITS = 6
BASELINE_BUNDLE = "(0, 0, 0, 0, 0, 0)"
EXPECTED_BUNDLES = 64
BASELINE_PHASE = "baseline_300"
STRESS_PHASE = "stress_100"
STAGE_LIMITS = [(300, "S1"), (325, "S2"), (350, "S3"), (375, "S4")]
LAST_STAGE = "S5"

BIT_COLUMNS = [f"bundle_bit_{i}" for i in range(1, BITS + 1)]


def bundle_text(number: str) -> Column:
    """Print a column of numbers 0..63 as ``(b1, b2, b3, b4, b5, b6)``, highest bit first."""
    bits = ", ".join(f"shiftright({number}, {BITS - i}) & 1" for i in range(1, BITS + 1))
    return F.expr(f"format_string('(%d, %d, %d, %d, %d, %d)', {bits})")


def with_bits(df: DataFrame, bundle: str = "valid_selection") -> DataFrame:
    """Add six 0/1 columns from the bundle text; any other number of bits is an error."""
    parts = f"split(regexp_replace({bundle}, '[()\\\\[\\\\]\\\\s]', ''), ',')"
    checked = (
        f"if(size({parts}) = {BITS}, {parts}, "
        f"cast(raise_error(concat('expected {BITS} bundle bits, got ', {bundle})) as array<string>))"
    )
    bits = [f"cast(element_at(_bits, {i}) as int) as {name}" for i, name in enumerate(BIT_COLUMNS, 1)]
    return df.selectExpr("*", f"{checked} as _bits").selectExpr(*[f"`{c}`" for c in df.columns], *bits)


def with_active_counts(df: DataFrame) -> DataFrame:
    """Options active at the root (first three bits) and later (last three)."""
    return df.selectExpr(
        "*",
        f"{' + '.join(BIT_COLUMNS[:3])} as root_active_count",
        f"{' + '.join(BIT_COLUMNS[3:])} as later_active_count",
    )


def stage_of(ordinal: str) -> Column:
    cases = " ".join(f"when {ordinal} <= {limit} then '{stage}'" for limit, stage in STAGE_LIMITS)
    return F.expr(f"case {cases} else '{LAST_STAGE}' end")


def phase_of(ordinal: str) -> Column:
    return F.expr(f"if({ordinal} <= {STAGE_LIMITS[0][0]}, '{BASELINE_PHASE}', '{STRESS_PHASE}')")


def size_signature(customers: str, services: str, products: str, teams: str) -> Column:
    return F.expr(f"format_string('I%d_M%d_N%d_K%d', {customers}, {services}, {products}, {teams})")


def with_model_size(df: DataFrame, i: str, m: str, n: str, k: str, root_bits: str) -> DataFrame:
    """Add the variables and rules of the routing model in closed form.

    ``i`` customers, ``m`` services, ``n`` products, ``k`` teams; each active root option
    adds one rule per ordered customer pair and team.
    """
    arcs = f"({i} + 2) * ({i} + 2) * {k}"
    base = f"{arcs} + 4 * {i} * {k} + 5 * {k} + 2 * {i} + {n} + 6"
    return df.selectExpr(
        "*",
        f"({i} + 2) * {m} + {k} + 2 * ({i} + 2) * {k} + {arcs} as base_num_vars",
        f"{base} as base_num_constrs",
        f"{base} + {root_bits} * {i} * {i} * {k} as root_num_constrs",
    )


def factorial_grid(instances: DataFrame) -> DataFrame:
    """Every instance under every bundle; the grid side is fixed at 64 rows."""
    numbers = F.explode(F.sequence(F.lit(0), F.lit(EXPECTED_BUNDLES - 1)))
    return instances.withColumn("bundle_no", numbers).withColumn(
        "valid_selection", bundle_text("bundle_no")
    )
