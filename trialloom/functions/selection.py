"""Exact quantiles by radix selection over order-preserving 64-bit numbers.

Every value becomes a whole number that sorts as the value does. The first pass counts the
leading bits per group; each later pass opens only the bins that hold a wanted position and
counts their next bits. Counts are combined before the shuffle, so no value moves and a group
with most of the rows is no heavier than another. A bin that is opened has at most 2^22 parts,
which bounds the one window that adds them up; one with no more rows than that is opened to the
last bit at once, and one with a single value is not opened at all. Only open bins, two for each
group and quantile at most, come to the driver between the passes.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits that stay to the right of each pass's prefix; the passes read 22, 21 and 21 bits.
SHIFTS = (42, 21, 0)
#: Most parts of an open bin, those of 22 bits, whatever it holds.
MOST_PARTS = 1 << 22
#: Most groups whose open bins are broadcast (two bins for each quantile).
MOST_GROUPS = 10_000

_BITS, _BIN, _OPEN, _N, _UPTO, _TARGETS = "_bits", "_bin", "_open", "_n", "_upto", "_targets"

# Exponent by logarithm, corrected by the unit, as the logarithm may round over a power of two.
# Products with powers of two are exact. Below 2^-1022 numbers have no leading one.
_ORDER = """
    case when isnan(_mag) then 9223372036854775807L
         when _mag = double('Infinity') then 2047L * 4503599627370496L
         when _unit >= 2 then (_exp + 1024) * 4503599627370496L + bigint((_unit / 2 - 1) * 4503599627370496D)
         when _unit >= 1 then (_exp + 1023) * 4503599627370496L + bigint((_unit - 1) * 4503599627370496D)
         when _exp = -1022 then bigint(_unit * 4503599627370496D)
         else (_exp + 1022) * 4503599627370496L + bigint((_unit * 2 - 1) * 4503599627370496D) end
"""


def selectable(df: DataFrame, value: str) -> bool:
    """Whether the values have 64 bits that sort as they do."""
    return isinstance(df.schema[value].dataType, (T.DoubleType, T.FloatType, T.IntegralType))


def with_order_bits(df: DataFrame, value: str, name: str = _BITS) -> DataFrame:
    """Add a long that sorts as ``value``: equal only for equal values, NaN last, both zeros alike."""
    if isinstance(df.schema[value].dataType, T.IntegralType):
        return df.withColumn(name, F.col(value).cast("long"))
    exp = "floor(greatest(-1022D, least(1023D, coalesce(log2(_mag), -1022D))))"
    sized = df.selectExpr("*", f"abs(double(`{value}`)) as _mag").selectExpr("*", f"{exp} as _exp")
    sized = sized.selectExpr("*", "_mag * pow(2D, -_exp) as _unit")
    return sized.selectExpr(*[f"`{c}`" for c in df.columns], f"if(`{value}` < 0, -1L, 1L) * {_ORDER} as {name}")


def _counted(rows: DataFrame, by: list[str], value: str, shift: int) -> DataFrame:
    """Rows and the ends of the values in each bin."""
    aggs = f"struct(count(1) as {_N}, min(`{value}`) as _low, max(`{value}`) as _high) as _a"
    bins = rows.selectExpr(*by, f"`{value}`", f"shiftright({_BITS}, {shift}) as {_BIN}")
    return bins.groupBy(*by, _BIN).agg(F.expr(aggs)).select(*by, _BIN, "_a.*")


def _opened(counted: DataFrame, group: str) -> DataFrame:
    """The bins that hold a wanted position, which then counts from the start of its bin."""
    held = f"filter({_TARGETS}, t -> t.at >= {_UPTO} - {_N} and t.at < {_UPTO})"
    moved = f"transform({held}, t -> struct(t.slot as slot, t.at - {_UPTO} + {_N} as at, t.share as share))"
    bins = counted.selectExpr(group, _BIN, _N, "_low", "_high", f"{moved} as {_TARGETS}")
    return bins.where(f"size({_TARGETS}) > 0")


def _wanted(probs: Mapping[str, float], total: str) -> str:
    spots = [f"(double('{float(p)!r}') * ({total} - 1))" for p in probs.values()]
    entries = [
        f"struct({2 * i + side} as slot, bigint({rounded}({spot})) as at, {spot} - floor({spot}) as share)"
        for i, spot in enumerate(spots)
        for side, rounded in enumerate(("floor", "ceil"))
    ]
    return f"array({', '.join(entries)})"


def _running(*by: str) -> str:
    return f"sum({_N}) over (partition by {', '.join(by)} order by {_BIN} rows unbounded preceding)"


def select_quantiles(
    df: DataFrame, group: str, value: str, probs: Mapping[str, float], *, one_group: bool = False
) -> DataFrame | None:
    """One row per group with a value: quantiles by linear interpolation, as ``percentile`` has them.

    Null values don't count. ``one_group`` says that ``group`` is a constant. None if there are more than ``MOST_GROUPS`` groups.
    """
    spark = df.sparkSession
    rows = with_order_bits(df.select(group, value).where(f"`{value}` is not null"), value)
    counted = _counted(rows, [group], value, SHIFTS[0]).selectExpr(
        "*", f"{_running(group)} as {_UPTO}", f"sum({_N}) over (partition by {group}) as _total"
    )
    opened = _opened(counted.selectExpr("*", f"{_wanted(probs, '_total')} as {_TARGETS}"), group)
    most = MOST_GROUPS * 2 * len(probs)
    bins = (opened if one_group else opened.limit(most + 1)).collect()
    if len(bins) > most or len({b[group] for b in bins}) > MOST_GROUPS:
        return None

    at, found = 0, []
    while True:
        found += [b for b in bins if b["_low"] == b["_high"]]
        bins = [b for b in bins if b["_low"] != b["_high"]]
        if not bins:
            break
        # the next digit, or all bits if no bin has more rows than a digit has values
        before, at = SHIFTS[at], at + 1 if max(b[_N] for b in bins) > MOST_PARTS else len(SHIFTS) - 1
        wanted = spark.createDataFrame(bins, opened.schema).selectExpr(group, f"{_BIN} as {_OPEN}", _TARGETS)
        inside = rows.selectExpr("*", f"shiftright({_BITS}, {before}) as {_OPEN}")
        counted = _counted(inside.join(F.broadcast(wanted), [group, _OPEN]), [group, _OPEN, _TARGETS], value, SHIFTS[at])
        bins = _opened(counted.selectExpr("*", f"{_running(group, _OPEN)} as {_UPTO}"), group).collect()

    def end(slot: int, what: str = "_low") -> str:
        return f"max({what}) filter (where _t.slot = {slot})"

    quantiles = [
        f"{end(2 * i)} + ({end(2 * i + 1)} - {end(2 * i)}) * {end(2 * i, '_t.share')} as `{name}`"
        for i, name in enumerate(probs)
    ]
    values = spark.createDataFrame(found, opened.schema).selectExpr(group, "_low", f"explode({_TARGETS}) as _t")
    return values.groupBy(group).agg(*[F.expr(q) for q in quantiles])
