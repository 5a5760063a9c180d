"""Shards of near-equal bytes by histogram sort, in DataFrame and SQL operations only.

Rows are ordered by a hash of the text and then by doc_id, so equal texts lie side by side. The
driver keeps one interval of that order for each of the ``shards - 1`` splitters. Each round
counts, over all partitions, the exact bytes below evenly spaced candidate boundaries inside
the open intervals (some thousand numbers at most), keeps the boundaries within the tolerance
of their target, and opens the interval around the others. Only a group of equal texts that is
larger than the tolerance is probed by doc_id and so cut. Rows then move once, to cells of the
order that are far finer than shards; counted cells give every row its slot without a sort of
a whole shard in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialloom.session import staged

SHARDS, TOLERANCE = 24, 0.002
#: Bits of the first round and of the later ones.
FIRST_BITS, NEXT_BITS = 10, 8
LOWEST = -(1 << 63)


@dataclass(frozen=True)
class Span:
    """Rows whose ``place`` (or, inside one place, ``id``) has ``prefix`` above ``shift`` bits."""

    place: int | None
    shift: int
    prefix: int

    def has(self) -> str:
        if self.place is None:
            return f"shiftright(place, {self.shift}) = {self.prefix}L"
        whole = f"place = {self.place}L"  # ids of both signs share no bit
        return whole if self.shift > 63 else f"{whole} and shiftright(id, {self.shift}) = {_long(self.prefix)}"

    def bin(self, shift: int) -> str:
        return f"shiftright({'place' if self.place is None else 'id'}, {shift})"

    def edge(self, prefix: int, shift: int) -> tuple[int, int]:
        """First (place, id) of a bin of this span."""
        low = prefix << shift
        return (low, LOWEST) if self.place is None else (self.place, low)


def _long(value: int) -> str:
    return f"cast('{value}' as bigint)"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, crc32 and the order's two keys, ``place`` (63 bits of a hash) and ``id``."""
    return docs.selectExpr(
        "cast(doc_id as bigint) as doc_id",
        "cast(coalesce(octet_length(text), 0) + 8 as bigint) as size",
        "crc32(cast(coalesce(text, '') as binary)) as text_crc32",
        "shiftrightunsigned(xxhash64(text), 1) as place",
        f"coalesce(cast(doc_id as bigint), {_long(LOWEST)}) as id",
    )


def splitters(keys: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """First (place, id) of shards 1 and above, so that shards hold near-equal sums of ``size``.

    A boundary is kept if the bytes below it are within ``tolerance`` of a shard's share from its
    target; where single rows are larger than that, the nearest boundary between two rows is.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    targets = [total * i // shards for i in range(1, shards)]
    slack = tolerance * total / shards
    done: dict[int, tuple[int, int]] = {}
    # what is still open: the splitters, the bytes below the span, and the width of its bins
    waiting = [(Span(None, 63, 0), 63 - FIRST_BITS, 0, [*range(len(targets))])] if total else []
    while waiting:
        which = "case " + " ".join(f"when {x[0].has()} then {j}" for j, x in enumerate(waiting)) + " end"
        bins = "case which " + " ".join(f"when {j} then {x[0].bin(x[1])}" for j, x in enumerate(waiting)) + " end"
        counted = (
            keys.selectExpr("size", "place", "id", f"{which} as which")
            .where("which is not null")
            .selectExpr("which", "size", "place", "id", f"{bins} as bin")
            .groupBy("which", "bin")
            .agg(F.sum("size"), F.min("place"), F.max("place"), F.min("id"), F.max("id"))
            .collect()
        )
        opened = []
        for j, (span, shift, below, open_now) in enumerate(waiting):
            inside = sorted((r[1:] for r in counted if r[0] == j), key=lambda r: r[0])
            for bin_, size, place, last_place, first, last in inside:
                chosen = [i for i in open_now if below < targets[i] <= below + size or targets[i] == below == 0]
                deeper = []
                for i in chosen:
                    near_low = targets[i] - below <= below + size - targets[i]
                    single = place == last_place and first == last
                    if single or min(targets[i] - below, below + size - targets[i]) <= slack:
                        done[i] = span.edge(bin_ + (not near_low), shift)
                    else:
                        deeper.append(i)
                if deeper:
                    one = place == last_place  # equal texts only: go on by id
                    low, high = (first, last) if one else (place, last_place)
                    width = ((low ^ high) & ((1 << 64) - 1)).bit_length()
                    inner = Span(place if one else None, width, low >> width)
                    opened.append((inner, max(0, width - NEXT_BITS), below, deeper))
                below += size
        waiting = opened
    return [done[i] for i in range(len(targets))] if total else []


def _shard(edges: list[tuple[int, int]], low: int, high: int) -> str:
    """SQL for the number of splitters at or below a row, by halving."""
    if low == high:
        return str(low)
    middle = (low + high) // 2
    place, first = edges[middle]
    below = f"place < {_long(place)}"
    if first != LOWEST:
        below += f" or place = {_long(place)} and id < {_long(first)}"
    return f"case when {below} then {_shard(edges, low, middle)} else {_shard(edges, middle + 1, high)} end"


def placed(rows: DataFrame, edges: list[tuple[int, int]], keys: DataFrame, cell_rows: int = 200_000) -> DataFrame:
    """``rows`` (with ``place`` and ``id``) plus ``shard`` and ``slot``; ``keys`` has the same rows.

    Slots number a shard's rows from 0, cell by cell in the order of ``place``. Cells hold about
    ``cell_rows`` rows and at most 1/1024 of all; where equal texts fill a cell, its ids divide it
    further, and its slots then go by part and (place, id).
    """
    shard = _shard(edges, 0, len(edges))
    n = keys.count()
    bits = max(FIRST_BITS, (n // cell_rows).bit_length())
    most = max(16, 2 * n >> bits)
    with_cell = [f"{shard} as shard", f"shiftright(place, {63 - bits}) as cell"]
    coarse = keys.selectExpr("id", *with_cell).groupBy("shard", "cell").agg(
        F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")
    )
    crowded = staged(
        coarse.where(F.col("n") > most).selectExpr(
            "shard", "cell", f"cast(ceil(n / {most}) as int) as parts", "cast(low as double) low", "cast(high as double) high"
        ),
        "crowded",
    )
    part = (
        "coalesce(least(parts - 1, cast(floor((cast(id as double) - low) / (high - low + 1) * parts) as int)), 0) as part"
    )

    def cells(table: DataFrame) -> DataFrame:
        own = [c for c in table.columns]
        table = table.selectExpr("*", *with_cell).join(crowded, ["shard", "cell"], "left")
        return table.selectExpr(*[f"`{c}`" for c in own], "shard", "cell", part)

    order = Window.partitionBy("shard").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1)
    counts = cells(keys.select("place", "id")).groupBy("shard", "cell", "part").count()
    starts = counts.select(
        "shard", "cell", "part", F.coalesce(F.sum("count").over(order), F.lit(0)).alias("start")
    )
    within = F.row_number().over(Window.partitionBy("shard", "cell", "part").orderBy("place", "id"))
    numbered = cells(rows).withColumn("within", within)
    return (
        numbered.join(starts, ["shard", "cell", "part"])
        .withColumn("slot", F.col("start") + F.col("within") - 1)
        .select(*rows.columns, "shard", "slot")
    )


def shard_rows(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Every row of ``docs``, whole, with its ``size``, ``shard`` and ``slot``.

    ``doc`` holds the row's own columns as a struct, so their names clash with nothing. A size is
    the text's UTF-8 bytes plus 8; a null text has none. Equal texts stay in one shard unless a
    splitter has to cut them; rows equal in text and doc_id always stay together (ties among them
    are numbered arbitrarily). Null doc_ids come first among equal texts. With fewer rows than
    shards some shards stay empty; an empty table gives an empty table.
    """
    keys = staged(keyed(docs).select("size", "place", "id"), "keys")
    edges = splitters(keys, shards, tolerance)
    named = docs.select(F.struct("*").alias("doc"), "doc_id", "text")
    rows = named.selectExpr(
        "doc",
        "cast(coalesce(octet_length(text), 0) + 8 as bigint) as size",
        "shiftrightunsigned(xxhash64(text), 1) as place",
        f"coalesce(cast(doc_id as bigint), {_long(LOWEST)}) as id",
    )
    return placed(rows, edges, keys).drop("place", "id")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, tolerance: float = TOLERANCE) -> None:
    """Write ``shard_rows`` as Parquet, one folder for each shard, rows in the order of slots."""
    rows = shard_rows(docs, shards, tolerance)
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_table(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row; no text moves."""
    keys = staged(keyed(docs), "keys")
    edges = splitters(keys, shards, tolerance)
    return placed(keys, edges, keys).selectExpr(
        "doc_id", "size", "text_crc32", "'bytes' as law", "shard", "slot", "cast(null as int) as grown_shard"
    )
