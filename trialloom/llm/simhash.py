"""Near duplicates by SimHash fingerprints, found in BK-trees.

Fingerprints within ``radius`` bits agree on at least two of six blocks of bits, so every pair
of blocks (fifteen of them) names a bucket, and a pair within the radius meets in at least one.
Each bucket is the shard of one BK-tree: a node's children are keyed by their integer Hamming
distance to it, and a search follows only edges within the radius of the distance at hand. The
trees of many buckets are built and searched together as one forest of arrays. A bucket with
more than ``TREE`` fingerprints is dealt into several trees, and each is searched by the
bucket's fingerprints in blocks, so that no task holds more than two blocks of any bucket.
Trees travel with the shuffle to the blocks that search them; nothing that grows with the
corpus is broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.llm.graph import components
from trialloom.session import staged

WORDS, RADIUS, SEED = 4, 4, 42
#: First bit and width of the six blocks of a fingerprint.
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
#: Most fingerprints in one tree, and pairs of nodes and searches looked at together.
TREE, STEP = 4096, 1 << 17
SPACE = b" \t\n\v\f\r"


def word_blocks(data: bytes, size: int = 1 << 22) -> Iterator[list[bytes]]:
    """Words of a text, block by block, so that a very long text is never split whole."""
    start = 0
    while start < len(data):
        end = min(start + size, len(data))
        while end < len(data) and data[end] not in SPACE:
            end += 1
        yield data[start:end].split()
        start = end


def shingle_hashes(data: bytes, words: int = WORDS) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of a lower-cased text; of all words together if they are fewer."""
    carry: list[bytes] = []
    seen = 0
    for block in word_blocks(data.lower()):
        block = carry + block
        seen += len(block) - len(carry)
        n = len(block) - words + 1
        if n > 0:
            joined = b" ".join(block)
            lengths = np.fromiter(map(len, block), np.int64, len(block))
            ends = np.cumsum(lengths + 1) - 1
            spans = map(slice, (ends - lengths)[:n].tolist(), ends[words - 1 :].tolist())
            hashes = map(xxhash.xxh64_intdigest, map(joined.__getitem__, spans), repeat(SEED))
            yield np.fromiter(hashes, np.uint64, n)
        carry = block[-(words - 1) :] if words > 1 else []
    if 0 < seen < words:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], np.uint64)


def fingerprint(data: bytes | None, words: int = WORDS) -> int:
    """Bits that are set in over half of the shingle hashes; zero for a text without words."""
    total, counts = 0, np.zeros(64, np.int64)
    for hashes in shingle_hashes(data or b"", words):
        total += len(hashes)
        for at in range(0, len(hashes), 8192):
            bits = np.unpackbits(hashes[at : at + 8192].view(np.uint8), bitorder="little")
            counts += bits.reshape(-1, 64).sum(axis=0, dtype=np.uint16)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.int64)[0])


def _fingerprint_column(words: int):
    @F.arrow_udf("long")
    def column(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(x, words) for x in texts.cast(pa.binary()).to_pylist()], pa.int64())

    return column


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of the range and value, for all values of all ranges [first, last)."""
    lengths = np.maximum(last - first, 0)
    owner = np.repeat(np.arange(len(first)), lengths)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return owner, first[owner] + within


class Forest:
    """BK-trees over fingerprints, one for each unit, as arrays.

    ``children`` lists the nodes by parent and distance; ``slots[n]`` to ``slots[n + 1]`` are the
    children of node n, whose ``keys`` are parent * 65 + distance.
    """

    def __init__(self, prints: np.ndarray, units: np.ndarray) -> None:
        """``units`` is sorted; the first fingerprint of a unit is its root."""
        self.prints, n = prints, len(prints)
        first = np.flatnonzero(np.r_[True, units[1:] != units[:-1]])
        self.units, self.roots = units[first], first
        parent = np.repeat(first, np.diff(np.r_[first, n]))
        edge = np.full(n, -1, np.int64)
        rest = np.setdiff1d(np.arange(n), first, assume_unique=True)
        while len(rest):
            distance = np.bitwise_count(prints[rest] ^ prints[parent[rest]]).astype(np.int64)
            slot = parent[rest] * 65 + distance
            order = np.argsort(slot, kind="stable")
            rest, slot = rest[order], slot[order]
            heads = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
            child = np.repeat(rest[heads], np.diff(np.r_[heads, len(rest)]))
            edge[rest[heads]] = slot[heads]
            below = child != rest
            rest = rest[below]
            parent[rest] = child[below]
        nodes = np.flatnonzero(edge >= 0)
        self.children = nodes[np.argsort(edge[nodes], kind="stable")]
        self.keys = edge[self.children]

    def search(self, queries: np.ndarray, units: np.ndarray, radius: int) -> Iterator[tuple]:
        """Pairs (query, node) within the radius, each query in the tree of its unit."""
        at = np.searchsorted(self.units, units)
        found = at < len(self.units)
        found[found] = self.units[at[found]] == units[found]
        waiting = [(np.flatnonzero(found), self.roots[at[found]])]
        while waiting:
            query, node = waiting.pop()
            if len(query) > STEP:
                half = len(query) // 2
                waiting += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            distance = np.bitwise_count(queries[query] ^ self.prints[node]).astype(np.int64)
            near = distance <= radius
            yield query[near], node[near]
            low = node * 65 + np.maximum(distance - radius, 0)
            high = node * 65 + np.minimum(distance + radius, 64) + 1
            owner, slot = _ranges(np.searchsorted(self.keys, low), np.searchsorted(self.keys, high))
            if len(owner):
                waiting.append((query[owner], self.children[slot]))


def _contract(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest position linked to each of n positions."""
    label = np.arange(n)
    a = np.concatenate([x for x, _ in pairs]) if pairs else label[:0]
    b = np.concatenate([y for _, y in pairs]) if pairs else label[:0]
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def link_units(units: np.ndarray, prints: np.ndarray, nodes: np.ndarray, tree: np.ndarray, radius: int):
    """Links (a, b) between ``nodes`` that give each unit's groups within the radius.

    ``tree`` says which rows are in their unit's tree; the others search it. In a unit where all
    rows are in the tree, all search it.
    """
    order = np.lexsort((nodes, units))
    units, prints, nodes, tree = units[order], prints[order], nodes[order], tree[order]
    _, unit = np.unique(units, return_inverse=True)
    mixed = np.bincount(unit, weights=~tree) > 0
    inside, asking = np.flatnonzero(tree), np.flatnonzero(~tree | ~mixed[unit])
    forest = Forest(prints[inside], units[inside])
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    label, held = np.arange(len(nodes)), 0
    for query, node in forest.search(prints[asking], units[asking], radius):
        a, b = asking[query], inside[node]
        pairs.append((a[a != b], b[a != b]))
        held += len(query)
        if held > 8 * STEP:  # pairs seen so far become links to their smallest member
            label = _contract(len(nodes), pairs)
            pairs, held = [(np.arange(len(nodes)), label)], 0
    label = _contract(len(nodes), pairs)
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _links(radius: int):
    """Sorted rows of whole units in, links out; units are taken together in bounded pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def piece(table: pa.Table) -> pa.RecordBatch:
            column = {x: table.column(x).to_numpy() for x in ("unit", "print", "node", "tree")}
            a, b = link_units(
                column["unit"], column["print"].view(np.uint64), column["node"], column["tree"].astype(bool), radius
            )
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            units = held.column("unit").to_numpy()
            whole = int(np.searchsorted(units, units[-1])) if len(units) else 0
            if whole:
                yield piece(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield piece(held)

    return run


def similar_links(prints: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """Links ``a``, ``b`` that join all ``node``s whose ``print``s differ in at most ``radius`` bits.

    ``prints`` has one row for each distinct fingerprint (longs ``print``, ``node``, no nulls).
    Up to four bits may differ for the two-block buckets to be exact. Links are a spanning set:
    not every pair within the radius is listed, but every one is joined through links.
    """
    if not 0 <= radius <= len(BLOCKS) - 2:
        raise ValueError(f"radius must be 0 to {len(BLOCKS) - 2}")
    bits = [f"(shiftrightunsigned(print, {at}) & {(1 << width) - 1})" for at, width in BLOCKS]
    keys = [
        f"shiftleft({k}L, 22) | shiftleft({bits[i]}, 11) | {bits[j]}"
        for k, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))
    ]
    keyed = prints.selectExpr("print", "node", f"explode(array({', '.join(keys)})) as key")
    large = keyed.groupBy("key").count().where(F.col("count") > tree)
    parts = large.selectExpr("key", f"cast(ceil(count / {tree}) as int) as parts")
    dealt = keyed.join(parts, "key", "left").selectExpr(
        "print", "node", "key", "coalesce(parts, 1) as parts", "pmod(xxhash64(print), coalesce(parts, 1)) as part"
    )
    # tree i of a bucket is searched by parts i and above; a part searches trees up to its own
    units = dealt.selectExpr("print", "node", "key", "part", "explode(sequence(0, parts - 1)) as other").selectExpr(
        "xxhash64(key, least(part, other), greatest(part, other)) as unit", "print", "node", "part <= other as tree"
    )
    units = units.repartition("unit").sortWithinPartitions("unit")
    return units.mapInArrow(_links(radius), "a long, b long")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id``, ``mark`` (hash of the text) and ``print`` (long) of every row."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("mark"),
        _fingerprint_column(words)(F.col("text")).alias("print"),
    )


def _grouped(prints: DataFrame, radius: int) -> DataFrame:
    """``prints`` with the ``component_id`` of each row."""
    distinct = staged(prints.groupBy("print").agg(F.min("doc_id").alias("node")).where("node is not null"), "distinct")
    roots = components(similar_links(distinct, radius))
    groups = distinct.join(roots, "node", "left").selectExpr("print", "coalesce(root, node) as component_id")
    return prints.join(groups, "print", "left")


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """``doc_id``, ``fingerprint`` (hex) and ``component_id`` of every row of ``docs``.

    Fingerprints link within ``radius`` bits; ``component_id`` is the smallest doc_id reachable.
    Equal rows get equal results, one for each row. A null or empty text, or one without words,
    has fingerprint zero and links like any other; a very long text is read in blocks of 4 MB
    with the same result. A row without doc_id takes the component of its fingerprint and adds no
    links (null if no row with that fingerprint has a doc_id). Empty tables give empty tables;
    columns besides doc_id and text are not read.
    """
    prints = staged(fingerprints(docs, words).select("doc_id", "print"), "fingerprints")
    return _grouped(prints, radius).selectExpr(
        "doc_id", "lpad(lower(hex(print)), 16, '0') as fingerprint", "component_id"
    )


def keep_one(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs``, the one with the smallest doc_id, of each group of near duplicates.

    Where several texts of a group share that doc_id, the one with the smallest hash stays, and one
    of equal rows. Rows without doc_id belong to the group of their fingerprint and stay only
    where it holds no doc_id at all. Columns are those of ``docs``, whatever their names.
    """
    prints = staged(fingerprints(docs, words), "fingerprints")
    groups = _grouped(prints, radius).selectExpr(
        "component_id", "if(component_id is null, print, null) as unnamed", "struct(doc_id is null, doc_id, mark) as place"
    )
    kept = groups.groupBy("component_id", "unnamed").agg(F.min("place").alias("place"))
    kept = kept.selectExpr("place.doc_id as kept_id", "place.mark as kept_mark")
    rows = docs.select(
        F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64("text").alias("mark")
    )
    one = rows.join(kept, F.expr("own_id <=> kept_id and mark = kept_mark"), "left_semi")
    return one.dropDuplicates(["own_id", "mark"]).select("doc.*")
