"""Merkle manifest of a table: digests of rows folded eight by eight, with a proof for each row.

Leaves are ranked inside their part (a language) and every node carries the interval of leaf ranks
it covers. Level k is made from level k - 1 by one group-by on the part and the interval's start
divided by 8^k; so the children of a node are those whose intervals lie in its own, and no node
needs a pointer. Proofs go down the same way: the nodes of a level join the nodes above by part and
bucket with the containment of their intervals as condition, and what is left of the parent's
interval without the child's own are its siblings. The roots of all parts are the leaves of one
more tree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.functions.ordering import numbered
from trialloom.session import staged

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(sql: str) -> str:
    value = f"cast({sql} as string)"
    return f"if({sql} is null, '-', concat(octet_length({value}), ':', {value}))"


def leaf(*fields: str) -> str:
    """SQL of a row's digest: each field as its UTF-8 length and value, ``-`` for null."""
    return f"sha2(concat({', '.join(map(_field, fields))}), 256)"


@dataclass
class Tree:
    """``leaves`` are the given rows with rank and n; ``levels[k]`` are the nodes above 8^k leaves.

    A node has part, lo, hi (leaf ranks it covers), n (leaves of its part), digest and its children.
    """

    leaves: DataFrame
    levels: list[DataFrame]

    def tops(self) -> DataFrame:
        """``part`` and ``digest`` of the one node that is left of each part."""
        found = self.leaves.where("n = 1").select("part", F.col("digest"))
        for level in self.levels:
            found = found.unionByName(level.where("lo = 0 and hi = n").select("part", "digest"))
        return found


def grow(leaves: DataFrame, order: list[Column], fan: int = FAN) -> Tree:
    """The trees over ``leaves``, a written table with ``part`` and ``digest``, each part in ``order``.

    While a part has several nodes, each ``fan`` consecutive ones become the digest of their
    concatenation; the last run may be shorter, even one.
    """
    ranked = staged(numbered(leaves, ["part"], order, name="rank", size="n", written=True), "ranked")
    most = ranked.agg(F.max("n")).first()[0] or 0
    below = ranked.select("part", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "n", "digest")
    levels, width = [], 1
    while width < most:
        width *= fan
        nodes = below.where(F.col("n") > width // fan).groupBy("part", "n", F.expr(f"lo div {width}").alias("bucket"))
        made = nodes.agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("children"))
        digest = "sha2(array_join(transform(children, x -> x.digest), ''), 256)"
        level = made.selectExpr(
            "part", "bucket", "children[0].lo as lo", "children[size(children) - 1].hi as hi", "n", f"{digest} as digest", "children"
        )
        levels.append(staged(level, "level"))
        below = levels[-1].drop("children", "bucket")
    return Tree(ranked, levels)


def paths(tree: Tree, above: DataFrame | None = None, fan: int = FAN) -> DataFrame:
    """The tree's leaves with ``path``: for each level the siblings' digests to the left and right.

    ``above`` has, for each ``part``, the ``path`` that follows its top node; its other columns come along.
    """
    carried = [] if above is None else [c for c in above.columns if c not in ("part", "path")]

    def start(nodes: DataFrame) -> DataFrame:
        if above is None:
            return nodes.withColumn("path", F.expr("cast(array() as array<struct<left: string, right: string>>)"))
        on = nodes["part"].eqNullSafe(above["part"])
        return nodes.join(above, on).select(*[nodes[c] for c in nodes.columns], "path", *carried)

    found = parents = None
    for k in range(len(tree.levels), -1, -1):
        width = fan**k
        nodes = tree.levels[k - 1] if k else tree.leaves.withColumns({"lo": F.col("rank"), "hi": F.col("rank") + 1})
        found = start(nodes.where("lo = 0 and hi = n"))
        if parents is not None:
            inside = nodes.where(F.col("n") > width).withColumn("under", F.expr(f"lo div {width * fan}"))
            contained = "c.part <=> p.part and c.under = p.bucket and p.lo <= c.lo and c.hi <= p.hi"
            both = inside.alias("c").join(parents.alias("p"), F.expr(contained))
            left, right = (
                f"array_join(transform(filter(p.children, x -> {where}), x -> x.digest), '')"
                for where in ("x.hi <= c.lo", "x.lo >= c.hi")
            )
            path = f"concat(array(named_struct('left', {left}, 'right', {right})), p.path) as path"
            own, came = [F.col(f"c.{x}") for x in nodes.columns], [F.col(f"p.{x}") for x in carried]
            found = found.unionByName(both.select(*own, F.expr(path), *came))
        parents = found
    return found


def manifest(docs: DataFrame, claimed: Column | None = None) -> DataFrame:
    """doc_id, leaf, claimed, subroot, root and path of every row of ``docs``.

    Leaves ascend by doc_id inside their language, rows without doc_id first; equal doc_ids go by
    digest, and equal rows get places of their own. Null is a language like any other, the first
    one. Empty and very long texts are digested whole. ``claimed`` is another text to digest in
    place of ``text``; where there is none, that digest is null. Other columns are not read, and
    an empty table gives an empty table.
    """
    text = F.lit(None).cast("string") if claimed is None else claimed
    named = docs.select(*FIELDS, text.alias("claimed"))
    other = f"if(claimed is null, null, {leaf(*FIELDS[:-1], 'claimed')}) as claimed"
    digested = named.selectExpr("cast(doc_id as bigint) as doc_id", "lang as part", f"{leaf(*FIELDS)} as digest", other)
    tree = grow(staged(digested, "leaves"), [F.col("doc_id").asc_nulls_first(), F.col("digest")])
    subroots = staged(tree.tops().selectExpr("0 as part", "part as lang", "digest"), "subroots")
    top = grow(subroots, [F.col("lang").asc_nulls_first()])
    root = top.tops().select("digest").first()
    above = staged(paths(top).selectExpr("lang as part", "path", "digest as subroot"), "above")
    found = paths(tree, above)
    return found.select("doc_id", F.col("digest").alias("leaf"), "claimed", "subroot", F.lit(root and root[0]).alias("root"), "path")


def folded(start: str) -> str:
    """SQL of the root that a digest and a path give."""
    return f"aggregate(path, {start}, (acc, s) -> sha2(concat(s.left, acc, s.right), 256))"


def proof_table(docs: DataFrame, claimed: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    The proof is the siblings' digests, level by level and left to right. The root is folded from
    the claimed text's digest where there is one, and verified if it is the manifest's.
    """
    proof = "sha2(array_join(transform(path, s -> concat(s.left, s.right)), ''), 256) as proof_sha256"
    shown = manifest(docs, claimed).selectExpr(
        "doc_id", "leaf", "subroot", "root", proof, f"{folded('coalesce(claimed, leaf)')} as folded_root"
    )
    return shown.withColumn("verified", F.expr("folded_root = root"))
