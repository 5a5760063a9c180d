"""Connected components of an edge table of any size, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.session import staged


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from every node of ``edges`` (two long columns ``a``, ``b``).

    Alternates two rewrites until nothing changes: every node links its larger neighbours to
    its smallest neighbour, then every node links its smaller neighbours to the smallest. Both
    only aggregate minima and join them back, so a node with very many edges is combined before
    the shuffle and split by the skew join. Returns ``node``, ``root``; roots are not listed.
    Loops are ignored; null ends are ignored; an empty table gives an empty table.
    """
    links = edges.where("a != b").selectExpr("greatest(a, b) u", "least(a, b) v").distinct()
    links, before = staged(links, "links"), None
    while True:
        both = links.unionAll(links.selectExpr("v u", "u v"))
        lowest = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(lowest, "u").where("v > u").selectExpr("v u", "m v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v != m").selectExpr("v u", "m v")
        links = staged(small.unionAll(lowest.selectExpr("u", "m v")).distinct(), "links")
        now = links.selectExpr("count(*)", "sum(cast(xxhash64(u, v) as decimal(38, 0)))").first()
        if now == before:
            return links.selectExpr("u node", "v root")
        before = now
