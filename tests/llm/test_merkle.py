"""Manifests and proofs against a plain version and SQL."""

import hashlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from tests.compare import connect, differences
from trialloom.llm import merkle
from trialloom.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def plain_tree(digests):
    """Root and, for each leaf, the (left, right) texts of its siblings level by level."""
    nodes = [(d, [i]) for i, d in enumerate(digests)]
    steps = [[] for _ in digests]
    while len(nodes) > 1:
        above = []
        for at in range(0, len(nodes), 8):
            run = nodes[at : at + 8]
            for j, (_, leaves) in enumerate(run):
                for i in leaves:
                    steps[i].append(("".join(x for x, _ in run[:j]), "".join(x for x, _ in run[j + 1 :])))
            above.append((sha("".join(x for x, _ in run)), [i for _, leaves in run for i in leaves]))
        nodes = above
    return nodes[0][0], steps


def plain_rows(rows, claim=lambda row: None):
    """doc_id, leaf, subroot, root, proof, folded root and verified of each row, sorted."""
    order = sorted(rows, key=lambda r: (r[2] is not None, (r[2] or "").encode(), r[0] is not None, r[0] or 0, plain_leaf(*r)))
    parts = [list(g) for _, g in groupby(order, key=lambda r: r[2])]
    trees = [plain_tree([plain_leaf(*r) for r in part]) for part in parts]
    root, tops = plain_tree([t[0] for t in trees])
    out = []
    for part, (subroot, steps), top in zip(parts, trees, tops):
        for row, own in zip(part, steps):
            path = own + top
            folded = plain_leaf(*row) if claim(row) is None else plain_leaf(row[0], claim(row), *row[2:])
            for left, right in path:
                folded = sha(left + folded + right)
            proof = sha("".join(left + right for left, right in path))
            out.append((row[0], plain_leaf(*row), subroot, root, proof, folded, folded == root))
    return sorted(out, key=str)


def shown(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    rows, problems = differences(spark, connect(sf), "op13", QUERIES["op13_merkle_manifest"], ORACLES["op13_merkle_manifest"], sf)
    assert rows == 200 and not problems


@pytest.mark.parametrize("n", [1, 7, 8, 9, 64, 65, 520])
def test_sizes_of_trees(spark, n):
    rows = [(i * 3, f"text {i}", "en", "s", i) for i in range(n)]
    assert shown(merkle.proof_table(spark.createDataFrame(rows, SCHEMA))) == plain_rows(rows)


def test_many_parts_nulls_ties_and_claims(spark):
    rows = [(i, f"Text {i}", f"l{i % 70:02d}", None, i) for i in range(200)]
    rows += [(i, "x", None, "s", None) for i in range(20)] + [(None, None, "en", "s", 0), (None, "", "en", "s", 0), (None, None, None, None, None)]
    rows += [(5, "other", "en", "s", 1), (5, "another", "en", "s", 1), (5, "other", "en", "s", 1)] * 4  # ids that repeat, equal rows
    rows += [(900, "Long " * 100_000, "é", "s", 1), (901, "ß", "z", "s", 1)]
    claim = lambda r: r[1].lower() if r[0] is not None and r[0] % 3 == 0 and r[1] is not None else None
    extra = ", part int, digest string, rank int, n int, path string, root string, bucket int, claimed int, lo long"
    frame = spark.createDataFrame([(*r, 1, "d", 2, 3, "p", "r", 4, 5, 6) for r in rows], SCHEMA + extra)
    got = merkle.proof_table(frame, F.when(F.col("doc_id") % 3 == 0, F.lower("text")))
    want = plain_rows(rows, claim)
    assert shown(got) == want
    assert {r[6] for r in want} == {True, False}


def test_nodes_cover_their_leaves(spark):
    leaves = spark.createDataFrame([("a" if i < 90 else "b", i, sha(str(i))) for i in range(100)], "part string, id long, digest string")
    tree = merkle.grow(leaves, [F.col("id")])
    assert [level.count() for level in tree.levels] == [12 + 2, 2 + 1, 1]
    for level in tree.levels:
        for node in level.collect():
            spans = [(c.lo, c.hi) for c in node.children]
            assert spans[0][0] == node.lo and spans[-1][1] == node.hi
            assert all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and len(spans) <= 8
            assert node.digest == sha("".join(c.digest for c in node.children))


def test_empty_table(spark):
    assert merkle.proof_table(spark.createDataFrame([], SCHEMA)).collect() == []
