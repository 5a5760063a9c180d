"""Repeated lines against a plain version and SQL."""

import hashlib
from collections import defaultdict
from random import Random

from tests.compare import connect, differences
from trialloom.llm import line_runs
from trialloom.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string"
BLANKS = " \t\n\x0b\x0c\r"


def plain_key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def plain(rows, least_chars=40, least_docs=5):
    """(doc_id, n_lines, n_dropped, kept) of each row."""
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(plain_key(line)) >= least_chars:
                holders[plain_key(line)].add(doc_id)
    low = lambda i: -(2**63) if i is None else i
    owner = {k: max(ids, key=low) for k, ids in holders.items() if len(ids) >= least_docs}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if plain_key(x) not in owner or owner[plain_key(x)] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def cut(spark, rows, **options):
    got = line_runs.cut_lines(spark.createDataFrame(rows, SCHEMA), **options).collect()
    return sorted(((r.doc.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got), key=str)


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    rows, problems = differences(spark, connect(sf), "op11", QUERIES["op11_line_dedup"], ORACLES["op11_line_dedup"], sf)
    assert rows == 200 and not problems


def random_rows(seed, n=80):
    draw = Random(seed)
    lines = [f"Line {i} of the pool" for i in range(30)] + ["É upper stays", "é upper stays", "short", "", "  line 3 OF the pool\r"]
    weights = [30] + [2] * 14 + [1] * 20  # the first line is in most documents
    return [(i, "\n".join(draw.choices(lines, weights, k=draw.randint(0, 9)))) for i in range(n)]


def test_plain_version_and_edges(spark):
    rows = random_rows(1) + [(None, None), (None, "Line 1 of the pool\nx"), (None, "x\nLine 1 of the pool"), (7, "")]
    rows += [rows[3], rows[3], (5, "line 2 of the pool\nline 2 of the pool\nother")]  # repeated rows, one id with two texts
    rows += [(200, "Line 0 of the pool\n" * 3), (201, "only its own words here\n" * 5000 + "Line 4 of the pool")]
    want = sorted(plain(rows, 10, 5), key=str)
    assert cut(spark, rows, least_chars=10, least_docs=5) == want
    assert sum(r[2] for r in want) > 100


def test_hot_lines_and_runs_of_any_number(spark, monkeypatch):
    rows = random_rows(2)
    want = sorted(plain(rows, 10, 5), key=str)
    monkeypatch.setattr(line_runs, "HOT_DOCS", 6)  # frequent lines by broadcast, the others by shuffle
    monkeypatch.setattr(line_runs, "HOT_KEYS", 10)
    assert cut(spark, rows, least_chars=10, least_docs=5) == want
    found = line_runs.lines(spark.createDataFrame(rows, SCHEMA), 10).cache()
    first = None
    for batches, fan in ((1, 2), (5, 2), (7, 3)):
        got = {tuple(r) for r in line_runs.repeated(found, 3, batches, fan).select("h", "g", "docs", "owner").collect()}
        first = first or got
        assert got == first and len({r[:2] for r in got}) == len(got)


def test_index_knows_new_keys_and_merges_levels(spark):
    index = line_runs.LineRuns(spark, fan=2)
    entries = lambda ids, owner: spark.createDataFrame([(i, i * 7, 1, owner) for i in ids], "h long, g long, docs long, owner long")
    index.add(entries(range(0, 50), 9))
    assert {r.h for r in index.new_keys(entries(range(40, 60), 8)).collect()} == set(range(50, 60))
    index.add(entries(range(40, 60), 8))
    assert [len(level) for level in index.levels] == [0, 1]  # two runs became one of the next level
    index.add(entries(range(55, 70), 7))
    totals = {r.h: (r.docs, r.owner) for r in index.totals().collect()}
    assert totals == {i: (1 + (40 <= i < 50) + (55 <= i < 60), 9 if i < 50 else 8 if i < 60 else 7) for i in range(70)}
    index.close()
    assert index.levels == []


def test_clashing_columns_and_empty_tables(spark):
    wide = "doc_id long, text string, doc string, mark int, pos int, h long, kept string, cuts int, n_lines string"
    rows = [(i, f"the very same line in each\nown {i}", "d", 1, 2, 3, "k", 4, "n") for i in range(6)]
    got = line_runs.cut_lines(spark.createDataFrame(rows, wide), 10).collect()
    assert {tuple(r.doc): r.kept for r in got} == {
        r: f"own {r[0]}" if r[0] < 5 else r[1] for r in rows
    }
    assert line_runs.dedup_table(spark.createDataFrame([], SCHEMA)).collect() == []
    nothing = line_runs.dedup_table(spark.createDataFrame([(1, None), (None, "")], SCHEMA)).collect()
    assert {(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in nothing} == {
        (i, 1, 0, hashlib.sha256(b"").hexdigest()) for i in (1, None)
    }


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op11_line_dedup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
