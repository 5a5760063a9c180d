"""Run a registered query and its SQL, and compare names, types and values.

As a script: ``python tests/compare.py SF_DIR [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _kind(value) -> str:
    return {bool: "bool", int: "int", float: "float", str: "str"}.get(type(value), type(value).__name__)


def _cell(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def _sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cells = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(cells, key=lambda r: tuple((v is not None, str(v)) for v in r))


def differences(spark, con, name, query, sql, sf_dir) -> tuple[int, list[str]]:
    df = query(spark, sf_dir)
    got_names, got = _sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    want_names, want = _sorted_rows([d[0] for d in cursor.description], cursor.fetchall())
    if got_names != want_names:
        return len(got), [f"columns {got_names} != {want_names}"]
    if len(got) != len(want):
        return len(got), [f"rows {len(got)} != {len(want)}", f"first {got[:1]} {want[:1]}"]
    problems = []
    for i, column in enumerate(got_names):
        kinds = {_kind(r[i]) for r in got if r[i] is not None} ^ {_kind(r[i]) for r in want if r[i] is not None}
        if kinds:
            problems.append(f"{column}: types differ {kinds}")
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        problems.append(f"{len(bad)} rows differ, columns {got_names}, first {bad[0]}")
    return len(got), problems


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from trialloom.session import local_session

    sf_dir, chosen = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), connect(sf_dir)
    every, oracles = queries(), oracle_sql()
    failed = 0
    for name in chosen or every:
        begun = time.time()
        try:
            if name in oracles:
                rows, problems = differences(spark, con, name, every[name], oracles[name], sf_dir)
                state = "ok" if not problems else "DIFF " + "; ".join(problems)[:1200]
            else:
                rows, problems = len(every[name](spark, sf_dir).collect()), []
                state = "rows only"
        except Exception as error:  # noqa: BLE001
            rows, problems, state = -1, [error], "ERROR " + str(error)[:1500]
        failed += bool(problems)
        print(f"{name:28s} {time.time() - begun:6.2f}s {rows:7d} rows  {state}", flush=True)
    print("failed:", failed)
