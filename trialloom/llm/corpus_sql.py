"""Line dedup, prefix tree and Merkle manifest in DuckDB SQL."""

from __future__ import annotations

from trialloom.llm.line_runs import LEAST_CHARS, LEAST_DOCS
from trialloom.llm.merkle import FAN, FIELDS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit."""
    codes = f"list_transform(range(length({text})), lambda i: CAST(ascii(({text})[i + 1]) AS BIGINT))"
    bit = "CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: {bit})"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda a, b: {byte}), 4294967295)"


LINES_SQL = f"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) parts FROM documents),
lines AS (SELECT doc_id, unnest(range(len(parts))) pos, unnest(parts) line FROM cut),
keyed AS (SELECT *, translate(trim(line, {_BLANKS}), '{_UPPER}', '{_LOWER}') line_key FROM lines),
often AS (
  SELECT line_key, max(doc_id) AS owner FROM keyed WHERE length(line_key) >= {LEAST_CHARS}
  GROUP BY line_key HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
marked AS (SELECT k.*, coalesce(k.doc_id <> o.owner, false) gone FROM keyed k LEFT JOIN often o USING (line_key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

TRIE_SQL = f"""
WITH own AS (
  SELECT conv_id c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) p,
         coalesce(role, '') role, coalesce(text, '') text FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % 5 base, {crc32("CAST(c AS VARCHAR)")} % 9 h FROM (SELECT DISTINCT c FROM own) x),
pieces AS (
  SELECT v.c, 0 part, o.p, o.role, o.text FROM convs v JOIN own o ON o.c = v.base AND o.p <= v.h
  UNION ALL SELECT v.c, 1, o.p, o.role, o.text FROM convs v JOIN own o ON o.c = v.c AND o.p > v.h),
turns AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, p) d, md5(role) || md5(text) item, strlen(text) bytes FROM pieces),
prefixes AS (
  SELECT c, d, bytes, string_agg(item, ',') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) path FROM turns
  UNION ALL SELECT c, 0, 0, '' FROM convs),
lengths AS (SELECT c, max(d) n FROM prefixes GROUP BY c),
nodes AS (
  SELECT d, path, min(c) c, count(*) n_convs, any_value(bytes) bytes,
    string_agg(CASE WHEN n = d THEN CAST(c AS VARCHAR) END, ',' ORDER BY c) ends
  FROM prefixes JOIN lengths USING (c) GROUP BY d, path),
linked AS (
  SELECT x.*, p.path parent_path, p.c parent_c
  FROM nodes x LEFT JOIN nodes p ON p.d = x.d - 1 AND p.path = CASE WHEN x.d = 1 THEN '' ELSE left(x.path, length(x.path) - 65) END),
below AS (SELECT d + 0 pd, parent_path, count(*) n FROM linked WHERE d > 0 GROUP BY ALL),
counted AS (SELECT l.*, coalesce(b.n, 0) n_children FROM linked l LEFT JOIN below b ON b.pd = l.d + 1 AND b.parent_path = l.path),
sums AS (
  SELECT a.d, a.path, count(*) FILTER (x.n_children = 0) n_leaves, sum((x.n_convs - 1) * x.bytes) saved
  FROM counted a JOIN counted x ON x.d >= a.d AND (a.path = '' OR x.path = a.path OR starts_with(x.path, a.path || ',')) GROUP BY ALL)
SELECT CAST(c AS BIGINT) conv_id, CAST(d AS BIGINT) AS depth, CAST(parent_c AS BIGINT) parent_conv_id, n_convs, n_children,
  n_leaves, CAST(saved AS BIGINT) saved_tokens, sha256(coalesce(ends, '')) ends_sha256
FROM counted JOIN sums USING (d, path)
"""


def _folds(leaves: str, name: str, order: str, levels: int) -> str:
    """CTEs of a tree: digests of each level, and of each leaf its place, proof and path.

    ``leaves`` has part, digest and what ``order`` sorts by; ``levels`` suffices for any table.
    """
    made = [
        f"""{name}0 AS (
  SELECT *, row_number() OVER (PARTITION BY part ORDER BY {order}) - 1 i, count(*) OVER (PARTITION BY part) n FROM {leaves}),
{name}n0 AS (SELECT part, i, n, digest FROM {name}0)"""
    ]
    for k in range(1, levels + 1):
        made.append(
            f"""{name}n{k} AS (
  SELECT part, i // {FAN} i, n, sha256(string_agg(digest, '' ORDER BY i)) digest
  FROM {name}n{k - 1} WHERE n > {FAN ** (k - 1)} GROUP BY part, i // {FAN}, n)"""
        )
        made.append(
            f"""{name}s{k} AS (
  SELECT a.part, a.i, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i < a.i), '') l,
         coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i > a.i), '') r
  FROM {name}n{k - 1} a JOIN {name}n{k - 1} b ON a.part IS NOT DISTINCT FROM b.part AND a.i // {FAN} = b.i // {FAN}
  WHERE a.n > {FAN ** (k - 1)} GROUP BY a.part, a.i)"""
        )
    tops = " UNION ALL ".join(
        f"SELECT part, digest FROM {name}n{k} WHERE i = 0 AND n <= {FAN ** k}" for k in range(levels + 1)
    )
    return ",\n".join([*made, f"{name}top AS ({tops})"])


def _climb(name: str, rows: str, levels: int, out: str) -> str:
    """CTEs that carry ``proof`` and ``cur`` of rows (part, i, n and more) up the levels of a tree."""
    made, now = [], rows
    for k in range(1, levels + 1):
        made.append(
            f"""{out}{k} AS (
  SELECT x.* REPLACE (proof || coalesce(s.l, '') || coalesce(s.r, '') AS proof,
    CASE WHEN s.i IS NULL THEN cur ELSE sha256(s.l || cur || s.r) END AS cur)
  FROM {now} x LEFT JOIN {name}s{k} s ON s.part IS NOT DISTINCT FROM x.part AND s.i = x.i // {FAN ** (k - 1)})"""
        )
        now = f"{out}{k}"
    return ",\n".join(made)


def _digest(*fields: str) -> str:
    def part(x: str) -> str:
        return f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"

    return f"sha256({' || '.join(map(part, fields))})"


#: Levels of the languages' trees and of the tree over them: enough for 8^8 and 8^4 leaves.
_DEEP, _TOP = 8, 4

MERKLE_SQL = f"""
WITH tampered AS (
  SELECT *, CASE WHEN {crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN translate(text, '{_UPPER}', '{_LOWER}') ELSE text END other
  FROM documents),
leaves AS (SELECT doc_id, lang part, {_digest(*FIELDS)} digest, {_digest(*FIELDS[:-1], 'other')} claimed FROM tampered),
{_folds("leaves", "a", "doc_id NULLS FIRST, digest", _DEEP)},
subroots AS (SELECT 0 part, part lang, digest FROM atop),
{_folds("subroots", "b", "lang NULLS FIRST", _TOP)},
started AS (SELECT *, '' proof, claimed cur FROM a0),
{_climb("a", "started", _DEEP, "u")},
joined AS (
  SELECT x.doc_id, x.digest leaf, x.proof, x.cur, b.part, b.i, b.n, b.digest subroot, t.digest root
  FROM u{_DEEP} x JOIN b0 b ON x.part IS NOT DISTINCT FROM b.lang JOIN btop t ON true),
{_climb("b", "joined", _TOP, "v")}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified FROM v{_TOP}
"""
