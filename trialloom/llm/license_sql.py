"""The licence scan of documents in DuckDB SQL."""

from __future__ import annotations

from trialloom.llm.licenses import TEMPLATES, THRESHOLD, WORD

_VALUES = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(TEMPLATES))


def _words(column: str) -> str:
    return f"regexp_extract_all(lower({column}), '{WORD}')"


LICENSE_SQL = f"""
WITH files AS (
  SELECT doc_id, text, coalesce(source, '') || '/' || (doc_id // 1000) || '/' || (doc_id // 50) || '/' || doc_id || '.txt' path
  FROM documents),
known(template, license, text) AS (VALUES {_VALUES}),
terms AS MATERIALIZED (
  SELECT template, license, term, count(*) tf
  FROM (SELECT template, license, unnest({_words('text')}) term FROM known) GROUP BY ALL),
size_of AS MATERIALIZED (SELECT count(*) n FROM files),
rare AS MATERIALIZED (
  SELECT term, ln((CAST(n AS DOUBLE) + 1) / (count(*) + 1)) + 1 idf
  FROM (SELECT unnest(list_distinct({_words('text')})) term FROM files) JOIN size_of ON true
  GROUP BY term, n),
ideal AS MATERIALIZED (
  SELECT template, license, term, tf * coalesce(idf, ln(CAST(n AS DOUBLE) + 1) + 1) w
  FROM terms LEFT JOIN rare USING (term) JOIN size_of ON true),
lengths AS MATERIALIZED (SELECT template, sqrt(sum(w * w)) template_norm FROM ideal GROUP BY template),
named AS MATERIALIZED (SELECT path, text FROM files WHERE path IS NOT NULL),
cut AS (SELECT path, string_split(text, chr(10)) parts FROM named),
lines AS (SELECT path, unnest(range(len(parts))) line, unnest(parts) part FROM cut),
units AS (
  SELECT path, line, part FROM lines
  UNION ALL SELECT path, -1, text FROM named),
vectors AS MATERIALIZED (
  SELECT path, line, term, tf * coalesce(idf, ln(CAST(n AS DOUBLE) + 1) + 1) w
  FROM (SELECT path, line, term, count(*) tf
        FROM (SELECT path, line, unnest({_words('part')}) term FROM units) GROUP BY ALL)
  LEFT JOIN rare USING (term) JOIN size_of ON true),
norms AS (SELECT path, line, sqrt(sum(w * w)) norm FROM vectors GROUP BY ALL),
dots AS (
  SELECT path, line, template, license, sum(v.w * i.w) dot
  FROM vectors v JOIN ideal i USING (term) GROUP BY ALL),
close AS MATERIALIZED (
  SELECT path, line, license, round(dot / (norm * template_norm), 6) cosine
  FROM dots JOIN norms USING (path, line) JOIN lengths USING (template)
  WHERE round(dot / (norm * template_norm), 6) >= {THRESHOLD}),
own AS (SELECT path, license, cosine FROM close
        QUALIFY row_number() OVER (PARTITION BY path ORDER BY cosine DESC, license) = 1),
holders AS MATERIALIZED (
  SELECT regexp_replace(path, '/[^/]*$', '') dir, license, cosine FROM close WHERE line = -1
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, license) = 1),
near AS (
  SELECT path, h.dir from_dir, h.license, h.cosine
  FROM files JOIN holders h ON starts_with(path, h.dir || '/')
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY length(h.dir) DESC) = 1)
SELECT doc_id, f.path, coalesce(o.license, n.license) license,
  CASE WHEN o.path IS NOT NULL THEN 'own' WHEN n.path IS NOT NULL THEN 'inherited' ELSE 'none' END AS "found",
  coalesce(o.cosine, n.cosine) cosine, CASE WHEN o.path IS NULL THEN n.from_dir END AS from_dir
FROM files f LEFT JOIN own o USING (path) LEFT JOIN near n USING (path)
"""
