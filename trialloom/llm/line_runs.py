"""Repeated lines found through levelled sorted runs of line hashes, in DataFrame and SQL operations only.

An index of lines is a few runs: tables sorted by a 128-bit hash of the line's key. Documents come in
batches from the largest doc_id down. The keys of a batch, one entry each, merge-anti-join the runs:
what no run holds is new, and the batch's largest doc_id with it is the largest of all, so it owns
the line. The entries then become a run of their own, and as soon as a level has ``FAN`` runs they
are merged into one of the next level, so that few runs are ever open and each key is rewritten
once a level. A last merge of all runs gives how many documents hold each key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.session import new_path, staged

LEAST_CHARS, LEAST_DOCS = 40, 5
BATCHES, FAN = 6, 3
#: Lines in more documents than one in so many of all (line, document) pairs are looked up by
#: broadcast; there can't be more of them than this number.
HOT_KEYS, HOT_DOCS = 10_000, 1_000

BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What a row without doc_id counts as: one document below all others.
_NO_ID = f"cast('{-(1 << 63)}' as bigint)"


class LineRuns:
    """The index: levels of sorted runs, each with h, g, docs and owner, one row for each key."""

    def __init__(self, spark: SparkSession, fan: int = FAN) -> None:
        self.spark, self.fan = spark, fan
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame) -> str:
        path = new_path(self.spark, "line_run")
        rows.select("h", "g", "docs", "owner").sortWithinPartitions("h", "g").write.parquet(path)
        return path

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("h long, g long, docs long, owner long").parquet(*paths)

    def _runs(self) -> list[str]:
        return [path for level in self.levels for path in level]

    def new_keys(self, entries: DataFrame) -> DataFrame:
        """The entries (h, g and more) whose key is in no run."""
        runs = self._runs()
        return entries.join(self._read(runs).select("h", "g"), ["h", "g"], "left_anti") if runs else entries

    def add(self, entries: DataFrame) -> None:
        """Add a batch: h, g, docs and owner, one row for each key.

        Only keys that no run holds keep their owner, so an earlier batch's owner is never replaced.
        """
        if self.levels:
            new = self.new_keys(entries).select("h", "g", "owner")
            entries = entries.drop("owner").join(new, ["h", "g"], "left")
        self._push(self._write(entries), 0)

    def _push(self, path: str, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) == self.fan:
            old, self.levels[level] = self.levels[level], []
            merged = self._write(self._merged(old))
            self._delete(old)
            self._push(merged, level + 1)

    def _merged(self, runs: list[str]) -> DataFrame:
        rows = self._read(runs)
        return rows.groupBy("h", "g").agg(F.sum("docs").alias("docs"), F.max("owner").alias("owner"))

    def totals(self) -> DataFrame:
        """Each key with the documents that hold it and its owner; the index must hold a batch."""
        return self._merged(self._runs())

    def _delete(self, paths: list[str]) -> None:
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)

    def close(self) -> None:
        """Delete all runs; what was read from them and not written is gone."""
        self._delete(self._runs())
        self.levels = []


def line_key(line: str) -> str:
    """SQL for a line without blanks at its ends, A to Z lower-cased (and no other letter)."""
    bare = f"trim(both '{BLANKS}' from {line})"
    plain = f"octet_length({bare}) = char_length({bare})"
    return f"if({plain}, lower({bare}), translate({bare}, '{_UPPER}', '{_LOWER}'))"


def lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc, mark (hash of the text), pos and the two hashes of the key of each line long enough."""
    each = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.expr(_NO_ID)).alias("doc"),
        F.xxhash64("text").alias("mark"),
        F.posexplode(F.split("text", "\n")).alias("pos", "line"),
    )
    keys = each.selectExpr("doc", "mark", "pos", f"{line_key('line')} as line_key")
    long = keys.where(F.char_length("line_key") >= least_chars)
    return long.selectExpr("doc", "mark", "pos", "xxhash64(line_key) as h", "xxhash64(1L, line_key) as g")


def repeated(
    found: DataFrame, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fan: int = FAN
) -> DataFrame:
    """h, g, docs and owner of the keys in at least ``least_docs`` documents; ``found`` as from ``lines``.

    The result doesn't depend on ``batches`` and ``fan``.
    """
    spark = found.sparkSession
    edges = found.agg(F.percentile_approx("doc", [i / batches for i in range(1, batches)])).first()[0] if batches > 1 else []
    edges = sorted({*(edges or [])}, reverse=True)
    later = " ".join(f"when doc > cast('{x}' as bigint) then {i}" for i, x in enumerate(edges))
    batch = f"case {later} else {len(edges)} end" if edges else "0"
    by_doc = found.groupBy("h", "g", "doc").agg(F.lit(1).alias("one"))
    entries = by_doc.groupBy(F.expr(batch).alias("batch"), "h", "g").agg(
        F.count("*").alias("docs"), F.max("doc").alias("owner")
    )
    arriving = new_path(spark, "entries")
    entries.write.partitionBy("batch").parquet(arriving)
    entries = spark.read.schema(entries.schema).parquet(arriving)
    index = LineRuns(spark, fan)
    for i in range(len(edges) + 1):
        index.add(entries.where(F.col("batch") == i).drop("batch"))
    result = staged(index.totals().where(F.col("docs") >= least_docs), "repeated")
    index.close()
    return result


def cut_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Every row of ``docs`` as struct ``doc``, with n_lines, n_dropped and ``kept``, its text without dropped lines.

    Lines are split at line ends; a null or empty text is one empty line. A key is the line
    without blanks at both ends, A to Z lower-cased. Keys of at least ``least_chars`` code points
    in at least ``least_docs`` documents lose all their lines but those of the largest doc_id. Rows of
    one doc_id are one document; rows without doc_id are together one document below all others.
    All lines of the key in the owner stay, equal ones too. Very long texts are handled whole,
    line by line. An empty table gives an empty table; the row's own columns keep their names
    inside ``doc``.
    """
    found = staged(lines(docs, least_chars), "lines")
    gone = repeated(found, least_docs)
    least = max(HOT_DOCS, found.count() // HOT_KEYS)  # found has as many pairs at least, so HOT_KEYS bounds the hot keys
    hot = F.broadcast(gone.where(F.col("docs") > least).select("h", "g", "owner"))
    rest = gone.where(F.col("docs") <= least).select("h", "g", "owner")
    hits = found.join(hot, ["h", "g"]).unionByName(found.join(hot, ["h", "g"], "left_anti").join(rest, ["h", "g"]))
    hits = hits.where("doc != owner")
    cuts = hits.groupBy("doc", "mark").agg(F.sort_array(F.collect_set("pos")).alias("cuts"))
    rows = docs.select(
        F.struct("*").alias("doc"),
        F.coalesce(F.col("doc_id").cast("long"), F.expr(_NO_ID)).alias("own"),
        F.xxhash64("text").alias("mark"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    cuts = cuts.withColumnsRenamed({"doc": "cut_doc", "mark": "cut_mark"})
    joined = rows.join(cuts, F.expr("own = cut_doc and mark = cut_mark"), "left")
    # the runs of lines between two dropped ones, put together again
    start, end = "if(j = 0, 0, cuts[j - 1] + 1)", "if(j = size(cuts), size(parts), cuts[j])"
    pieces = f"transform(sequence(0, size(cuts)), j -> slice(parts, {start} + 1, {end} - {start}))"
    kept = f"if(cuts is null, text, array_join(flatten({pieces}), '\\n'))"
    made = f"transform(array(split(text, '\\n')), parts -> struct(size(parts) as n_lines, {kept} as kept))[0] as made"
    return joined.selectExpr("doc", "cuts", made).selectExpr(
        "doc", "cast(made.n_lines as bigint) as n_lines", "cast(coalesce(size(cuts), 0) as bigint) as n_dropped", "made.kept as kept"
    )


def dedup_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every row."""
    return cut_lines(docs).selectExpr("doc.doc_id as doc_id", "n_lines", "n_dropped", "sha2(kept, 256) as kept_sha256")
