"""Benchmark passages in documents, found within an edit budget by the pigeonhole principle.

An item with budget k is cut into k + 1 pieces. Any passage within k edits of it holds at least
one piece unchanged, so one Aho-Corasick pass over a document finds every place worth a look.
The places of an item are merged to windows, and Myers' bit-parallel algorithm gives the exact
smallest edit distance in each, so periodic texts cost no more than one pass for an item.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.llm.texts import pieces

#: Edits allowed for each letter of an item, and the letters of items matched in one pass.
RATE, PASS_LETTERS = 0.08, 1 << 21
HIT = "array<struct<item: int, distance: int, first: int, last: int>>"


def plain(text: str | None) -> str:
    """Lower case, with one blank for every run of white space and none at the ends."""
    found = (" ".join(p.lower().split()) for p in pieces(text or ""))
    return " ".join(p for p in found if p)


def masks(pattern: str) -> dict[str, int]:
    found: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        found[c] |= 1 << i
    return dict(found)


def least_distance(mask: dict[str, int], m: int, text: str, bound: bool = False) -> tuple[int, int]:
    """Smallest edit distance of a pattern to a part of ``text``, and the first end that has it.

    With ``bound`` the part has to begin where the text begins.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for at, c in enumerate(text, 1):
        equal = mask.get(c, 0)
        vertical = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        up = minus | ~(across | plus) & full
        down = plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) | bound
        down <<= 1
        plus = (down | ~(vertical | up)) & full
        minus = up & vertical
        if score < best:
            best, end = score, at
    return best, end


class Finder:
    """Items ready to be looked for: pieces in an automaton, masks for verification."""

    def __init__(self, items: list[str], rate: float) -> None:
        self.items = [plain(x) for x in items]
        self.budget = [int(len(x) * rate) for x in self.items]
        self.masks: dict[int, tuple[dict, dict]] = {}
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, (text, k) in enumerate(zip(self.items, self.budget)):
            cuts = [len(text) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    places[text[a:b]].append((i, b))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, found)
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """For each item the merged parts of the text that may hold it."""
        found: dict[int, list[list[int]]] = defaultdict(list)
        for end, places in self.automaton.iter(text):
            for item, inside in places:
                first = end + 1 - inside - self.budget[item]
                last = end + 1 - inside + len(self.items[item]) + self.budget[item]
                held = found[item]
                # pieces end in order, but later pieces of an item begin their windows earlier
                while held and first <= held[-1][1]:
                    low, high = held.pop()
                    first, last = min(first, low), max(last, high)
                held.append([first, last])
        return found

    def hits(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, distance, first, last) of every item within its budget, at its best place.

        ``first`` and ``last`` bound the passage in the plain text, the last letter not included;
        of places with the same distance the first one is given.
        """
        if self.empty or not text:
            return []
        text, found = plain(text), []
        for item, windows in sorted(self.windows(text).items()):
            pattern, m = self.items[item], len(self.items[item])
            if item not in self.masks:
                self.masks[item] = masks(pattern), masks(pattern[::-1])
            there, back = self.masks[item]
            best, last = m + 1, 0
            for a, b in windows:
                a = max(a, 0)
                distance, end = least_distance(there, m, text[a:b])
                if distance < best:
                    best, last = distance, a + end
                if best == 0:
                    break
            if best <= self.budget[item]:
                before = text[max(0, last - m - best) : last]
                found.append((item, best, last - least_distance(back, m, before[::-1], True)[1], last))
        return found


_loaded: dict[str, Finder] = {}


class Matcher:
    """A bounded list of items as Spark columns; the list is broadcast."""

    def __init__(self, spark: SparkSession, items: list[str], rate: float) -> None:
        content = pickle.dumps((items, rate))
        name, held = hashlib.sha256(content).hexdigest(), spark.sparkContext.broadcast(content)

        def load() -> Finder:
            if name not in _loaded:
                _loaded.clear()
                _loaded[name] = Finder(*pickle.loads(held.value))
            return _loaded[name]

        self.load = load

    def hits(self, text: Column) -> Column:
        load = self.load

        @F.arrow_udf(HIT)
        def column(texts: pa.Array) -> pa.Array:
            names = ("item", "distance", "first", "last")
            found = [[dict(zip(names, h)) for h in load().hits(x)] for x in texts.to_pylist()]
            return pa.array(found, pa.list_(pa.struct([(n, pa.int32()) for n in names])))

        return column(text)


def _passes(benchmark: DataFrame, letters: int) -> list[list[tuple]]:
    """Items in groups of about ``letters`` letters; a benchmark of any size is matched group by group."""
    items = benchmark.selectExpr("item_id", "text").where("trim(text) != ''")
    total = items.selectExpr("sum(length(text))").first()[0] or 0
    groups = max(1, -(-total // letters))
    for g in range(groups):
        yield sorted((tuple(r) for r in items.where(f"pmod(xxhash64(text), {groups}) = {g}").distinct().collect()), key=str)


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, letters: int = PASS_LETTERS) -> DataFrame:
    """doc_id, item_id, distance, first and last of every item found in every document.

    Case and runs of white space are ignored; ``first`` and ``last`` count letters of the text
    without them. Distances are the smallest in the document. Null or blank texts hold nothing and
    null or blank items are never found; a repeated row gives its rows again, a repeated item
    counts once; a null doc_id or item_id is passed on. Other columns are not read. Empty tables
    give an empty table.
    """
    spark, found = docs.sparkSession, None
    for group in _passes(benchmark, letters):
        matcher = Matcher(spark, [text for _, text in group], rate)
        kind = benchmark.schema["item_id"].dataType
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(group)], f"item int, item_id {kind.simpleString()}")
        rows = docs.select("doc_id", F.explode(matcher.hits(F.col("text"))).alias("hit")).select("doc_id", "hit.*")
        rows = rows.join(F.broadcast(names), "item").select("doc_id", "item_id", "distance", "first", "last")
        found = rows if found is None else found.unionAll(rows)
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, letters: int = PASS_LETTERS) -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item; columns stay as they are."""
    for group in _passes(benchmark, letters):
        matcher = Matcher(docs.sparkSession, [text for _, text in group], rate)
        docs = docs.where(F.size(matcher.hits(F.col("text"))) == 0)
    return docs
