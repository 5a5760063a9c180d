"""Passages within the edit budget against a plain dynamic programme over all items and texts."""

from random import Random

import pytest

from trialloom.llm import decontaminate

ITEMS = "item_id long, text string"


def plain_distance(pattern, text):
    """Smallest edit distance of the pattern to any part of the text, by the textbook table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def edited(text, n, draw):
    cells = list(text)
    for _ in range(n):
        at = draw.randrange(len(cells))
        kind = draw.randrange(3)
        if kind == 0:
            cells[at] = draw.choice("abcdexyz ")
        elif kind == 1:
            cells.insert(at, draw.choice("abcdexyz "))
        elif len(cells) > 1:
            del cells[at]
    return "".join(cells)


def made(seed):
    draw = Random(seed)
    word = lambda: "".join(draw.choice("abcde") for _ in range(draw.randint(1, 6)))
    items = [" ".join(word() for _ in range(draw.randint(1, 25))) for _ in range(12)] + ["aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    texts = []
    for n in range(60):
        body = [word() for _ in range(draw.randint(0, 60))]
        if n % 3:
            body.insert(draw.randint(0, len(body)), edited(draw.choice(items), draw.randint(0, 9), draw))
        texts.append(" ".join(body).upper() if n % 7 == 0 else "  ".join(body))
    return items, texts + ["a" * 500, "ab" * 300]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hits_equal_plain_search(seed):
    items, texts = made(seed)
    finder = decontaminate.Finder(items, 0.08)
    for text in texts:
        want = {}
        flat = decontaminate.plain(text)
        for i, item in enumerate(finder.items):
            d = plain_distance(item, flat)
            if d <= int(len(item) * 0.08):
                want[i] = d
        got = finder.hits(text)
        assert {h[0]: h[1] for h in got} == want
        for item, distance, first, last in got:
            assert decontaminate.least_distance(decontaminate.masks(finder.items[item]), len(finder.items[item]), flat[first:last])[0] == distance
            part = decontaminate.masks(flat[first:last])
            assert abs((last - first) - len(finder.items[item])) <= distance and part is not None


def test_columns_and_edges(spark):
    passage = "this is a sentence of the benchmark that must not be trained on"
    rows = [(1, f"x y {passage} z"), (1, f"x y {passage} z"), (2, None), (3, ""), (4, passage.upper().replace(" ", "\n \t")), (None, passage)]
    rows += [(5, "clean words only"), (6, "long " * 200_000 + passage.replace("must", "mast"))]
    docs = spark.createDataFrame([(*r, 0, "e") for r in rows], "doc_id long, text string, item_id int, distance string")
    items = spark.createDataFrame([(9, passage), (9, passage), (10, None), (11, " "), (None, "entirely other words of a test")], ITEMS)
    for letters in (1 << 21, 40):
        got = sorted(map(tuple, decontaminate.contaminated(docs, items, letters=letters).collect()), key=str)
        assert [r[:3] for r in got] == sorted([(1, 9, 0), (1, 9, 0), (4, 9, 0), (None, 9, 0), (6, 9, 1)], key=str)
        assert all(r[4] - r[3] == len(passage) for r in got)
        kept = decontaminate.keep_clean(docs, items, letters=letters)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 5]
    assert decontaminate.contaminated(docs, items.limit(0)).collect() == []
    assert decontaminate.keep_clean(docs, items.limit(0)).count() == len(rows)
    assert decontaminate.contaminated(docs.limit(0), items).collect() == []


def test_query_finds_every_exact_passage(spark):
    from trialloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    items = dict(spark.read.parquet(f"{sf}/benchmark.parquet").collect())
    got = {(r.doc_id, r.item_id): r.distance for r in QUERIES["op5_decontamination"](spark, sf).collect()}
    want = {(d, i) for d, t in texts.items() for i, p in items.items() if decontaminate.plain(p) in decontaminate.plain(t)}
    assert want and {x for x, n in got.items() if n == 0} == want
