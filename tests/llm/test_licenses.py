"""Licences of files against SQL and against cosines worked out in plain Python."""

import math
import re
from collections import Counter

import pytest

from trialloom.llm import licenses

APACHE, MIT = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."


def test_query_matches_sql(spark):
    from tests.compare import connect, differences
    from trialloom.llm.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.01"
    rows, problems = differences(spark, connect(sf), "op9", QUERIES["op9_license_scan"], ORACLES["op9_license_scan"], sf)
    assert rows == 1000 and not problems


def plain_own(files, threshold=licenses.THRESHOLD):
    """Best licence of each path over all its lines and its whole text, without any filter."""
    words = lambda t: re.findall(licenses.WORD, t.lower())
    n, df = len(files), Counter()
    for _, text in files:
        df.update(set(words(text or "")))
    idf = lambda w: math.log((n + 1) / (df[w] + 1)) + 1
    vector = lambda t: {w: c * idf(w) for w, c in Counter(words(t)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    best = {}
    for path, text in files:
        for part in [*(text or "").split("\n"), text or ""]:
            v = vector(part)
            for name, t in licenses.TEMPLATES:
                u = vector(t)
                cosine = round(sum(x * u.get(w, 0) for w, x in v.items()) / (norm(v) * norm(u)), 6) if v else 0
                if cosine >= threshold:
                    best[path] = min(best.get(path, (1, "")), (-cosine, name))
    return best


def test_own_licences_match_plain_cosines(spark):
    texts = [t for _, t in licenses.TEMPLATES]
    texts += [t.upper() + " extra words" for t in texts] + ["# " + t.replace("the", "a") for t in texts]
    texts += ["under the version 3 general public", "some prose\n" + MIT + "\nmore", "license", "free software the this is", None, ""]
    files = [(f"d{i % 3}/f{i}.txt", t) for i, t in enumerate(texts)] + [(f"e/{i}", f"w{i} the and of is") for i in range(200)]
    got = licenses.scan(spark.createDataFrame(files, "path string, text string")).where("found = 'own'").collect()
    want = plain_own(files)
    assert {r.path: (r.license, r.cosine) for r in got} == {p: (name, pytest.approx(-c)) for p, (c, name) in want.items()}


def test_nearest_directory_and_edges(spark):
    prose = "plain prose without any notice " * 3
    rows = [
        ("a/LICENSE", APACHE), ("a/b/c/LICENSE", MIT), ("a/x.txt", prose), ("a/b/x.txt", prose), ("a/b/c/d/x.txt", prose),
        ("ab/x.txt", prose), ("top.txt", prose), ("a/b/own.txt", prose + "\n" + MIT), ("a/null.txt", None), ("a/empty.txt", ""),
        (None, prose), (None, MIT), ("a/x.txt", prose), ("a/long.txt", "word " * 100_000),
    ]
    files = spark.createDataFrame([(*r, "l", 1.0, "f") for r in rows], "path string, text string, license string, cosine double, dir string")
    got = licenses.scan(files).collect()
    assert len(got) == len(rows)
    of = {r.path: (r.license, r.found, r.from_dir) for r in got}
    assert of["a/LICENSE"] == ("Apache-2.0", "own", None) and of["a/b/own.txt"] == ("MIT", "own", None)
    for path in ("a/x.txt", "a/b/x.txt", "a/null.txt", "a/empty.txt", "a/long.txt"):
        assert of[path] == ("Apache-2.0", "inherited", "a")
    assert of["a/b/c/d/x.txt"] == ("MIT", "inherited", "a/b/c")
    assert of["ab/x.txt"] == of["top.txt"] == of[None] == (None, "none", None)
    root = licenses.scan(spark.createDataFrame([("LICENSE", MIT), ("a/b.txt", prose)], "path string, text string"))
    assert {r.path: (r.license, r.from_dir) for r in root.collect()} == {"LICENSE": ("MIT", None), "a/b.txt": ("MIT", "")}
    assert licenses.scan(files.limit(0)).collect() == []


def test_words_outside_templates_weigh_by_their_own_files(spark):
    text = "Released under the MIT License. en de fr"
    files = [("a/LICENSE", text)] + [(f"b/{i}", "en de fr") for i in range(200)]
    got = licenses.scan(spark.createDataFrame(files, "path string, text string")).where("found = 'own'").collect()
    rare, common = math.log(202 / 2) + 1, 1.0  # the notice's words are in one file, the others in all 201
    want = round(5 * rare**2 / (math.sqrt(5 * rare**2 + 3 * common**2) * math.sqrt(5 * rare**2)), 6)
    assert {r.path: (r.license, r.cosine) for r in got} == {"a/LICENSE": ("MIT", pytest.approx(want))}
