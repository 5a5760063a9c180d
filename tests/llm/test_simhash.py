"""Fingerprints and groups against brute force."""

import re
from random import Random

import numpy as np
import pytest
import xxhash

from trialloom.llm import simhash
from trialloom.llm.graph import components

SCHEMA = "doc_id long, text string"


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius=4):
    """Component (smallest id) of each id, by comparing all pairs."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[:x]:
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_fingerprint_matches_plain_python():
    draw = Random(5)
    texts = ["", None, " \n\t", "One", "one TWO three", "É é\x0bA\x1cB c d", "x " * 9]
    texts += [" ".join(draw.choice("abcdefgh") * draw.randint(1, 3) for _ in range(n)) for n in (4, 5, 50, 900)]
    for text in texts:
        got = simhash.fingerprint(None if text is None else text.encode()) % 2**64
        assert got == plain_fingerprint(text), text


def test_long_texts_are_read_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000))
    whole = simhash.fingerprint(text.encode())
    cut = simhash.word_blocks
    monkeypatch.setattr(simhash, "word_blocks", lambda data: cut(data, 64))
    assert simhash.fingerprint(text.encode()) == whole == np.int64(np.uint64(plain_fingerprint(text)))


@pytest.mark.parametrize("tree", [4096, 5])
def test_links_join_exactly_what_all_pairs_join(spark, tree):
    draw = Random(11)
    prints = {}
    for i in range(300):
        value = draw.getrandbits(64)
        for _ in range(draw.choice([1, 1, 1, 6, 20])):
            prints[len(prints)] = value
            for _ in range(draw.randint(1, 5)):
                value ^= 1 << draw.randrange(64)
    distinct = {v: k for k, v in reversed(prints.items())}
    rows = [(v - (v >> 63 << 64), k) for v, k in distinct.items()]
    links = simhash.similar_links(spark.createDataFrame(rows, "print long, node long"), tree=tree)
    roots = dict(components(links).collect())
    want = plain_groups({k: v for v, k in distinct.items()})
    assert {k: roots.get(k, k) for k in want} == want


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 200)] + [(7, 7), (None, 3)]
    roots = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert roots == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 200)}}


def test_edges_and_repeats(spark):
    rows = [(3, "a b c d e"), (2, "A b  C d e"), (2, "A b  C d e"), (9, None), (8, ""), (None, "a b c d e")]
    rows += [(None, "alone here"), (5, "q w e r t z u i o p")]
    docs = spark.createDataFrame([(*r, r[0], 1) for r in rows], SCHEMA + ", node long, component_id int")
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    same, other = f"{plain_fingerprint('a b c d e'):016x}", f"{plain_fingerprint('alone here'):016x}"
    fifth = f"{plain_fingerprint('q w e r t z u i o p'):016x}"
    want = [(3, same, 2), (2, same, 2), (2, same, 2), (None, same, 2), (None, other, None), (5, fifth, 5)]
    assert got == sorted(want + [(9, "0" * 16, 8), (8, "0" * 16, 8)], key=str)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.where("doc_id is not null").collect()) == [2, 5, 8]


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert simhash.keep_one(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_matches_brute_force(spark):
    from trialloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    groups = plain_groups(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op1_simhash_neardup"](spark, sf).collect()}
    assert got == {i: (f"{prints[i]:016x}", groups[i]) for i in texts}
