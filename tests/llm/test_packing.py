"""Packed rows against plain best fit, and a lossless way back to the texts."""

import base64
from collections import Counter, defaultdict
from random import Random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from trialloom.llm import packing

PATH, END = P.path("byte_bpe_50k.tiktoken"), 50256


def plain_best_fit(lengths, most):
    rooms, rows = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [(room, r) for r, room in enumerate(rooms) if room >= lengths[i]]
        if fits:
            r = min(fits)[1]
        else:
            r = len(rows)
            rows.append([])
            rooms.append(most)
        rows[r].append(lengths[i])
        rooms[r] -= lengths[i]
    return rows


@pytest.mark.parametrize("most", [1, 7, 100, 128])
def test_best_fit(most):
    draw = Random(most)
    for _ in range(30):
        lengths = [draw.randint(1, most) for _ in range(draw.randint(0, 80))]
        rows = packing.best_fit(lengths, most)
        assert sorted(i for row in rows for i in row) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in row) <= most for row in rows)
        assert len(rows) == len(plain_best_fit(lengths, most))


def reference_ids(texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    code = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return code, [code.encode_ordinary(t or "") + [END] for t in texts]


def whole(packed):
    """Ids of every (doc_id, start) chain, checked row by row."""
    segments = defaultdict(list)
    for r in packed.collect():
        ids = np.frombuffer(r.ids, "<u2")
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= len(ids)
        assert r.resets == r.cu_seqlens[:-1] and len(r.doc_ids) == len(r.doc_starts) == len(r.resets)
        assert (ids[r.n_tokens :] == END).all()
        for i, (a, b) in enumerate(zip(r.cu_seqlens, r.cu_seqlens[1:])):
            segments[r.doc_ids[i]].append((r.doc_starts[i], ids[a:b].tolist()))
    return segments


def test_round_trip_and_edges(spark):
    rows = [(1, "some words " * 90), (2, None), (3, ""), (None, "no id"), (4, "<|endoftext|> é日本"), (5, "x"), (6, " a\n\n b ")]
    docs = spark.createDataFrame([(*r, 0, "p") for r in rows], "doc_id long, text string, n_tokens int, ids string")
    packed = packing.pack(docs, PATH, P.PATTERN, END, length=16, group=50)
    got = whole(packed)
    code, want = reference_ids([t for _, t in rows])
    for (doc_id, text), ids in zip(rows, want):
        joined = [x for start, part in sorted(got[doc_id]) for x in part]
        assert joined == ids and code.decode(joined[:-1]) == (text or "")
        assert [s for s, _ in sorted(got[doc_id])] == list(range(0, len(ids), 16))
    assert packed.count() == packed.select("pack_id").distinct().count()
    back = packing.unpacked(packed).collect()
    assert Counter((r.doc_id, r.start, bytes(r.ids)) for r in back) == Counter(
        (d, s, np.array(p, "<u2").tobytes()) for d, x in got.items() for s, p in x
    )
    twice = packing.pack(docs.unionAll(docs), PATH, P.PATTERN, END, length=16)
    assert sum(r.n_tokens for r in twice.collect()) == 2 * sum(map(len, want))
    assert packing.pack(docs.limit(0), PATH, P.PATTERN, END).collect() == []


def test_positions_start_anew(spark, tmp_path):
    docs = spark.createDataFrame([(i, "word " * (i % 9)) for i in range(40)], "doc_id long, text string").coalesce(1)
    packed = packing.pack(docs, PATH, P.PATTERN, END, length=16)
    packing.write_packed(packed, str(tmp_path / "out"))
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        assert r.position_ids == [i for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]) for i in range(b - a)]


def test_query_is_whole(spark):
    from trialloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = whole(QUERIES["op10_packed_ids"](spark, sf))
    _, want = reference_ids(texts.values())
    assert {d: [x for _, p in sorted(s) for x in p] for d, s in got.items()} == dict(zip(texts, want))


def test_ids_of_long_texts_do_not_depend_on_the_cut():
    """Runs of blanks and line ends around every cut, with cuts at any size."""
    from trialloom.llm import texts

    code, _ = reference_ids([])
    text = "one  two\n\n three   \n four... \n\nfive " * 3 + "x" * 30 + "  \n " + "tail end"
    whole = code.encode(text, disallowed_special=())
    for size in range(1, 40):
        parts = list(texts.word_pieces(text, size))
        assert "".join(parts) == text
        assert [i for p in parts for i in code.encode(p, disallowed_special=())] == whole
