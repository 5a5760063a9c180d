"""Encoding and decoding against the tokenizers library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trialloom.llm import bpe, texts

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", " \n\t", "Hello, WORLD's 'tis we'll 'VE 1234½", "ΣΑΣ İstanbul ẞ ﬁ é é", "a<|endoftext|>b <|startoftext|><|ENDOFTEXT|>",
    "日本語 emoji 👍🏽👍 ​ x\x85y\x1cz", "z" * 500, "#&*$$%%% | | !!", "rendousjekyll theinging", "x\x00y", "Å 豈",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as file:
        return bpe.Vocabulary(file.read())


def same(own, library, text):
    ids = own.encode(text)
    want = library.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want, text
    assert b"".join(own.decode(ids)).decode() == library.decode(want, skip_special_tokens=False)
    assert b"".join(own.decimal(ids)) == " ".join(map(str, want)).encode()


@pytest.mark.parametrize("text", TEXTS)
def test_texts(own, library, text):
    same(own, library, text)


@settings(max_examples=600, deadline=None)
@given(st.text(st.sampled_from("aeiounthrsd'. é1N👍"), max_size=60))
def test_letters(own, library, text):
    same(own, library, text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8", max_codepoint=0x1FFFF), max_size=40))
def test_any_text(own, library, text):
    same(own, library, text)


def test_every_token_text(own, library):
    for token in library.get_vocab():
        same(own, library, token.removesuffix("</w>") + " " + token)


def test_small_caches_and_pieces(own, library, monkeypatch):
    text = " ".join(f"word{i % 50}x {i}" for i in range(3000))
    monkeypatch.setattr(bpe, "CACHED_WORDS", 7)
    monkeypatch.setattr(bpe, "CACHED_PAIRS", 7)
    monkeypatch.setattr(texts, "PIECE", 100)
    same(own, library, text)


def test_columns(spark):
    rows = [(1, "Some text", 5), (1, "Some text", 5), (None, None, 6), (2, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, bpe.encoded(docs, PATH).collect()), key=str)
    none = hashlib.sha256(b"").hexdigest()
    assert (2, 0, none, none) in got and (None, 0, none, none) in got and got[0] == got[1] and len(got) == 4
    coder = bpe.Coder(spark, PATH)
    back = docs.select(coder.text(coder.ids(docs.text))).collect()
    assert [r[0] for r in back] == ["some</w> text</w>", "some</w> text</w>", "", ""]
    assert bpe.encoded(docs.limit(0), PATH).collect() == []
    with_ids = bpe.encoded(docs, PATH, with_ids=True).where("doc_id = 1").first()
    assert len(with_ids.ids) == with_ids.n_tokens == 2


def test_query(spark, library):
    from trialloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in QUERIES["op8_bpe"](spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_offset_table_in_steps():
    table = bpe.OffsetTable([b"a", b"", b"xyz"])
    assert b"".join(table.join(np.array([2, 1, 0, 2]), 2)) == b"xyzaxyz"
