"""The pipeline against a plain version of each stage on the rows the stage before kept."""

import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_simhash import plain_fingerprint, plain_groups
from trialloom.llm import decontaminate, langid, toxicity

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stage(spark, n, docs):
    return corpus_pipeline.STAGES[n][1](spark, docs, SF)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: tuple(r) for r in docs.collect()}

    first = stage(spark, 0, docs)
    model = langid.fit(docs)
    assert first.columns == COLUMNS
    kept = {i: r for i, r in rows.items() if model.predict(r[1])[2]}
    assert {r.doc_id: tuple(r) for r in first.collect()} == kept

    second = stage(spark, 1, first)
    scores = toxicity.fit(first, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {i: r for i, r in kept.items() if scores.score(r[1]) < toxicity.THRESHOLD}
    assert second.columns == COLUMNS and {r.doc_id: tuple(r) for r in second.collect()} == kept

    third = stage(spark, 2, second)
    groups = plain_groups({i: plain_fingerprint(r[1]) for i, r in kept.items()})
    kept = {i: r for i, r in kept.items() if groups[i] == i}
    assert third.columns == COLUMNS and {r.doc_id: tuple(r) for r in third.collect()} == kept

    fourth = stage(spark, 3, third)
    items = [decontaminate.plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r.doc_id: tuple(r) for r in fourth.collect()}
    exact = {i for i, r in kept.items() if any(x in decontaminate.plain(r[1]) for x in items)}
    finder = decontaminate.Finder(items, decontaminate.RATE)
    assert exact and not exact & clean.keys()
    assert clean == {i: r for i, r in kept.items() if not finder.hits(r[1])} and fourth.columns == COLUMNS

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    last = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert last.keys() == clean.keys()
    for i, r in clean.items():
        ids = library.encode(r[1], add_special_tokens=False).ids
        assert last[i].ids == ids and last[i].n_tokens == len(ids)
        assert last[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_edge_rows_pass_all_stages(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "some text", "en", None, 3), (2, "", "en", "s", 0)]
    rows += [(i, f"document number {i} has its own few words {i * i} to say", "en", "s", 9) for i in range(3, 30)] + [
        (i, f"das dokument nummer {i} hat eigene worte {i * i} zu sagen", "de", "s", 9) for i in range(30, 60)
    ]
    docs = spark.createDataFrame(rows + rows[-3:], schema)
    for n, (_, function) in enumerate(corpus_pipeline.STAGES):
        assert function(spark, docs.limit(0), SF).collect() == []
        assert function(spark, docs, SF).count() > 0 or n == 0
