"""Languages by compression: held-out accuracy, and edges."""

import zlib

from pyspark.sql import functions as F

from trialloom.llm import langid

SCHEMA = "doc_id long, text string, lang string"


def is_held_out(doc_id, divisor, value):
    return zlib.crc32(str(doc_id).encode()) % divisor == value


def test_held_out_accuracy(spark):
    from trialloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    langs = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect())
    rows = QUERIES["op7_langid"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(langs)
    assert all(r.held_out == is_held_out(r.doc_id, 4, 2) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    known = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == langs[r.doc_id] for r in known) >= 0.97 * len(known)


def test_edges(spark):
    rows = [(i, f"{w} {w} {i}", lang) for i in range(60) for w, lang in (("the small house", "en"), ("das kleine haus", "de"))]
    rows += [(500, None, "en"), (501, "", "de"), (502, "12 !? \n", None), (None, "the small house", "fr"), (503, "das kleine haus " * 9, None)]
    rows += [(503, "das kleine haus " * 9, None)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", score int, lang_pred string")
    got = langid.identified(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i in (500, 501, 502):
        assert tuple(by_id[i])[2:] == ("und", 0.0, False)
    assert by_id[503].lang_pred == "de" and by_id[503].accepted
    assert {r.lang_pred for r in got} == {"en", "de", "und"}  # a row without doc_id teaches nothing
    assert not by_id[None].held_out
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.where("doc_id in (500, 501, 502)").count() == 0
    assert kept.where("doc_id = 503").count() == 2
    assert langid.identified(docs.limit(0)).collect() == []
    assert {r.lang_pred for r in langid.identified(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_ties_and_margins():
    model = langid.Model([("b", b"same words here"), ("a", b"same words here")])
    assert model.predict("same words here") == ("b", 0.5, False)
    whole = model.predict("words " * 4000)
    assert whole[:2] == ("b", 0.5)
    one = langid.Model([("x", b"abc")])
    assert one.predict("abc abc")[0] == "x" and one.predict(None) == ("und", 0.0, False)


def test_whole_text_counts():
    """A long text is judged by all its frames, not by its start."""
    en, de = b"the and of that this with from house small " * 50, b"das und von dass dieses mit aus haus klein " * 50
    model = langid.Model([("en", en), ("de", de)])
    mixed = "the and of that this with from house small " * 20 + "das und von dass dieses mit aus haus klein " * 60
    assert model.predict(mixed)[0] == "de"
