"""Language identification: held-out accuracy and the defined cases."""

from __future__ import annotations

from conftest_llm import EDGES
from pyspark.sql import functions as F
from regframe.llm import langid, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op3_language_id(spark, sf)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", F.length("text").alias("n"))
    rows = got.join(docs, "doc_id").where("held_out and n > 40").collect()
    right = sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows)
    assert len(rows) > 150 and right > 0.97, right
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_families_and_edges(spark, make_docs, documents):
    model = langid.train(documents)
    assert 1 < len(set(model.family.values())) < 4 and set(model.family) == {"en", "de", "fr", "es"}
    docs = make_docs([*EDGES, "12 34 !?", "ال"])
    got = {r["doc_id"]: r for r in langid.predict(docs, model).select("row.doc_id", "lang_pred", "score").collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 2, 9)] == ["und"] * 4
    assert got[10]["lang_pred"] != "und" and got[7]["score"] == got[8]["score"]


def test_no_labels_one_label_empty(spark, make_docs):
    none = make_docs([("the text", None, "s")])
    assert [r[0] for r in langid.predict(none, langid.train(none)).select("lang_pred").collect()] == ["und"]
    one = make_docs([("the text of it", "en", "s")] * 8)
    assert {r[0] for r in langid.predict(one, langid.train(one)).select("lang_pred").collect()} == {"en"}
    empty = make_docs([])
    assert langid.predict(empty, langid.train(empty)).count() == 0


def test_rerun_agrees(spark, documents):
    a, b = langid.train(documents), langid.train(documents.repartition(7))
    for k, (_, _, w) in a.levels.items():
        assert abs(w - b.levels[k][2]).max() < 1e-6 if w.size else True
