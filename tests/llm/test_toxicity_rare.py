"""Rare n-grams count."""

from __future__ import annotations

from granary.llm import toxicity


def test_word_of_one_document_counts(spark):
    docs = [(i, "the plain words of a text") for i in range(200)]
    lab = [(i, int(i % 2 == 0)) for i in range(200)]
    d, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(lab, "doc_id long, toxic int")
    usable = d.filter(~toxicity.held_out("doc_id")).filter("pmod(xxhash64(doc_id, 'tune'), 4) <> 0 AND doc_id % 2 = 0")
    one = usable.orderBy("doc_id").first()["doc_id"]
    d = d.selectExpr("doc_id", f"IF(doc_id = {one}, text || ' zumpf', text) AS text")
    assert toxicity.fit(d, labels).word("zumpf") > 0
