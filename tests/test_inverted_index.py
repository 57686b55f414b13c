"""The registered index holds rare postings too."""

from __future__ import annotations

from types import SimpleNamespace

from granary.plans import queries
from granary.plans.catalog import SCHEMAS


def test_every_posting_is_returned(spark, monkeypatch):
    block = spark.createDataFrame([("A", "text", 0, "rare Word word " + "the " * 25), ("B", "text", 0, "rare")], SCHEMAS["text_block"])
    monkeypatch.setattr(queries.cat, "from_documents", lambda s, d: SimpleNamespace(text_block=block))
    got = {tuple(r) for r in queries.QUERIES["inverted_index"](spark, "").collect()}
    assert got == {("A", "rare", 1, 28), ("A", "word", 2, 28), ("A", "the", 25, 28), ("B", "rare", 1, 1)}


def test_no_word_is_shuffled(spark, monkeypatch):
    block = spark.createDataFrame([("A", "text", 0, "the " * 25)], SCHEMAS["text_block"])
    monkeypatch.setattr(queries.cat, "from_documents", lambda s, d: SimpleNamespace(text_block=block))
    got = queries.QUERIES["inverted_index_heavy"](spark, "")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString() and [tuple(r) for r in got.collect()] == [("A", "the", 25, 25)]
