"""Scores do not depend on how many indexes a benchmark is split into."""

from __future__ import annotations

import random

from granary.llm import decontam


def test_parts_score_like_one_index(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.choice((1, 2, 3))))
    items = [(i, " ".join(word() for _ in range(rng.randint(5, 40))) + "? " + " ".join(word() for _ in range(rng.randint(2, 20)))) for i in range(60)] + [(98, ""), (99, None)]
    docs = [(i, " ".join(word() for _ in range(50)) + " " + items[i % 60][1] + " " + " ".join(word() for _ in range(20))) for i in range(90)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = lambda: sorted((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in decontam.find_leaks(d, b).collect())
    one = found()
    monkeypatch.setattr(decontam, "INDEX_CHARS", 700)
    assert len(one) >= 90 and found() == one
