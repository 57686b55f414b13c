"""The pipeline against plain Python versions of its stages, and on awkward rows."""

from __future__ import annotations

import random

import corpus_pipeline as p
import duckdb
from granary.llm import mixing, secrets
from granary.session import materialize


def _docs(rng):
    say = lambda: " ".join("".join(rng.choice(["the", "ing", "and", "tion", "er"]) for _ in range(rng.randint(1, 4))) for _ in range(60))
    item = "what is the capital of the small island in the north? it is the old harbour town by the bay"
    texts = [say() for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 4}") for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i], "en", "s1") for i in range(10)]  # copies
    rows += [(200 + i, say() + " " + item, "en", "s2") for i in range(5)]  # leaks
    rows += [(300, say() + ' password = "abc123def456" ', "en", "s3"), (400, "", "en", "s1"), (401, "### 123", "en", "s1"), (402, None, None, None)]
    return rows, item


def test_stages(spark, tmp_path):
    rows, item = _docs(random.Random(3))
    d = str(tmp_path)
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == p.COLUMNS
        docs = materialize(docs, f"test-{name}")
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = {i for i, t, _, _ in rows if i < 400}
    assert set(kept["language"]) == clean
    assert set(kept["near_dup"]) == clean - set(range(100, 110))
    assert set(kept["decontamination"]) == set(kept["near_dup"]) - set(range(200, 205))
    assert set(kept["secrets"]) == set(kept["decontamination"])
    assert "abc123def456" not in kept["secrets"][300] and all(kept["secrets"][i] == secrets.redact(kept["decontamination"][i]) for i in kept["secrets"])
    out = p.run(spark, d).collect()
    # the last stage equals its SQL over what the others kept
    spark.createDataFrame([(i, t, "en", next(r[3] for r in rows if r[0] == i), len(t)) for i, t in kept["secrets"].items()], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{d}/kept.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/kept.parquet/*.parquet')")
    assert sorted((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in out) == sorted((*r[:3], round(r[3], 6), r[4]) for r in con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.ORACLE})").fetchall())
    assert {r["doc_id"] for r in out} == set(kept["secrets"]) and all(r["taken"] <= 2 * r["size"] for r in out)


def test_verdicts_are_by_row(spark, tmp_path):
    """Rows that share an id, or have none, go or stay each by its own text in every stage."""
    rng = random.Random(5)
    say = lambda: " ".join("".join(rng.choice(["the", "ing", "and", "tion", "er"]) for _ in range(rng.randint(1, 4))) for _ in range(60))
    item = "what is the capital of the small island in the north? it is the old harbour town by the bay"
    a, b, c, e = say(), say(), say(), say()
    rows = [(1, a), (1, "### 1"), (1, b), (2, a + " end"), (None, c), (None, "77"), (None, c), (3, e + " " + item), (3, e), (4, b), (5, say() + " password=abcdef99")]
    d = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in p.STAGES[:-1]:
        docs = materialize(stage(spark, docs, d), f"test-{name}")
        kept[name] = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
    order = lambda x: sorted(x, key=str)
    assert kept["language"] == order([r for r in rows if r[1] not in ("### 1", "77")])
    both = [(3, e + " " + item), (3, e)]
    # the two texts of id 3 are alike (over 0.75), so the one with the lesser hash stays
    assert [r for r in kept["near_dup"] if r[0] != 3] == order([(1, a), (1, b), (None, c), rows[-1]]) and len([r for r in kept["near_dup"] if r in both]) in (1, 2)
    assert (3, e + " " + item) not in kept["decontamination"] and {(1, a), (1, b), (None, c)} < set(kept["decontamination"])


def test_empty_and_repeated(spark, tmp_path):
    d = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{d}/documents.parquet")
    assert p.run(spark, d).count() == 0
    twice = spark.createDataFrame([(1, "one two three four five six", "en", "a", 27)] * 2 + [(2, "seven eight nine ten eleven", "en", "a", 27)] * 5, schema)
    assert p.near_dup_stage(spark, twice, d).count() == 2
