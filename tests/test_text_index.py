"""The stored text index: segments, deletions, merges, what its plans read, and searches against plain Python."""

from __future__ import annotations

import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from granary.functions import text as tx
from granary.operators import selection
from granary.operators.text_index import TextIndex, _bucket, postings_of, snippets
from granary.plans.catalog import Catalog, Projected
from granary.plans.queries import bm25_scan, bm25_search
from granary.session import scratch


def _tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower().translate(str.maketrans("éü", "eu")))


def _brute(texts):
    return {(t, k): [i for i, w in enumerate(re.split(r"\s+", b.strip(" "))) for x in _tokens(w) if x == t] for k, b in texts.items() if b for t in set(_tokens(b))}


def _held(index):
    return {(r["term"], r["key"]): r["words"] for r in index.postings().collect()}


def _blocks(spark, texts):
    return spark.createDataFrame(list(texts.items()), "asset_id string, body string")


@pytest.fixture()
def index(spark):
    return TextIndex(spark, scratch(spark, "test-index"))


def test_changes_equal_an_index_of_what_is_left(spark, index):
    rng = random.Random(1)
    words = ["the", "Then", "thé", "well-known", "x", "über", "then,", "a_b", "12"]
    text = lambda: "  ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) if rng.random() < 0.9 else None
    now = {}
    for step in range(5):
        new = {f"k{rng.randint(0, 30)}": text() for _ in range(15)}
        index.add(_blocks(spark, new))
        now |= new
        gone = [f"k{rng.randint(0, 40)}" for _ in range(4)]
        index.delete(spark.createDataFrame([(k,) for k in gone], "asset_id string"))
        now = {k: v for k, v in now.items() if k not in gone}
        if step == 2:
            index.merge()
            assert len(index.segments()) == 1
    assert _held(index) == _brute(now)
    assert index.totals() == (len(now), sum(len(_tokens(t)) for t in now.values()))
    both = {k for k, t in now.items() if {"the", "then"} <= set(_tokens(t))}
    assert {r["key"] for r in index.holding(["Thé", "then"]).collect()} == both == {r["key"] for r in index.bm25(["the", "then"]).collect()}
    assert {r["key"]: r["n"] for r in index.prefix("th").collect()} == {k: n for k, t in now.items() if (n := sum(x.startswith("th") for x in _tokens(t)))}
    assert {r["key"]: r["n"] for r in index.prefix("t").collect()} == {k: n for k, t in now.items() if (n := sum(x.startswith("t") for x in _tokens(t)))}
    assert index.holding([]).count() == 0 and index.bm25(["nowhere"]).count() == 0
    index.merge()
    assert _held(index) == _brute(now)


def test_a_segment_that_was_not_committed_is_not_read(spark, index):
    index.add(_blocks(spark, {"a": "one two"}))
    postings_of(spark.createDataFrame([("b", "one")], "key string, body string")).write.parquet(f"{index.path}/2/postings")
    again = TextIndex(spark, index.path)
    assert {r["key"] for r in again.holding(["one"]).collect()} == {"a"}
    again.add(_blocks(spark, {"c": "one"}))
    assert list(again.segments()) == [1, 3] and {r["key"] for r in again.holding(["one"]).collect()} == {"a", "c"}


def test_searches_read_one_bucket_and_no_text(spark, index):
    index.add(_blocks(spark, {f"k{i}": f"term{i} then more words" for i in range(50)}))
    for df in (index.holding(["then"]), index.bm25(["then", "more"]), index.prefix("term")):
        plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        assert "PartitionFilters" in plan and "bucket" in plan and "body" not in plan
    plan = index.holding(["then"])._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[.*EqualTo\(term,then\)", plan)
    read = index.holding(["then"]).inputFiles()
    assert read


def test_postings_are_not_shuffled(spark, index):
    blocks = _blocks(spark, {"a": "one two one", "b": None, "c": " ", "d": "Two"}).withColumnRenamed("asset_id", "key")
    got = postings_of(blocks)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in got.collect()) == [("one", "a", 2, 3, [0, 2]), ("two", "a", 1, 3, [1]), ("two", "d", 1, 1, [0])]
    index.add(_blocks(spark, {f"k{i}": f"common word{i}" for i in range(40)}))
    files = index.postings(["common"]).inputFiles()
    assert files and index.holding(["common"]).count() == 40


def test_a_merged_index_has_no_more_files_than_one_segment(spark, index):
    texts = {f"k{i}": "\n a\x01b  c-d\x0be " + " ".join(f"{chr(97 + j % 26)}{chr(97 + i % 26)}{j}" for j in range(50)) for i in range(60)} | {"none": None}
    for part in range(3):
        index.add(_blocks(spark, {k: v for i, (k, v) in enumerate(texts.items()) if i % 3 == part}))
    index.merge()
    assert _held(index) == _brute(texts) and index.totals()[0] == 61
    assert len(index.postings().inputFiles()) <= 33  # one in each bucket, and the documents'


def test_a_text_is_split_in_one_pass_for_postings_and_documents(spark, index):
    plan = postings_of(_blocks(spark, {"a": "one two"}), "asset_id")._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan
    index.add(_blocks(spark, {"a": "one two one", "b": " "}))
    assert {(r["key"], r["len"]) for r in index._read("docs", [1]).collect()} == {("a", 3), ("b", 0)}
    assert not index._fs(index.path)[0].exists(index._fs(f"{index.path}/1/docs")[1])  # no second pass wrote them


def test_a_task_makes_postings_in_order_of_buckets_and_terms(spark):
    texts = {f"k{i}": f" über x \u65e5\u672c\u8a9e \u00dfa b\U0001d7d8 word{i % 7} a-b{i}\tend" for i in range(2500)}
    got = postings_of(_blocks(spark, texts).coalesce(1), "asset_id", docs=True).withColumn("same", F.coalesce(F.col("bucket") == _bucket(F.col("term")), F.lit(True)))
    rows = got.collect()
    at = [(r["bucket"], (r["term"] or "").encode()) for r in rows]
    assert at == sorted(at) and all(r["same"] for r in rows)
    assert [r["key"] for r in rows if r["bucket"] == -1] == list(texts)
    assert {(r["term"], r["key"]): r["words"] for r in rows if r["term"] is not None} == _brute(texts)


def test_a_merged_file_names_each_key_once(spark, index):
    many = spark.range(60000).select(F.md5(F.col("id").cast("string")).alias("asset_id"), F.when(F.col("id") < 1000, " ".join(f"coa{i}" for i in range(30))).otherwise("").alias("first"))
    blocks = many.select("asset_id", F.concat_ws(" ", "first", F.lit("cob coc cod coe cof cog")).alias("body"))
    index.add(blocks.filter("asset_id < '8'"))
    index.add(blocks.filter("asset_id >= '8'"))
    index.merge()
    files = [f.removeprefix("file://") for f in index.postings().inputFiles() if "bucket=-1/" not in f]
    held = [pq.read_metadata(f).row_group(g).column(1) for f in files for g in range(pq.read_metadata(f).num_row_groups)]
    assert {c.path_in_schema for c in held} == {"key"} and sum(c.num_values for c in held) == 390000
    assert sum(c.total_uncompressed_size for c in held) < 390000 * 36 / 3


def test_snippets_mark_the_words_of_the_index(spark, index):
    texts = {"a": "Zero one two Thén, four five six seven then nine ten eleven twelve thirteen fourteen", "b": "then", "c": "no"}
    index.add(_blocks(spark, texts))
    got = {r["key"]: r["snippet"] for r in snippets(index.bm25(["then"]), _blocks(spark, texts)).collect()}
    assert got == {"a": "Zero one two [Thén,] four five six seven [then] nine ten eleven", "b": "[then]"}


def test_catalogues_with_and_without_an_index_find_the_same_files(spark, index):
    texts = {"a": "alpha beta", "b": "beta", "c": "Álpha"}
    index.add(_blocks(spark, texts))
    files = spark.createDataFrame([(1, "n.txt", "a", "indexed"), (2, "alpha.txt", "b", "indexed"), (3, "m.txt", "c", "indexed"), (4, "o.txt", "a", "missing")], "file_id long, name string, asset_id string, state string")
    tags = spark.createDataFrame([("b", "topic", "x")], "asset_id string, kind string, name string")
    blocks = _blocks(spark, texts)
    for held in (None, index):
        c = Catalog(files, blocks, tags, blocks, blocks, held)
        assert sorted(r["file_id"] for r in selection.matching(c, c.indexed, "alpha").collect()) == [1, 2, 3]


def _scores(df, key="key"):
    return {r[key]: round(r["score"], 9) for r in df.collect()}


def test_copies_count_once_and_null_texts_have_no_length(spark, index):
    texts = {"a": "one two one", "b": "one", "c": None, "d": " ", "e": "two three four one five", "f": None}
    blocks = _blocks(spark, texts)
    index.add(blocks.unionByName(blocks).unionByName(blocks.filter("asset_id < 'c'")), copies=True)
    assert _held(index) == _brute(texts) and index.totals() == (6, 9)
    assert _scores(index.bm25(["one"])) == _scores(tx.bm25(blocks, ["one"]), "asset_id")  # the mean of four lengths
    index.delete(spark.createDataFrame([("c",), ("b",)], "asset_id string"))
    assert _scores(index.bm25(["one"])) == _scores(tx.bm25(blocks.filter("asset_id NOT IN ('b', 'c')"), ["one"]), "asset_id")
    index.merge()
    assert _scores(index.bm25(["one"])) == _scores(tx.bm25(blocks.filter("asset_id NOT IN ('b', 'c')"), ["one"]), "asset_id")


def test_the_index_of_a_catalogue_needs_no_text_blocks(spark, tmp_path):
    rows = [(i, None if i % 5 == 0 else " ".join(["then", "and", "more"][: i % 4] + [f"w{i % 7}"]), "en", "s", 1) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    c = Projected(spark, str(tmp_path))
    got = _scores(bm25_search(c), "asset_id")
    made = {k[-1] for k in Projected._written if k[:-1] == c._of}
    assert got and "text_index" in made and "text_block" not in made  # each text was shuffled once, and written nowhere
    assert got == _scores(bm25_scan(c), "asset_id")
    file = next(f for f in c.text_index.postings().inputFiles()).removeprefix("file://")
    assert pq.read_metadata(file).row_group(0).column(0).compression == "ZSTD"
