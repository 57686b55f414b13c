"""Operators of the second round: k-NN by pairs of tags, graph helpers, states, sinks, answers of a model, file types."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from granary.functions import classify, colour, identity
from granary.operators import digest, extractors, graph, reconcile, tenancy
from granary.operators import selection as sel
from granary.session import Scratch, remove, table
from granary.sources import readers


def _knn(rows, cap=0.25, shared=2, least=0.35, k=5):
    by, df = defaultdict(set), Counter()
    for a, kind, name in set(rows):
        by[a].add((kind, name))
        df[kind, name] += 1
    n = len(by)
    idf = {t: math.log(n / c) for t, c in df.items() if c <= cap * n}
    by = {a: {t for t in ts if t in idf} for a, ts in by.items()}
    norm = {a: math.sqrt(sum(idf[t] ** 2 for t in ts)) for a, ts in by.items()}
    out = {}
    for a in by:
        near = []
        for b in by:
            both = by[a] & by[b]
            if a != b and len(both) >= shared:
                sim = sum(idf[t] ** 2 for t in both) / (norm[a] * norm[b])
                if sim >= least:
                    near.append((-round(sim, 9), b, sim, len(both)))
        for _, b, sim, m in sorted(near)[:k]:
            out[min(a, b), max(a, b)] = (m, int(min(max(round(255 * sim), 1), 255)))
    return out


@pytest.mark.parametrize("block", [graph.BLOCK, 3])
def test_nearest_equals_brute_force(spark, monkeypatch, block):
    """Vectors with many members, ties, frequent tags, and lists that are cut into blocks."""
    monkeypatch.setattr(graph, "BLOCK", block)
    rng = random.Random(block)
    rows = []
    for i in range(160):
        kinds = [("a", rng.randint(0, 5)), ("b", rng.randint(0, 7)), ("c", rng.randint(0, 3)), ("d", rng.randint(0, 40)), ("e", 0)]
        rows += [(f"x{i:03}", k, str(v)) for k, v in (kinds if i % 3 else [("a", 1), ("b", 1), ("d", i % 2)])]
    got = {(r["a"], r["b"]): (r["shared"], r["weight"]) for r in graph.nearest(spark.createDataFrame(rows, "asset_id string, kind string, name string")).collect()}
    assert got == _knn(rows)
    with pytest.raises(ValueError):
        graph.nearest(spark.createDataFrame(rows, "asset_id string, kind string, name string"), shared=1)


def test_components_cycles_and_loose_tags(spark):
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(30) if i != 12] + [("p", "q"), ("q", "p")], "source string, target string")
    got = {r["node"]: r["component"] for r in graph.components(e, spark.createDataFrame([("alone",)], "node string")).collect()}
    low, high = min(f"n{i}" for i in range(13)), min(f"n{i}" for i in range(13, 31))
    assert got["alone"] == "alone" and got["q"] == "p" and all(got[f"n{i}"] == (low if i <= 12 else high) for i in range(31))
    cycle = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "parent string, child string")
    for f in (graph.reduced, graph.depths):
        with pytest.raises(ValueError):
            f(cycle)
    path = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(0, 40)], "parent long, child long")
    assert graph.reduced(path).count() == 40
    nodes = spark.createDataFrame([(f"t{i:02}", 100 - i) for i in range(7)], "node string, n int")
    rows = {r["node"]: (r["row"], r["col"]) for r in graph.wrapped(nodes, spark.createDataFrame([("t00", "t01")], "parent string, child string"), width=3).collect()}
    assert rows == {"t02": (2, 0), "t03": (2, 1), "t04": (2, 2), "t05": (3, 0), "t06": (3, 1)}


def test_orphans_are_taken_in_even_strides(spark):
    nodes = spark.range(100).select(F.format_string("n%03d", "id").alias("node"))
    got = sorted(r["node"] for r in graph.thinned(nodes, spark.createDataFrame([("n000", 3)], "node string, degree int"), most=20).collect())
    gaps = {int(b[1:]) - int(a[1:]) for a, b in zip(got[1:], got[2:], strict=False)}
    assert got[0] == "n000" and 18 <= len(got) <= 20 and gaps <= {5, 6}
    with pytest.raises(ValueError):
        graph.tag_matrix(spark.createDataFrame([("n001", "k", "v")], "asset_id string, kind string, name string"), nodes, most=10)


def test_states_sinks_and_custom_tags(spark):
    files = spark.createDataFrame([("r", "a", "error"), ("r", "b", "queued"), ("r", "c", None)], "root string, rel_path string, state string")
    changes = spark.createDataFrame([("r", "a", "indexed"), ("r", "b", "indexed"), ("r", "c", "queued")], "root string, rel_path string, to string")
    new, bad = reconcile.transition(files, changes)
    assert {r["rel_path"]: r["state"] for r in new.collect()} == {"a": "error", "b": "indexed", "c": None}
    assert {r["rel_path"] for r in bad.collect()} == {"a", "c"} and set(reconcile.RETRYABLE) < set(reconcile.ERRORS)
    geo = spark.createDataFrame([("x", 1.0, None)], "asset_id string, lat double, locality string")
    out = reconcile.sink({"geo": geo}, {"geo": spark.createDataFrame([("x", None, "Town"), ("y", 2.0, None)], "asset_id string, lat double, locality string")})
    assert sorted(map(tuple, out["geo"].collect())) == [("x", 1.0, "Town"), ("y", 2.0, None)]
    with pytest.raises(ValueError):
        reconcile.sink({}, {"users": geo})
    tags = spark.createDataFrame([("custom", "used"), ("custom", "gone"), ("topic", "gone")], "kind string, name string")
    assert sorted(map(tuple, reconcile.pruned(tags, tags.filter("name = 'used'")).collect())) == [("custom", "used"), ("topic", "gone")]


VERDICT = "file_id int, doctype string, doctype_score double, topic string, topic_score double, topic_others array<string>, entities array<string>, reasoning string, escalate boolean"


def test_a_model_fills_gaps_only(spark):
    v = spark.createDataFrame([(1, None, 0.0, "finance", 20.0, ["legal"], ["Acme"], "r", False), (2, "invoice", 20.0, None, 0.0, None, None, "r", True), (3, "invoice", 9.0, "law", 3.0, [], [], "r", False)], VERDICT)
    a = spark.createDataFrame([(1, "letter", ["travel", "legal"], ["acme", " New  Co ", "new co", ""], " A letter. "), (2, "form", [None, "travel"], None, None)], "file_id int, doctype string, topics array<string>, objects array<string>, description string")
    got = {r["file_id"]: r for r in classify.merge_answer(v, a, source="m").collect()}
    one, two, three = got[1], got[2], got[3]
    assert (one["doctype"], one["topic"], one["topic_others"], one["entities"], one["reasoning"], one["decided_by"]) == ("letter", "finance", ["legal"], ["Acme", "New Co"], "A letter. (model)", "m")
    assert (two["doctype"], two["topic"], two["topic_score"], two["reasoning"]) == ("invoice", "travel", classify.MIN_SCORE, "r")
    assert (three["topic"], three["decided_by"], three["escalate"]) == ("law", "rules", False)


def test_evidence_puts_own_text_first(spark):
    files = spark.createDataFrame([("x", "home/user/2024/Invoices/a.pdf"), ("y", "b.txt")], "asset_id string, rel_path string")
    blocks = spark.createDataFrame([("x", "ai_vision", 0, "model"), ("x", "doc_text", 2, "two"), ("x", "doc_text", 1, "one"), ("x", "pdf_ocr", 0, "read")], "asset_id string, source string, ord int, body string")
    got = {r["asset_id"]: (r["rel_path"], r["text"]) for r in classify.evidence(files, blocks).collect()}
    assert got == {"x": ("2024/Invoices", "one\ntwo\nmodel\nread"), "y": ("", "")}


def test_file_types(spark):
    data = [(b"\xff\xfb..", "audio/mpeg"), (b"\xff\xf3..", "audio/mpeg"), (b"\xff\xf2..", "audio/mpeg"), (b"\x1a\x45\xdf\xa3 webm", "video/webm"), (b"\x1a\x45\xdf\xa3 x", "video/x-matroska"), (b"0000ftypmif1", "image/heic"), (b"0000ftypM4B ", "audio/mp4"), (b"0000ftypisom", "video/mp4"), (b"RIFF0000WAVE", "audio/x-wav"), (b"PK\x03\x04mimetypeapplication/epub+zip", "application/epub+zip"), (b"PK\x03\x04", "application/zip"), (b"{\\rtf1", "application/rtf"), (b"\xff\xd8\xff\xe0", "image/jpeg")]
    df = spark.createDataFrame([(i, bytearray(d)) for i, (d, _) in enumerate(data)], "i int, c binary")
    got = {r["i"]: r["m"] for r in df.select("i", identity.sniff(F.col("c"), F.lit("zz")).alias("m")).collect()}
    assert got == {i: m for i, (_, m) in enumerate(data)}


def test_hashes_within_seven_bits(spark):
    rng = random.Random(64)
    base = [rng.getrandbits(64) for _ in range(40)]
    all_ = base + [b ^ sum(1 << k for k in rng.sample(range(64), n)) for b in base for n in (1, 7, 8)] + base[:5]
    signed = [x - (1 << 64) if x >> 63 else x for x in all_]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, h long")
    got = {(r["a"], r["b"]): r["distance"] for r in colour.near_hashes(df, "id", "h").collect()}
    assert got == {(i, j): d for i in range(len(all_)) for j in range(i + 1, len(all_)) if (d := (all_[i] ^ all_[j]).bit_count()) <= 7}


def test_workspace_views(spark):
    files = spark.createDataFrame([(1, "L", "a/x", "image", "Cat.png"), (2, "L", "b/y", "audio", "dog.mp3"), (3, "M", "a/z", "other", "z")], "file_id int, library_id string, rel_path string, media_type string, name string")
    lens = spark.createDataFrame([(1, "doctype", "photo", "Photo"), (1, "topic", "pets", None), (2, "topic", "pets", None)], "file_id int, kind string, name string, display string")
    one = lambda df: {r["file_id"] for r in df.collect()}
    assert one(sel.matching_lens(files, lens, q="CAT", tags={"topic": ["pets"], "doctype": []})) == {1}
    assert one(sel.matching_lens(files, lens, album=spark.createDataFrame([], "file_id int"))) == set()
    assert one(tenancy.get_file(files.filter("library_id = 'L'"), 3)) == set()
    views = {r["file_id"]: (r["label"], r["tags"], r["tint"]) for r in tenancy.file_view(files, lens).collect()}
    assert views[1] == ("Photo", ["doctype:photo", "topic:pets"], None) and views[2][:2] == ("audio", ["topic:pets"]) and views[3] == ("other", [], "#4a4a5e")
    totals = digest.digest_totals(files.withColumns({"size_bytes": F.lit(2), "mtime_ns": F.col("file_id") - 1}), lens.withColumn("kind", F.lit("date"))).first()
    assert tuple(totals) == (3, 6, 1, 2, 1)


def test_extractors_without_their_columns_are_skipped_and_stay_pending(spark):
    assets = spark.createDataFrame([("a", "document")], "asset_id string, media_type string")
    none = spark.createDataFrame([], "asset_id string, extractor string, version int, status string")
    _, ledger = extractors.run_all(assets, none, [e for e in extractors.registry({}) if e.tier == "cheap"])
    got = {r["extractor"]: r["status"] for r in ledger.collect()}
    assert got["doc.text"] == got["doc.docx"] == got["agent.inspect"] == got["doc.pdf"] == "skipped"
    left = {r["extractor"] for r in extractors.pending(assets, ledger, extractors.registry({})).collect()}
    assert {"doc.text", "text.keywords", "agent.inspect"} <= left


def test_scratch_tables_are_deleted_and_small_tables_spread(spark, tmp_path):
    work = Scratch(spark, "t")
    a = work.keep(spark.range(3), "x")
    work.keep(spark.range(4), "x")
    old, new = work.paths["x"]
    work.drop_older("x")
    assert spark.read.parquet(new).count() == 4
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(old).count()
    work.drop()
    assert not work.paths and a is not None
    spark.range(10).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    assert table(spark, str(tmp_path), "t").rdd.getNumPartitions() == 1 and table(spark, str(tmp_path), "t", spread=True).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    readers.write_files(spark.createDataFrame([("d/a.txt", bytearray(b"hi"))], "path string, content binary"), f"{tmp_path}/out")
    assert readers.plain_text(spark, f"{tmp_path}/out").first()["body"] == "hi"
    remove(spark, f"{tmp_path}/out")
    assert not (tmp_path / "out").exists()


def test_lab_and_back(spark):
    rows = [(0, 0, 0), (255, 255, 255), (200, 30, 60), (12, 200, 99), (1, 2, 250), (128, 128, 128)]
    df = spark.createDataFrame(rows, "r int, g int, b int")
    r, g, b = colour.lab_to_rgb(*colour.lab(F.col("r"), F.col("g"), F.col("b")))
    got = df.select("r", "g", "b", r.alias("r2"), g.alias("g2"), b.alias("b2")).collect()
    assert all(max(abs(x["r"] - x["r2"]), abs(x["g"] - x["g2"]), abs(x["b"] - x["b2"])) <= 1 for x in got)


def test_synthetic_catalogue_has_conditional_tags_and_grants(spark):
    f = readers.synthetic(spark, 400)
    assert f.filter("doctype = 'photo' AND ext NOT IN ('jpg', 'png')").count() == 0 and 0 < f.filter("topic IS NULL").count() < 200
    assert f.groupBy("parent_rel").agg(F.countDistinct("topic").alias("n")).filter("n > 1").count() == 0
    members, grants = readers.synthetic_workspaces(spark, 5)
    assert members.count() == 5 and grants.count() == 10 and grants.collect() == readers.synthetic_workspaces(spark, 5)[1].collect()
    shown = tenancy.visible(f.withColumn("library_id", F.lit("l1")).withColumn("media_type", F.lit("document")), spark.createDataFrame([], "file_id long, name string"), grants)
    assert shown.count() > 0


def test_contents_of_customers_are_made_on_all_cores(spark):
    from granary.plans import more

    assert more._contents(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
