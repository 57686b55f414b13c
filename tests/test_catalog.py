"""Selections, facets, graphs, tenancy and review on small catalogues, and property checks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from granary.operators import facets, graph, review, tenancy
from granary.operators.selection import ColourRule, FilterSpec, Scope, coloured, in_scope, keyset_page, label, selection, terms
from granary.plans import catalog as cat
from granary.plans.catalog import SCHEMAS, Catalog


@pytest.fixture(scope="module")
def office(spark):
    """Six files: three invoices (one content twice), a contract, a note and a picture."""
    file = [(1, "r", "inv/a.txt", "inv", "a.txt", "txt", 1000, 1, "A", "indexed"), (2, "r", "inv/b.txt", "inv", "b.txt", "txt", 2000, 1, "B", "indexed"), (3, "r", "old/a copy.txt", "old", "a copy.txt", "txt", 1000, 1, "A", "indexed"), (4, "r", "legal/c.docx", "legal", "c.docx", "docx", 300_000, 1, "C", "indexed"), (5, "q", "n.md", "", "n.md", "md", 10, 1, "N", "queued"), (6, "q", "p.png", "", "p.png", "png", 3 << 20, 1, "P", "indexed")]
    cols = "file_id long, root string, rel_path string, parent_rel string, name string, ext string, size_bytes long, mtime_ns long, asset_id string, state string"
    tags = [(a, k, n, s, c) for a, k, n, s, c in [("A", "topic", "finance", "agent", 0.9), ("A", "doctype", "invoice", "agent", 0.9), ("A", "author", "jane doe", "agent", 0.9), ("B", "topic", "finance", "agent", 0.8), ("B", "doctype", "invoice", "agent", 0.8), ("B", "author", "john roe", "agent", 0.8), ("C", "topic", "legal", "agent", 0.9), ("C", "doctype", "contract", "agent", 0.9), ("C", "author", "john roe", "agent", 0.9), ("N", "topic", "finance", "agent", 0.5), ("A", "custom", "todo", "user", 1.0)]]
    f = spark.createDataFrame(file, cols).withColumn("media_type", F.when(F.col("ext") == "png", "image").otherwise("document"))
    asset = f.groupBy("asset_id").agg(F.min("size_bytes").alias("size_bytes"), F.min("media_type").alias("media_type")).withColumns({"mime": F.lit(None).cast("string"), "pipeline_state": F.lit("complete")})
    block = spark.createDataFrame([("A", "text", 0, "Amount due: café money"), ("B", "text", 0, "Amount paid"), ("C", "text", 0, "This agreement")], SCHEMAS["text_block"])
    color = spark.createDataFrame([("P", 0, "ff0000", 0.6, "red"), ("P", 3, "0000ff", 0.1, "blue")], SCHEMAS["color"])
    return Catalog(f, asset, spark.createDataFrame(tags, "asset_id string, kind string, name string, source string, confidence double"), block, color)


def ids(df):
    return sorted(r["file_id"] for r in df.collect())


@pytest.mark.parametrize(
    ("params", "want"),
    [
        ({"topic": "finance"}, [1, 2, 3]), ({"author": "John Roe"}, [2, 4]), ({"topic": "finance", "author": "john roe"}, [2]), ({"topic": ["finance", "legal"]}, [1, 2, 3, 4]), ({"topic": "finance,legal", "doctype": "contract"}, [4]),
        ({"topic": "finance", "doctype": "contract"}, []), ({"tag": "todo"}, [1, 3]), ({"type": "image"}, [6]), ({"ext": ".DOCX"}, [4]), ({"size": "medium"}, [6]), ({"size": "nonsense"}, [1, 2, 3, 4, 6]), ({"color": "red"}, [6]), ({"color": "blue"}, []),
        ({"q": "CAFE"}, [1, 3]), ({"q": "amount paid"}, [2]), ({"q": "copy"}, [3]), ({"q": "roe"}, [2, 4]), ({"q": '"*'}, []), ({}, [1, 2, 3, 4, 6]), ({"cursor": "x", "root": "q"}, [6]),
    ],
)
def test_filters(office, params, want):
    assert ids(selection(office, FilterSpec.parse(params))) == want


def test_narrowing_never_widens(office):
    rng = random.Random(1)
    for _ in range(6):
        a = {"topic": rng.sample(["finance", "legal"], rng.randint(1, 2))}
        b = {**a, "author": rng.sample(["jane doe", "john roe"], 1)}
        assert set(ids(selection(office, FilterSpec.parse(b)))) <= set(ids(selection(office, FilterSpec.parse(a))))


def test_canonical_and_label():
    a, b = FilterSpec.parse({"topic": "Legal,finance", "q": "x y"}), FilterSpec.parse({"q": "x y", "topic": ["finance", "legal"], "cursor": "7"})
    assert a.canonical() == b.canonical() and b.cursor == 7
    assert label(FilterSpec.parse({"topic": "finance", "doctype": "invoice", "author": "jane doe"})) == "Finance, Invoice, by Jane Doe"
    assert label(FilterSpec()) == "Everything" and terms('a "b* c') == ["a", "b", "c"]


def test_pages(office):
    assert ids(keyset_page(office, FilterSpec(cursor=2), size=1)) == [3, 4]


def test_facets(office):
    n = {(r["kind"], r["name"]): r["n"] for r in cat.tag_facet_view(office).collect()}
    assert n["topic", "finance"] == 2 and n["custom", "todo"] == 1
    assert {(r["kind"], r["name"]): r["n"] for r in facets.conditioned(office, office.indexed).collect()}["topic", "finance"] == 3
    assert [tuple(r) for r in cat.duplicate_groups(office).collect()] == [("A", 2, 1000)]
    assert facets.unclassified(office).first()["n"] == 1
    assert {r["band"]: r["n"] for r in facets.size_bands(office.indexed).collect()} == {"tiny": 3, "small": 1, "medium": 1}
    assert facets.reclaimable(cat.duplicate_groups(office).limit(0)).first()["bytes"] == 0
    office.register("t_")
    assert office.file.sparkSession.sql("SELECT count(*) FROM t_v_library").first()[0] == 6


def test_scope_exclusion_wins_and_users_cannot_widen(office):
    assert ids(in_scope(office, office.indexed, Scope())) == [1, 2, 3, 4, 6]
    assert ids(in_scope(office, office.indexed, Scope(include_tags=["finance"], exclude_tags=["john roe"]))) == [1, 3]
    assert ids(in_scope(office, office.indexed, Scope(include_tags=["todo"]))) == []
    assert ids(in_scope(office, office.indexed, Scope(path_prefixes=["inv/", "legal"], media_types=["document"]))) == [1, 2, 4]


def test_colours(office):
    rules = [ColourRule("tag", "legal", "#1", enabled=False), ColourRule.parse("tag:finance=#2"), ColourRule.parse("untagged=#3"), ColourRule("kind", "topic", "#4")]
    assert {r["file_id"]: r["colour"] for r in coloured(office, office.indexed, rules).collect()} == {1: "#2", 2: "#2", 3: "#2", 4: "#4", 6: "#3"}


def test_tag_graph(office):
    nodes = graph.tag_nodes(office.asset_tag, office.indexed)
    assert {(r["kind"], r["name"]): r["n"] for r in nodes.collect()}["topic", "finance"] == 2 and nodes.first()["kind"] == "topic"
    e = graph.tag_edges(office.asset_tag, office.indexed, nodes).collect()
    assert [(r["source"], r["target"], r["weight"], r["strength"]) for r in e] == [("doctype:invoice", "topic:finance", 2, 1.0)]
    for r in graph.tag_edges(office.asset_tag, office.indexed, nodes, least=1).collect():
        assert 0 < r["strength"] <= 1 and r["weight"] <= min(r["n_source"], r["n_target"])


PYRAMID = [("a", "b", 50, 100, 50), ("a", "c", 30, 100, 30), ("a", "d", 20, 100, 20), ("b", "d", 19, 50, 20), ("c", "d", 2, 30, 20)]


@pytest.mark.parametrize(("least", "edges", "depth"), [(0.6, {("a", "b"), ("a", "c"), ("b", "d")}, 2), (0.96, {("a", "b"), ("a", "c"), ("a", "d")}, 1), (0.09, {("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")}, 2)])
def test_pyramid(spark, least, edges, depth):
    e = spark.createDataFrame(PYRAMID, "source string, target string, weight long, n_source long, n_target long")
    dag = graph.containment(e, least)
    red = graph.reduced(dag)
    assert {(r["parent"], r["child"]) for r in red.collect()} == edges
    nodes = spark.createDataFrame([("e",)], "node string")
    d = {r["node"]: r["depth"] for r in graph.depths(red, nodes).collect()}
    assert d["a"] == 0 and d["d"] == depth and d["e"] == 0 and all(d[a] < d[b] for a, b in edges)


def test_nearest_and_related(spark):
    rng = random.Random(3)
    rows = {(f"x{i}", "k", f"t{rng.randint(0, 30)}") for i in range(60) for _ in range(5)} | {("x0", "k", "rare"), ("x1", "k", "rare")}
    t = spark.createDataFrame(sorted(rows), "asset_id string, kind string, name string")
    e = graph.nearest(t).collect()
    assert e and all(r["a"] < r["b"] and 1 <= r["weight"] <= 255 and r["shared"] >= 2 for r in e)
    r = graph.related(t, "x0").collect()
    assert len(r) == 8 and all(0 < x["score"] <= 1 for x in r) and r[0]["asset_id"] == "x1" and [x["score"] for x in r] == sorted((x["score"] for x in r), reverse=True)
    nodes = spark.createDataFrame([(f"x{i}",) for i in range(30)], "node string")
    assert all(x["a"] in {f"x{i}" for i in range(30)} for x in graph.induced(graph.nearest(t), nodes).collect())
    assert graph.thinned(nodes, graph.degrees(graph.nearest(t)), most=10).count() <= 10
    m = graph.tag_matrix(t, nodes).orderBy("node").collect()
    assert all(b["offset"] == a["offset"] + len(a["tags"]) for a, b in zip(m, m[1:], strict=False))


def test_lens_is_idempotent(spark):
    df = lambda rows: spark.createDataFrame(rows, "file_id long, tag string")
    machine, own, add, gone = df([(1, "a"), (1, "b"), (2, "a")]), df([(1, "mine")]), df([(2, "new"), (1, "a")]), df([(1, "b")])
    once = tenancy.lens(machine, own, add, gone)
    assert {tuple(r) for r in once.collect()} == {(1, "a"), (1, "mine"), (2, "a"), (2, "new")}
    assert {tuple(r) for r in tenancy.lens(once, own, add, gone).collect()} == {tuple(r) for r in once.collect()}
    a, g = tenancy.accept(add, gone, df([(1, "b")]))
    assert g.count() == 0 and tenancy.remove(a, g, df([(1, "b")]))[0].filter("tag = 'b'").count() == 0


def test_overlay_codec_and_access(spark):
    wire = tenancy.encode_overlay([(36, 5)], [(1, 71)], [("best", [3, 37])])
    assert wire == "1|r!f10-5|t!f1-1z|a!best!3!11"
    o = tenancy.decode_overlay(spark, wire)
    assert [tuple(r) for r in o["removals"].collect()] == [(36, 5)] and o["albums"].first()["file_ids"] == [3, 37]
    m = spark.createDataFrame([("u", "w", "owner"), ("v", "w", "viewer")], "user_id string, workspace_id string, role string")
    g = spark.createDataFrame([("w", "editor"), ("w", "viewer")], "workspace_id string, access string")
    assert {(r["user_id"], r["level"]) for r in tenancy.effective(m, g).collect()} == {("u", "editor"), ("v", "viewer")}


def test_review(spark):
    rows = [(i, n, p + "/" + n, p, n.rsplit(".", 1)[1], f"c{i}") for i, (p, n) in enumerate([("a", "report_v2.pdf"), ("b", "report (1).pdf"), ("c", "report_final_v2.pdf"), ("a", "other.pdf"), ("a", "x.txt")])]
    f = spark.createDataFrame(rows, "file_id long, name string, rel_path string, parent_rel string, ext string, asset_id string")
    assert [(r["stem"], r["files"], r["folders"]) for r in review.repeats(f).collect()] == [("report", 3, 3)]
    t = spark.createDataFrame([(0, "doctype", "x"), (0, "topic", "y"), (1, "topic", "y")], "file_id long, kind string, name string")
    q = review.queue(f, t).collect()
    assert 0 not in {r["file_id"] for r in q} and {r["file_id"]: r["priority"] for r in q}[1] == 3 + 5 + 1 + 1
