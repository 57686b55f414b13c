"""Scans, ledgers and forgetting."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from granary.operators import reconcile as rec

FILE = "root string, rel_path string, name string, ext string, size_bytes long, mtime_ns long, asset_id string, state string, attempts int, priority int, last_scan_id long"
LIST = "root string, rel_path string, name string, ext string, size_bytes long, mtime_ns long"


def row(path, size=1, time=1, asset="x", state="indexed", attempts=2, scan=1):
    return ("r", path, path, "txt", size, time, asset, state, attempts, 100, scan)


@pytest.fixture(scope="module")
def scanned(spark):
    old = spark.createDataFrame([row("same"), row("bigger"), row("later"), row("gone", 7, 7), row("moved", 8, 8, "m"), row("back", state="missing"), row("two1", 9, 9, "p"), row("two2", 9, 9, "q")], FILE)
    new = [("same", 1, 1), ("bigger", 2, 1), ("later", 1, 2), ("dir/moved", 8, 8), ("back", 1, 1), ("n1", 9, 9), ("n2", 9, 9), ("fresh", 5, 5)]
    listing = spark.createDataFrame([("r", p, p, "txt", s, t) for p, s, t in new], LIST)
    return old, listing, rec.sweep(rec.upsert(old, listing, 2), 2)


def test_upsert_and_sweep(scanned):
    _, _, f = scanned
    got = {r["rel_path"]: (r["state"], r["asset_id"], r["attempts"]) for r in f.collect()}
    assert got["same"] == ("indexed", "x", 2) and got["bigger"] == ("queued", None, 0) and got["later"] == ("queued", None, 0)
    assert got["gone"][0] == "missing" and got["back"] == ("queued", "x", 2) and got["fresh"] == ("queued", None, 0)


def test_upsert_is_idempotent(scanned):
    old, listing, f = scanned
    again = rec.sweep(rec.upsert(f.withColumn("priority", F.lit(100)), listing, 2), 2)
    cols = ["rel_path", "state", "size_bytes", "mtime_ns", "last_scan_id"]
    assert {tuple(r) for r in again.select(*cols).collect()} == {tuple(r) for r in f.select(*cols).collect()}


def test_moves_pair_one_to_one(scanned):
    _, _, f = scanned
    m = rec.moves(f)
    assert {(r["old_path"], r["new_path"]) for r in m.collect()} == {("moved", "dir/moved"), ("two1", "n1"), ("two2", "n2")}
    after = {r["rel_path"]: (r["state"], r["asset_id"], r["name"]) for r in rec.apply_moves(f, m).collect()}
    assert after["dir/moved"] == ("indexed", "m", "moved") and after["n1"][1] == "p" and "moved" not in after and after["gone"][0] == "missing"


def test_failures_claims_and_completion(spark):
    f = spark.createDataFrame([row("a", state="queued", attempts=0, asset="c"), row("b", state="queued", attempts=2, asset="c"), row("d", state="queued", attempts=0, asset="e"), row("e", state="queued", attempts=0, asset=None)], FILE)
    bad = spark.createDataFrame([("r", "a", "timeout"), ("r", "b", "timeout"), ("r", "d", "corrupt")], "root string, rel_path string, error string")
    got = {r["rel_path"]: (r["state"], r["attempts"], r["priority"]) for r in rec.route_failures(f, bad).collect()}
    assert got == {"a": ("queued", 1, 200), "b": ("error", 3, 100), "d": ("error", 1, 100), "e": ("queued", 0, 100)}
    assert [r["rel_path"] for r in rec.claim(f, 10).collect()] == ["a", "d", "e"]
    done = rec.complete(f, spark.createDataFrame([("c",)], "asset_id string"))
    assert {r["rel_path"] for r in done.filter("state = 'indexed'").collect()} == {"a", "b"}
    assets = spark.createDataFrame([("c", "complete"), ("z", "pending")], "asset_id string, pipeline_state string")
    hashed = spark.createDataFrame([("r", "e", "c"), ("r", "d", "z")], "root string, rel_path string, asset_id string")
    bound = {r["rel_path"]: (r["asset_id"], r["state"]) for r in rec.bind(f, hashed, assets).collect()}
    assert bound["e"] == ("c", "indexed") and bound["d"] == ("z", "queued")


def test_merges(spark):
    t = "asset_id string, kind string, name string, source string, confidence double, instances int"
    old, new = spark.createDataFrame([("a", "k", "n", "s", 0.5, 3)], t), spark.createDataFrame([("a", "k", "n", "s", 0.9, 1), ("b", "k", "n", "s", 0.1, 1)], t)
    assert {tuple(r) for r in rec.merge_tags(old, new).collect()} == {("a", "k", "n", "s", 0.9, 3), ("b", "k", "n", "s", 0.1, 1)}
    m = rec.merge_rows(spark.createDataFrame([(1, "x", 5)], "id int, a string, b int"), spark.createDataFrame([(1, None, 6), (2, "y", None)], "id int, a string, b int"), ["id"])
    assert {tuple(r) for r in m.collect()} == {(1, "x", 6), (2, "y", None)}
    tagged = rec.set_tag(old, spark.createDataFrame([("a",), ("c",)], "asset_id string"), "custom", "mine")
    assert tagged.count() == 3 and rec.unset_tag(tagged, tagged, "custom", "mine").count() == 1
    assert rec.latest(spark.createDataFrame([("q", 1, "a"), ("q", 2, "b")], "k string, at int, v string"), ["k"], "at").first()["v"] == "b"
    tags = rec.intern_tags(spark.createDataFrame([("k", "n", "N")], "kind string, name string, display string"), new.withColumn("name", F.lit("meeting-notes")))
    assert {r["display"] for r in tags.collect()} == {"N", "Meeting Notes"}


def test_backlog(spark):
    assets = spark.createDataFrame([("a", "document"), ("b", "document"), ("c", "image")], "asset_id string, media_type string")
    runs = spark.createDataFrame([("a", "t", 2, "ok"), ("b", "t", 1, "ok"), ("b", "u", 1, "skipped"), ("a", "u", 1, "unsupported")], "asset_id string, extractor string, version int, status string")
    versions = spark.createDataFrame([("t", 2, ["document"]), ("u", 1, ["document"])], "extractor string, version int, media_types array<string>")
    assert {(r["asset_id"], r["extractor"]) for r in rec.backlog(assets, runs, versions).collect()} == {("b", "t"), ("b", "u")}


@pytest.mark.parametrize(("keep", "left"), [(False, {"A", "B"}), (True, {"A", "B", "C"})])
def test_forget(spark, keep, left):
    f = spark.createDataFrame([("one", "x", "A"), ("one", "y", "C"), ("two", "x", "A"), ("two", "z", "B")], "root string, rel_path string, asset_id string")
    meta = spark.createDataFrame([("A",), ("B",), ("C",)], "asset_id string")
    rest, by = rec.forget(f, {"asset": meta}, "one", keep_metadata=keep)
    assert rest.count() == 2 and {r["asset_id"] for r in by["asset"].collect()} == left


def test_audit_and_stamps(spark):
    a = spark.createDataFrame([("r", "x", 1, 1), ("r", "y", 1, 1), ("r", "z", 1, 1)], "root string, rel_path string, size_bytes long, mtime_ns long")
    b = spark.createDataFrame([("r", "x", 1, 1), ("r", "y", 2, 1)], a.schema)
    assert {(r["rel_path"], r["verdict"]) for r in rec.audit(a, b).collect()} == {("x", "unchanged"), ("y", "mutated"), ("z", "vanished")}
    s = "root string, rel_path string, state string, indexed_at long, missing_since long"
    old, new = spark.createDataFrame([("r", "x", "queued", None, None), ("r", "y", "indexed", 5, None)], s), spark.createDataFrame([("r", "x", "indexed", None, None), ("r", "y", "missing", None, None)], s)
    assert {tuple(r)[1:] for r in rec.stamped(old, new, 9).collect()} == {("x", "indexed", 9, None), ("y", "missing", 5, 9)}
