"""Overlays of many workspaces as columns, against a plain reading of the wire form."""

from __future__ import annotations

import random
from urllib.parse import quote

from granary.operators import selection, tenancy

NAMES = ["Best of 2024", "a!b~c|d", "50% + 1", "日本 \U0001f600", "x.y-z", "100%25", "it's (ok)*"]


def test_ten_thousand_overlays_round_trip(spark):
    rng = random.Random(4)
    removals, additions, albums = [], [], []
    for w in range(10_000):
        many = 450 if w % 2000 == 0 else rng.randint(0, 3)
        removals += [(w, f"f{rng.randint(0, 99)}-x" if w % 5 == 0 else f"f{i}", rng.randint(0, 2**40), i) for i in range(many)]
        additions += [(w, f"f{i}", rng.randint(0, 80), i) for i in range(many // 2)]
        albums += [(w, f"al{i}", rng.choice(NAMES), [f"f{j}" for j in range(rng.choice([0, 2, 300]) if w % 1000 == 0 else rng.randint(0, 3))]) for i in range(25 if w % 3000 == 0 else rng.randint(0, 1))]
    pair = "workspace_id long, file_id string, tag_id long, pos int"
    r, t, a = spark.createDataFrame(removals, pair), spark.createDataFrame(additions, pair), spark.createDataFrame(albums, "workspace_id long, album_id string, name string, file_ids array<string>")
    wire = tenancy.encode_overlays(r, t, a)
    sent = spark.createDataFrame([(x["workspace_id"], quote(x["wire"])) for x in wire.collect()], "workspace_id long, wire string")
    for got in (tenancy.decode_overlays(wire, escaped=False), tenancy.decode_overlays(sent)):
        for name, rows, most in (("removals", removals, 400), ("additions", additions, 200)):
            want = [(w, f, g) for w, f, g, i in rows if i < most]
            assert sorted((x["workspace_id"], x["file_id"], x["tag_id"]) for x in got[name].collect()) == sorted(want)
        kept, want = {}, []
        for w, i, name, files in sorted(albums):
            kept[w] = kept.get(w, 0) + 1
            if kept[w] <= 20:
                want.append((w, i, name, files[:250]))
        assert sorted((x["workspace_id"], x["album_id"], x["name"], x["file_ids"]) for x in got["albums"].collect()) == want


def test_broken_overlays(spark):
    wires = ["1|r!f1-z!!f2!-5!f3-!f-4-1k?!f5-?|q!f1-1|t!f9-1", "2|r!f1-1", "", None, "1", "1|a!~no~f1!x!y~%zz~f1..f2.!z~a+b", "1%7Cr!f1-10", "1|r!f1-1%", "1|r!f1-1|r!f2-2"]
    got = tenancy.decode_overlays(spark.createDataFrame(list(enumerate(wires)), "workspace_id long, wire string"))
    pairs = lambda k: sorted((x["workspace_id"], x["file_id"], x["tag_id"]) for x in got[k].collect())
    assert pairs("removals") == [(0, "f-4", 56), (0, "f1", 35), (6, "f1", 36), (7, "f1", 1), (8, "f1", 1), (8, "f2", 2)]
    assert pairs("additions") == [(0, "f9", 1)]
    assert [(x["album_id"], x["name"], x["file_ids"]) for x in got["albums"].orderBy("pos").collect()] == [("x", "Untitled album", []), ("y", "%zz", ["f1", "f2"]), ("z", "a+b", [])]


def test_scopes_of_a_table_read_as_one_scope(spark):
    rng = random.Random(6)
    some = lambda xs: rng.choice([None, [], xs[:1], xs])
    rows = [(i, some(["a", "b"]), some(["t", "u", "v"]), some(["x", "y"]), some(["image", "video"])) for i in range(60)]
    g = spark.createDataFrame(rows, "id int, path_prefixes array<string>, include_tags array<string>, exclude_tags array<string>, media_types array<string>")
    got = {r["id"]: r["words"] for r in tenancy.scopes_described(g).collect()}
    assert got == {i: selection.describe_scope(selection.Scope(p or [], t or [], x or [], m or [])) for i, p, t, x, m in rows}
