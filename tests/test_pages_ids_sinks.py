"""Page totals, surrogate ids, grants by a prefix join, and a sink that survives being killed."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from granary.operators import reconcile, selection, tenancy
from granary.plans.catalog import Catalog
from granary.streaming import streams


def test_page_counts_the_selection_and_knows_the_next(spark):
    files = spark.createDataFrame([(i, f"n{i}", "a", "indexed" if i % 5 else "missing", "txt") for i in range(1, 40)], "file_id long, name string, asset_id string, state string, ext string")
    c = Catalog(files, files, files, files, files)
    ids = [i for i in range(1, 40) if i % 5]
    got, cursor = [], None
    while True:
        p = selection.page(c, selection.FilterSpec(ext="txt", cursor=cursor), size=7)
        assert p.total == len(ids) and len(p.items) <= 7
        got += [r["file_id"] for r in p.items]
        if (cursor := p.next) is None:
            break
    assert got == ids
    empty = selection.page(c, selection.FilterSpec(ext="pdf"))
    assert empty == ([], 0, None)


def test_ids_go_on_and_do_not_change(spark):
    rng = random.Random(1)
    keys = [f"k{i}" for i in range(300)]
    known = spark.createDataFrame([], "key string, id long")
    seen = {}
    for share in (0.3, 0.7, 0.7, 1.0):
        load = [k for k in keys if rng.random() < share] * 2
        fresh = sorted(set(load) - seen.keys())
        seen |= {k: len(seen) + i + 1 for i, k in enumerate(fresh)}
        parts = rng.choice((1, 5, 9))
        known = reconcile.with_ids(known, spark.createDataFrame([(k,) for k in load], "key string").repartition(parts), ["key"])
        assert {r["key"]: r["id"] for r in known.collect()} == seen


GRANT = "workspace_id string, library_id string, path_prefixes array<string>, include_tags array<string>, exclude_tags array<string>, media_types array<string>"


def test_ten_thousand_grants_meet_paths_by_prefix(spark):
    rng = random.Random(2)
    some = lambda xs, p: [x for x in xs if rng.random() < p] or (None if rng.random() < 0.2 else [])
    files = [(i, f"l{rng.randint(0, 3)}", "/".join(rng.choice("abc") for _ in range(rng.randint(1, 4))), rng.choice(["image", "video", None])) for i in range(120)]
    tags = [(i, t) for i, *_ in files for t in "wxyz" if rng.random() < 0.3]
    paths = ["a", "a/", "b/c", "c/a/b", "", "abc", "a/b"]
    grants = [(f"w{rng.randint(0, 40)}", f"l{rng.randint(0, 4)}", some(paths, 0.2), some("wx", 0.3), some("yz", 0.3), some(["image", "video"], 0.3)) for _ in range(10_000)]
    of = {i: {t for j, t in tags if j == i} for i, *_ in files}
    want = set()
    for w, lib, pre, inc, exc, media in set((a, b, *(tuple(x or ()) for x in r)) for a, b, *r in grants):
        for i, own, path, kind in files:
            if own == lib and (not pre or any(path.startswith(p) for p in pre)) and (not media or kind in media) and (not inc or set(inc) & of[i]) and not set(exc) & of[i]:
                want.add((w, i))
    f = spark.createDataFrame(files, "file_id long, library_id string, rel_path string, media_type string")
    got = tenancy.visible(f, spark.createDataFrame(tags, "file_id long, name string"), spark.createDataFrame(grants, GRANT))
    assert {(r["workspace_id"], r["file_id"]) for r in got.collect()} == want and got.count() == len(want)
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_a_sink_killed_anywhere_has_each_row_once(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.range(60).withColumn("v", F.when(F.col("id") % 7 != 0, F.col("id"))).repartition(4).write.parquet(src)
    step = streams.quarantined({"no v": F.col("v").isNotNull(), "large": F.col("v") < 50}, out)
    calls = iter((True, False, True, False, False, True))

    def killed(batch, number):
        if next(calls, False):  # after the rows, before the mark
            batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
            raise RuntimeError("killed")
        step(batch, number)
        if next(calls, False):  # after the mark, before the stream notes it
            raise RuntimeError("killed")

    for _ in range(12):
        try:
            streams.ingest(spark, src, "id long, v long", state, killed, files_per_trigger=1)
            break
        except Exception:  # noqa: BLE001
            continue
    else:
        pytest.fail("the stream did not end")
    rows = sorted(r["id"] for r in streams.committed(spark, out).collect())
    errors = sorted((r["id"], r["error"]) for r in streams.committed(spark, out, "errors").collect())
    assert rows == [i for i in range(50) if i % 7] and errors == sorted((i, "no v" if i % 7 == 0 else "large") for i in range(60) if i % 7 == 0 or i >= 50)
