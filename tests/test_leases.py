"""Leases with timers: outcomes against a plain replay, for any batches, with workers that are lost."""

from __future__ import annotations

import random

from granary.operators import reconcile
from granary.streaming import streams

LEASE, LATE_S = 40_000, 100


def replay(events, mark):
    """The same outcomes from a list of all events, one file after another."""
    out = []
    for file in sorted({e[0] for e in events}):
        queued, holder, end = False, None, None
        for _, i, at, worker, what in sorted((e for e in events if e[0] == file and e[2] < mark), key=lambda e: (e[2], e[1])):
            if holder is not None and at > end:
                out.append((file, None, end, holder, "expired"))
                queued, holder = True, None
            if what == "queue":
                got = "queued" if holder is None else "held"
                queued = queued or holder is None
            elif what == "claim":
                got = "claimed" if queued and worker else "refused"
                if got == "claimed":
                    queued, holder, end = False, worker, at + LEASE
            elif holder is None or worker != holder:
                got = "late"
            else:
                got, queued, holder = ("released" if what == "fail" else "completed"), what == "fail", None
            out.append((file, i, at, worker, got))
        if holder is not None and end < mark:
            out.append((file, None, end, holder, "expired"))
    return sorted(out, key=str)


def test_leases_do_not_depend_on_batches(spark, tmp_path):
    rng = random.Random(5)
    events = [(f"f{rng.randint(0, 5)}", i, 1_000_000 + 7_000 * (i // 2), rng.choice(["w1", "w2", None]) if rng.random() < 0.95 else "w3", rng.choice(["queue", "claim", "claim", "done", "fail"])) for i in range(400)]
    want = replay(events, max(e[2] for e in events) - LATE_S * 1000)
    assert {w[4] for w in want} == {"queued", "held", "claimed", "refused", "released", "completed", "late", "expired"}
    for deal in (1, 5):
        src, out, state = (str(tmp_path / f"{n}{deal}") for n in ("in", "out", "state"))
        # neighbours within the allowed delay change places between batches
        order = sorted(events, key=lambda e: e[2] + rng.randint(0, 40_000))
        for b in range(deal):
            part = order[len(order) * b // deal : len(order) * (b + 1) // deal]
            spark.createDataFrame(part, "file string, id long, at long, worker string, what string").selectExpr("file", "id", "timestamp_millis(at) AS ts", "worker", "what").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("file string, id long, ts timestamp, worker string, what string").option("maxFilesPerTrigger", 1).parquet(src)
        got = streams.leases(stream, lease_ms=LEASE, late=f"{LATE_S} seconds")
        got.writeStream.option("checkpointLocation", state).trigger(availableNow=True).start(out, format="parquet").awaitTermination()
        rows = [tuple(r) for r in spark.read.schema(got.schema).parquet(out).collect()]
        assert sorted(rows, key=str) == want


FILES = "root string, rel_path string, asset_id string, state string, priority int, lease_owner string, lease_expires_at long"


def test_a_table_lease_is_kept_until_it_expires(spark):
    rows = [("r", f"p{i}", f"a{i // 2}", "queued" if i % 7 else "indexed", 100 - i % 3, None, None) for i in range(20)]
    files = spark.createDataFrame(rows, FILES)
    one = reconcile.lease(files, "w1", 5, now=1000, lease_s=60)
    two = reconcile.lease(one, "w2", 50, now=1060, lease_s=60)
    held = {r["rel_path"]: r["lease_owner"] for r in two.collect()}
    queue = sorted((p, path) for _, path, _, state, p, *_ in rows if state == "queued")
    assert {p for p, o in held.items() if o == "w1"} == {path for _, path in queue[:5]}
    assert {p for p, o in held.items() if o == "w2"} == {path for _, path in queue[5:]}
    again = reconcile.lease(two, "w3", 50, now=1061, lease_s=60)
    assert {r["rel_path"] for r in again.filter("lease_owner = 'w3'").collect()} == {path for _, path in queue[:5]}
    tasks = [r["asset_id"] for r in reconcile.tasks(two, "w2", now=1070).collect()]
    assert sorted(tasks) == sorted({f"a{int(path[1:]) // 2}" for _, path in queue[5:]})
    assert reconcile.tasks(two, "w1", now=1061).count() == 0
