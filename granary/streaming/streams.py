"""Streams: incremental ingestion, event windows, sessions, and token buckets and leases with state."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Mapping
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from granary.session import exists


def ingest(spark: SparkSession, source: str, schema: str, checkpoint: str, step: Callable[[DataFrame, int], None], *, files_per_trigger: int = 1000):
    """Run ``step`` on every batch of new Parquet files until none is left; a restart goes on where it stopped."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def quarantined(rules: Mapping[str, Column], out: str) -> Callable[[DataFrame, int], None]:
    """A step for ``ingest`` that writes the rows that pass all rules, and those that fail one with its name, once each.

    Below ``out``, a batch has its own folders of ``rows`` and ``errors``, which a repeated attempt
    overwrites, and a mark in ``commits``, written last. A batch with a mark is skipped, so a
    stream that is killed anywhere and starts again adds each row once; one bad row does not hold up the others.
    A rule that gives null is broken.
    """
    error = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()], F.lit(None).cast("string"))

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if exists(spark, f"{out}/commits/batch={number}/_SUCCESS"):
            return
        judged = batch.withColumn("error", error)
        judged.filter("error IS NULL").drop("error").write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        judged.filter("error IS NOT NULL").write.mode("overwrite").parquet(f"{out}/errors/batch={number}")
        spark.range(1).write.mode("overwrite").parquet(f"{out}/commits/batch={number}")

    return step


def committed(spark: SparkSession, out: str, what: str = "rows") -> DataFrame:
    """The ``rows`` or ``errors`` of the committed batches below ``out``, with the number of their batch."""
    done = spark.read.schema("id long, batch long").parquet(f"{out}/commits").select("batch").distinct()
    return spark.read.parquet(f"{out}/{what}").join(F.broadcast(done), "batch", "left_semi")  # one row a batch


def _time(events: DataFrame, ts: str) -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def tumbling(events: DataFrame, ts: str = "ts", every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events per fixed window and type; works on streams (late rows are dropped) and on tables."""
    e = _time(events, ts)
    e = e.withWatermark(ts, late) if e.isStreaming else e
    return e.groupBy(F.window(ts, every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.unix_seconds("w.start").alias("start"), "event_type", "n", "total")


def sliding_rate(events: DataFrame, ts: str = "ts", width: str = "6 hours", every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events per second over sliding windows: progress and rate displays."""
    e = _time(events, ts)
    e = e.withWatermark(ts, late) if e.isStreaming else e
    g = e.groupBy(F.window(ts, width, every).alias("w")).agg(F.count("*").alias("n"))
    return g.select(F.unix_seconds("w.start").alias("start"), "n", (F.col("n") / (F.unix_seconds("w.end") - F.unix_seconds("w.start"))).alias("rate"))


def sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of each key: runs of events with gaps below ``gap``."""
    e = _time(events, ts)
    e = e.withWatermark(ts, late) if e.isStreaming else e
    g = e.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(key, F.unix_seconds("w.start").alias("start"), F.unix_seconds("w.end").alias("end"), "n", "total")


def take_tokens(tokens: float, last: float, now: float, *, rate: float, size: float) -> tuple[bool, float]:
    """Whether a request passes a bucket of ``size`` that fills at ``rate`` a second, and what is left."""
    tokens = min(size, tokens + max(0.0, now - last) * rate)
    return (True, tokens - 1) if tokens >= 1 else (False, tokens)


BUCKET = "key string, at double, allowed boolean, left double"


def token_bucket(requests: DataFrame, *, rate: float = 0.5, size: float = 5.0, daily: int | None = None) -> DataFrame:
    """Limit requests(key string, at double) of each key; state per key survives restarts of a stream.

    ``daily`` caps the requests of a UTC day besides. A batch's requests of a key are taken by time,
    however many Arrow batches Spark hands them over in: their times are put together and sorted first.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last, day, used = state.get if state.exists else (size, 0.0, -1, 0)
        times = np.sort(np.concatenate([pdf["at"].to_numpy() for pdf in parts]))
        oks, lefts = [], []
        for at in times.tolist():
            if int(at // 86400) != day:
                day, used = int(at // 86400), 0
            ok, tokens = take_tokens(tokens, last, at, rate=rate, size=size)
            if ok and daily is not None and used >= daily:
                ok, tokens = False, tokens + 1
            used += ok
            last = at
            oks.append(ok)
            lefts.append(tokens)
        yield pd.DataFrame({"key": key[0], "at": times, "allowed": oks, "left": lefts})
        state.update((tokens, last, day, used))

    return requests.groupBy("key").applyInPandasWithState(run, BUCKET, "tokens double, last double, day long, used long", "append", GroupStateTimeout.NoTimeout)


#: What a file's lease remembers between batches: its state, who holds it and until when, and events not judged yet.
LEASE_STATE = "status string, owner string, until long, ids array<long>, ats array<long>, workers array<string>, whats array<string>"
LEASES = "file string, id long, at long, worker string, outcome string"


def take_event(status: str, owner: str | None, until: int, event: tuple, lease_ms: int) -> tuple[str, str | None, int, str]:
    """The state of a file after (at, id, worker, what), and what came of the event; an expired lease is queued before.

    Whoever claims a queued file holds it for ``lease_ms``. Results count only from the holder.
    """
    at, _, worker, what = event
    if what == "queue":
        return (status, owner, until, "held") if status == "leased" else ("queued", None, 0, "queued")
    if what == "claim":
        return ("leased", worker, at + lease_ms, "claimed") if status == "queued" and worker is not None else (status, owner, until, "refused")
    if status != "leased" or owner != worker:
        return status, owner, until, "late"
    return ("queued", None, 0, "released") if what == "fail" else ("done", None, 0, "completed")


def leases(events: DataFrame, *, lease_ms: int = 600_000, late: str = "1 hour") -> DataFrame:
    """The outcome of each event on files' leases, and a row ``expired`` for each lease that ran out.

    events(file string, id long, ts timestamp, worker string, what string), what one of queue,
    claim, fail and done. Outcomes: queued, held (queued while leased), claimed, refused, released,
    completed, late (from a worker that does not hold the lease), expired (id null, at the end of the
    lease, by its holder). A file nobody queued cannot be claimed, and a null worker claims nothing. A lease holds up to and with its last
    millisecond. Events wait in the state until the watermark has passed them and are then taken
    by time and id, so outcomes do not depend on how events fall into batches; what comes later than
    ``late`` is dropped by the watermark. A worker that is lost sends nothing: a timer on the watermark
    ends its lease. Rows without file, ts or what are left out; other values of what are an error.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, owner, until, *held = state.get if state.exists else ("new", None, 0, [], [], [], [])
        ids, ats, workers, whats = held
        waiting = list(zip(ats, ids, workers, whats, strict=True))
        for pdf in parts:
            each = (pdf[c].tolist() for c in ("at", "id", "worker", "what"))  # plain values, not one boxed at a time
            waiting += [(int(a), int(i), None if w is None else str(w), str(x)) for a, i, w, x in zip(*each, strict=True)]
        mark, rows = state.getCurrentWatermarkMs(), []
        waiting.sort(key=itemgetter(0, 1))
        ripe = waiting[: bisect_left(waiting, mark, key=itemgetter(0))]

        def expire(now: int) -> None:
            nonlocal status, owner, until
            if status == "leased" and until < now:
                rows.append((key[0], None, until, owner, "expired"))
                status, owner, until = "queued", None, 0

        for e in ripe:
            expire(e[0])
            status, owner, until, outcome = take_event(status, owner, until, e, lease_ms)
            rows.append((key[0], e[1], e[0], e[2], outcome))
        expire(mark)
        waiting = waiting[len(ripe):]
        columns = [list(x) for x in zip(*waiting, strict=True)] or [[], [], [], []]
        state.update((status, owner, until, columns[1], columns[0], columns[2], columns[3]))
        timers = [waiting[0][0]] if waiting else []
        if status == "leased":
            timers.append(until)
        if timers:
            state.setTimeoutTimestamp(max(min(timers), mark + 1))
        if rows:
            _, ids, ats, workers, outcomes = zip(*rows, strict=True)
            yield pd.DataFrame({"file": key[0], "id": pd.array(ids, dtype="Int64"), "at": pd.array(ats, dtype="int64"), "worker": workers, "outcome": outcomes})

    known = F.col("what").isin("queue", "claim", "fail", "done")
    e = events.filter("file IS NOT NULL AND ts IS NOT NULL AND what IS NOT NULL").withWatermark("ts", late)
    what = F.when(known, F.col("what")).otherwise(F.raise_error(F.concat(F.lit("unknown event: "), F.col("what"))))
    e = e.select("file", "id", "ts", F.unix_millis("ts").alias("at"), "worker", what.alias("what"))
    return e.groupBy("file").applyInPandasWithState(run, LEASES, LEASE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def budgets(requests: DataFrame, daily: int) -> DataFrame:
    """Requests of each key and UTC day against a cap."""
    return requests.groupBy("key", F.floor(F.col("at") / 86400).alias("day")).agg(F.count("*").alias("used")).withColumn("left", F.greatest(F.lit(0), F.lit(daily) - F.col("used")))
