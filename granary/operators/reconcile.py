"""Scans against the catalogue: upserts, the sweep for missing files, moves, binding, failures, ledgers.

Parquet tables know no MERGE, so each step is a function from old rows and a delta to new rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.session import materialize

#: The states of a file and those that may follow each.
STATES = {
    "queued": ("queued", "indexed", "error", "missing"),
    "indexed": ("queued", "missing", "error", "indexed"),
    "error": ("queued", "missing", "error"),
    "missing": ("queued", "indexed", "missing", "error"),
}
#: Why a file failed; of these the errors that may be retried, attempts, and priorities (lower comes first).
ERRORS = ("unreadable", "corrupt", "unsupported", "encrypted", "timeout", "worker_crash", "too_large", "mutated", "dependency", "internal")
RETRYABLE = ("unreadable", "timeout", "worker_crash", "dependency", "mutated")
MAX_ATTEMPTS = 3
RECENT, NORMAL, RETRY, HUGE = 80, 100, 200, 300
HUGE_BYTES, RECENT_SECONDS = 2 << 30, 30 * 86400
KEY = ["root", "rel_path"]


def upsert(old: DataFrame, listing: DataFrame, scan_id: int) -> DataFrame:
    """Files after a scan: changed, new and reappeared paths are queued; unseen paths keep their row.

    A changed path loses its content, so it is hashed again. The join is one full outer join on the path.
    """
    n = listing.select(*KEY, *[F.col(c).alias(f"new_{c}") for c in ("name", "ext", "size_bytes", "mtime_ns")])
    j = old.join(n, KEY, "full_outer")
    seen = F.col("new_size_bytes").isNotNull()
    new = F.col("size_bytes").isNull()
    changed = seen & (new | (F.col("size_bytes") != F.col("new_size_bytes")) | (F.col("mtime_ns") != F.col("new_mtime_ns")))
    queued = changed | (seen & (F.col("state") == "missing"))
    return j.select(
        *KEY, F.coalesce("new_name", "name").alias("name"), F.coalesce("new_ext", "ext").alias("ext"), F.coalesce("new_size_bytes", "size_bytes").alias("size_bytes"), F.coalesce("new_mtime_ns", "mtime_ns").alias("mtime_ns"),
        F.when(~changed, F.col("asset_id")).alias("asset_id"), F.when(queued, "queued").otherwise(F.col("state")).alias("state"), F.when(changed, 0).otherwise(F.col("attempts")).alias("attempts"),
        F.when(seen, F.lit(scan_id).cast("long")).otherwise(F.col("last_scan_id")).alias("last_scan_id"),
    )


def sweep(files: DataFrame, scan_id: int, roots: list[str] | None = None) -> DataFrame:
    """Paths of the scanned roots that this scan did not see are missing."""
    gone = (F.col("state") != "missing") & (F.col("last_scan_id").isNull() | (F.col("last_scan_id") != scan_id))
    if roots is not None:
        gone = gone & F.col("root").isin(roots)
    return files.withColumn("state", F.when(gone, "missing").otherwise(F.col("state")))


def moves(files: DataFrame) -> DataFrame:
    """(root, old path, new path): a missing file and a queued one of equal size and time, paired one to one.

    Ambiguous files are paired in path order on both sides.
    """
    same = ["root", "size_bytes", "mtime_ns"]
    w = Window.partitionBy(*same).orderBy("rel_path")
    gone = files.filter("state = 'missing'").select(*same, F.col("rel_path").alias("old_path"), F.row_number().over(w).alias("k"))
    come = files.filter("state = 'queued' AND asset_id IS NULL").select(*same, F.col("rel_path").alias("new_path"), F.row_number().over(w).alias("k"))
    return gone.join(come, [*same, "k"]).select("root", "old_path", "new_path")


def apply_moves(files: DataFrame, moved: DataFrame) -> DataFrame:
    """The missing row takes the new path and is indexed, and the queued row goes."""
    out = files.join(moved.select("root", F.col("new_path").alias("rel_path")), KEY, "left_anti")
    out = out.join(moved.select("root", F.col("old_path").alias("rel_path"), "new_path"), KEY, "left")
    hit = F.col("new_path").isNotNull()
    return out.withColumns({"rel_path": F.coalesce("new_path", "rel_path"), "name": F.when(hit, F.regexp_extract("new_path", r"[^/]*$", 0)).otherwise(F.col("name")), "state": F.when(hit & F.col("asset_id").isNotNull(), "indexed").when(hit, "queued").otherwise(F.col("state"))}).drop("new_path")


def stamped(old: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """New rows with the times at which files became indexed or missing."""
    o = old.select(*KEY, F.col("state").alias("was"), "indexed_at", "missing_since")
    j = new.drop("indexed_at", "missing_since").join(o, KEY, "left")
    turned = ~F.col("state").eqNullSafe(F.col("was"))
    return j.withColumn("indexed_at", F.when(turned & (F.col("state") == "indexed"), F.lit(now)).otherwise(F.col("indexed_at"))).withColumn("missing_since", F.when(turned & (F.col("state") == "missing"), F.lit(now)).when(F.col("state") != "missing", None).otherwise(F.col("missing_since"))).drop("was")


def priority(size: str = "size_bytes", mtime_ns: str = "mtime_ns", *, now: int):
    """Huge files last, recent ones first."""
    return F.when(F.col(size) >= HUGE_BYTES, HUGE).when(F.col(mtime_ns) / 1e9 > now - RECENT_SECONDS, RECENT).otherwise(NORMAL)


def legal(before: Column, after: Column) -> Column:
    """Whether a file in one state may turn to another; false for unknown states."""
    out = F.lit(False)
    for state, following in STATES.items():
        out = out | ((before == state) & after.isin(*following))
    return F.coalesce(out, F.lit(False))


def transition(files: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files after changes (root, rel_path, to) that are legal, and the changes that are not."""
    j = files.join(changes.select(*KEY, "to"), KEY, "left")
    ok = legal(F.col("state"), F.col("to"))
    return j.withColumn("state", F.when(ok, F.col("to")).otherwise(F.col("state"))).drop("to"), j.filter(F.col("to").isNotNull() & ~ok).select(*KEY, "state", "to")


def route_failures(files: DataFrame, failures: DataFrame) -> DataFrame:
    """Files after failed attempts (root, rel_path, error): retryable ones queue again, up to three attempts."""
    j = files.join(failures.select(*KEY, "error"), KEY, "left")
    failed = F.col("error").isNotNull()
    tries = F.col("attempts") + F.when(failed, 1).otherwise(0)
    again = failed & F.col("error").isin(*RETRYABLE) & (tries < MAX_ATTEMPTS)
    return j.withColumns({"state": F.when(again, "queued").when(failed, "error").otherwise(F.col("state")), "priority": F.when(again, F.greatest(F.col("priority"), F.lit(RETRY))).otherwise(F.col("priority")), "attempts": tries}).drop("error")


def new_assets(assets: DataFrame, hashed: DataFrame) -> DataFrame:
    """Contents of hashed files that the catalogue does not hold yet, one row each."""
    return hashed.groupBy("asset_id").agg(F.min("size_bytes").alias("size_bytes"), F.min("media_type").alias("media_type")).join(assets.select("asset_id"), "asset_id", "left_anti")


def bind(files: DataFrame, hashed: DataFrame, assets: DataFrame) -> DataFrame:
    """Files with their content; a file whose content is complete is indexed at once."""
    h = hashed.select(*KEY, F.col("asset_id").alias("found"))
    done = assets.filter("pipeline_state = 'complete'").select(F.col("asset_id").alias("found"), F.lit(True).alias("done"))
    j = files.join(h, KEY, "left").join(done, "found", "left")
    return j.withColumns({"asset_id": F.coalesce("found", "asset_id"), "state": F.when(F.col("found").isNotNull() & F.col("done"), "indexed").otherwise(F.col("state"))}).drop("found", "done")


def complete(files: DataFrame, finished: DataFrame) -> DataFrame:
    """Every queued copy of a finished content is indexed."""
    f = finished.select("asset_id").distinct().withColumn("done", F.lit(True))
    return files.join(f, "asset_id", "left").withColumn("state", F.when((F.col("state") == "queued") & F.col("done"), "indexed").otherwise(F.col("state"))).drop("done")


def claim(files: DataFrame, n: int) -> DataFrame:
    """The next ``n`` files to work on, one for each content (files without content each count)."""
    w = Window.partitionBy(F.coalesce("asset_id", F.concat_ws("/", *KEY))).orderBy("priority", *KEY)
    return files.filter("state = 'queued'").withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k").orderBy("priority", *KEY).limit(n)


def lease(files: DataFrame, owner: str, n: int, *, now: int, lease_s: int = 600, stage: Column | None = None) -> DataFrame:
    """Files after ``owner`` took the next ``n`` queued ones (of a stage) that nobody holds for ``lease_s`` seconds.

    A lease that ended before ``now`` holds nothing. Only the least ``n`` keys travel: each task brings its own n best.
    """
    free = (F.col("state") == "queued") & (F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") < now))
    taken = files.filter(free if stage is None else free & stage).select("priority", *KEY).orderBy("priority", *KEY).limit(n)
    j = files.join(taken.select(*KEY).withColumn("_taken", F.lit(True)), KEY, "left")
    return j.withColumns({"lease_owner": F.when(F.col("_taken"), owner).otherwise(F.col("lease_owner")), "lease_expires_at": F.when(F.col("_taken"), F.lit(now + lease_s).cast("long")).otherwise(F.col("lease_expires_at"))}).select(*files.columns)


def tasks(files: DataFrame, owner: str, *, now: int) -> DataFrame:
    """What a worker has to do under its live leases: of the copies of a content only the first (files without content each count)."""
    mine = files.filter((F.col("lease_owner") == owner) & (F.col("state") == "queued") & (F.col("lease_expires_at") >= now))
    w = Window.partitionBy(F.coalesce("asset_id", F.concat_ws("/", *KEY))).orderBy("priority", *KEY)
    return mine.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def gathered(claimed: DataFrame, blocks: DataFrame, runs: DataFrame, hints: DataFrame) -> DataFrame:
    """Claimed files with what their work needs: texts in order, the versions already run, and the hints of their content."""
    text = blocks.groupBy("asset_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "ord", "body"))), lambda x: x["body"]), "\n").alias("text"))
    done = runs.filter("status IN ('ok', 'unsupported', 'error')").groupBy("asset_id", "extractor").agg(F.max("version").alias("version")).groupBy("asset_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("extractor", "version")))).alias("done"))
    hint = hints.groupBy("asset_id").agg(F.array_sort(F.collect_set("hint")).alias("hints"))
    return claimed.join(text, "asset_id", "left").join(done, "asset_id", "left").join(hint, "asset_id", "left")


def merge_tags(old: DataFrame, new: DataFrame) -> DataFrame:
    """Tag facts by content, tag and source; the greater confidence and count stay."""
    key = ["asset_id", "kind", "name", "source"]
    return old.select(*key, "confidence", "instances").unionByName(new.select(*key, "confidence", "instances")).groupBy(*key).agg(F.max("confidence").alias("confidence"), F.max("instances").alias("instances"))


def merge_rows(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows by key, column by column: a new value replaces the old, a missing one keeps it."""
    rest = [c for c in old.columns if c not in key]
    n = new.select(*key, *[F.col(c).alias(f"_{c}") for c in rest if c in new.columns])
    return old.join(n, key, "full_outer").select(*key, *[F.coalesce(f"_{c}", c).alias(c) if c in new.columns else F.col(c) for c in rest])


def replace_blocks(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Blocks of the same content and extractor are overwritten, not appended."""
    return old.join(new.select(*by).distinct(), by, "left_anti").unionByName(new)


#: The tables that extractors may write, and the key of each.
SINKS = {t: ["asset_id"] for t in ("image_meta", "video_meta", "audio_meta", "doc_meta", "geo", "finding")} | {"thumbnail": ["asset_id", "kind"], "text_block": ["asset_id", "source", "ord"], "color": ["asset_id", "rank"]}


def sink(tables: Mapping[str, DataFrame], rows: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables after an extractor's rows, merged by the key of each table; other tables are an error."""
    if unknown := set(rows) - set(SINKS):
        raise ValueError(f"no rows may go to {sorted(unknown)}")
    return dict(tables) | {t: merge_rows(tables[t], r, SINKS[t]) if t in tables else r for t, r in rows.items()}


def intern_tags(tags: DataFrame, facts: DataFrame) -> DataFrame:
    """The tag table with the tags that facts bring, named for display."""
    fresh = facts.select("kind", "name").distinct().join(tags.select("kind", "name"), ["kind", "name"], "left_anti")
    return tags.unionByName(fresh.withColumn("display", F.initcap(F.regexp_replace("name", "[-_]", " "))))


def with_ids(known: DataFrame, fresh: DataFrame, key: Sequence[str], id_col: str = "id") -> DataFrame:
    """``known`` (key, id) with the keys of ``fresh`` that it lacks, numbered on from its greatest id in order of the key.

    A number is the place of a key among all new ones: counts of sorted ranges, of which each task
    has one, give the offsets, so the same keys get the same numbers however they are dealt, and a
    load that is repeated adds none.
    """
    key = list(key)
    last = known.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
    new = fresh.select(*key).distinct().join(known.select(*key), key, "left_anti")
    new = materialize(new.repartitionByRange(*key).withColumn("_part", F.spark_partition_id()), "new-keys")
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    offsets = new.groupBy("_part").agg(F.count("*").alias("n")).select("_part", before.alias("_off"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*key))
    numbered = new.join(F.broadcast(offsets), "_part").select(*key, (F.lit(last) + F.col("_off") + place).cast("long").alias(id_col))
    return known.select(*key, F.col(id_col).cast("long").alias(id_col)).unionByName(numbered)


def latest(rows: DataFrame, key: list[str], by: str) -> DataFrame:
    """The last row of each key: ledgers and cached summaries."""
    w = Window.partitionBy(*key).orderBy(F.desc(by))
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def backlog(assets: DataFrame, runs: DataFrame, versions: DataFrame) -> DataFrame:
    """(asset, extractor) that never ran, or ran in an older version; skipped runs come again."""
    done = runs.filter("status IN ('ok', 'unsupported', 'error')").groupBy("asset_id", "extractor").agg(F.max("version").alias("had"))
    want = assets.select("asset_id", "media_type").join(F.broadcast(versions), F.array_contains("media_types", F.col("media_type"))).select("asset_id", "extractor", "version")
    return want.join(done, ["asset_id", "extractor"], "left").filter(F.col("had").isNull() | (F.col("had") < F.col("version"))).select("asset_id", "extractor", "version")


def set_tag(asset_tag: DataFrame, contents: DataFrame, kind: str, name: str) -> DataFrame:
    """A person's tag on given contents."""
    new = contents.select("asset_id", F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.lit("user").alias("source"), F.lit(1.0).alias("confidence"), F.lit(1).alias("instances"))
    return merge_tags(asset_tag, new)


def unset_tag(asset_tag: DataFrame, contents: DataFrame, kind: str, name: str) -> DataFrame:
    """Without a person's tag on given contents; what the machine found stays."""
    gone = contents.select("asset_id", F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.lit("user").alias("source")).distinct()
    return asset_tag.join(gone, ["asset_id", "kind", "name", "source"], "left_anti")


def pruned(tags: DataFrame, asset_tag: DataFrame) -> DataFrame:
    """The tag table without people's own tags that no content bears any more."""
    used = asset_tag.select("kind", "name").distinct()
    return tags.filter("kind <> 'custom'").unionByName(tags.filter("kind = 'custom'").join(used, ["kind", "name"], "left_semi"))


def forget(files: DataFrame, by_asset: dict[str, DataFrame], root: str, keep_metadata: bool = False) -> tuple[DataFrame, dict[str, DataFrame]]:
    """A catalogue without one root: its files go, and what hangs only on them unless it is kept."""
    rest = files.filter(F.col("root") != root)
    if keep_metadata:
        return rest, dict(by_asset)
    orphans = orphaned(files, root)
    return rest, {k: v.join(orphans, "asset_id", "left_anti") for k, v in by_asset.items()}


def orphaned(files: DataFrame, root: str) -> DataFrame:
    """Contents that only files of ``root`` hold."""
    mine = files.filter((F.col("root") == root) & F.col("asset_id").isNotNull()).select("asset_id").distinct()
    return mine.join(files.filter(F.col("root") != root).select("asset_id"), "asset_id", "left_anti")


def audit(before: DataFrame, after: DataFrame) -> DataFrame:
    """What happened to each file while it was read: unchanged, mutated or vanished."""
    a = after.select(*KEY, F.col("size_bytes").alias("s2"), F.col("mtime_ns").alias("m2"))
    verdict = F.when(F.col("s2").isNull(), "vanished").when((F.col("s2") != F.col("size_bytes")) | (F.col("m2") != F.col("mtime_ns")), "mutated").otherwise("unchanged")
    return before.join(a, KEY, "left").select(*KEY, verdict.alias("verdict"))
