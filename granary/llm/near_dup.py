"""MinHash near-duplicates by an inverted join of signature coordinates, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import ROW, WordHashes, map_groups, map_rows, possibly_in, row_key, salted_join, shingles, words_of
from granary.llm.components import components
from granary.session import Scratch, materialize

SHINGLE, SIMILAR = 5, 0.75
#: Coordinates of a signature, and how many must collide. A pair at 0.75 misses 32 of 64 with
#: probability about 1e-5; by the prefix rule such a pair shares one of the 33 rarest coordinates of both.
COORDINATES, MATCHES = 64, 32
PREFIX = COORDINATES - MATCHES + 1
#: Counters of coordinate values for the order of rarity: a fixed size, whatever the corpus.
BUCKETS = 1 << 16
#: Rows of a chunk of a large family, which its leader visits, and of a block of rows that are compared with each other.
CHUNK, BLOCK = 256, 1000

_RNG = np.random.default_rng(20_240_501)
_A = _RNG.integers(1, 1 << 32, COORDINATES, np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, COORDINATES, np.uint32)


def signature(s: np.ndarray) -> np.ndarray:
    """The least of COORDINATES hashes over a set, each from the two halves of a shingle's hash."""
    lo, hi = (s & np.uint64(0xFFFFFFFF)).astype(np.uint32), (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(s), 1024):
        x = lo[at : at + 1024, None] * _A
        x ^= x >> np.uint32(15)
        x += hi[at : at + 1024, None] + _B
        x *= np.uint32(0x85EBCA6B)
        np.minimum(out, x.min(0), out=out)
    return out


def set_of(text: str | None, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    return shingles(hashes.of(words_of(text or "")), size)


def set_class(s: np.ndarray) -> int:
    """The id of a class of equal sets: 63 bits of a hash of the sorted set."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) >> 1


def tokens_of(sig: np.ndarray) -> np.ndarray:
    """(rows, COORDINATES) ids of coordinate-value pairs."""
    x = (sig.astype(np.uint64) << np.uint64(6)) | np.arange(COORDINATES, dtype=np.uint64)
    return x.astype(np.int64)


def _bucket(tokens: np.ndarray) -> np.ndarray:
    x = tokens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(48)).astype(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, two hashes of the row, n, cls, sig) of every row."""

    def start():
        hashes = WordHashes()

        def step(cols):
            sets = [set_of(t, hashes) for t in cols["text"]]
            out = {c: cols[c] for c in ("doc_id", *ROW)}
            return out | {"n": [len(s) for s in sets], "cls": [set_class(s) for s in sets], "sig": [signature(s).tobytes() if len(s) else None for s in sets]}

        return step

    rows = docs.withColumns(row_key(id_col, text_col)).selectExpr(f"`{id_col}` AS doc_id", *ROW, f"`{text_col}` AS text")
    return map_rows(rows, start, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {ROW[0]} long, {ROW[1]} long, n long, cls long, sig binary")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def rarity(classes: DataFrame) -> np.ndarray:
    """How often the coordinate values of each bucket occur; any fixed order would keep the prefix rule exact."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            total += np.bincount(_bucket(tokens_of(_matrix(b.column(0)))).ravel(), minlength=BUCKETS)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 50_000]), pa.array(total[at[i : i + 50_000]])], names=["bucket", "n"])

    got = classes.select("sig").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return np.minimum(out, (1 << 31) - 1).astype(np.int32)


def postings(classes: DataFrame) -> DataFrame:
    """(token, cls): every class under the PREFIX rarest of its coordinate-value pairs."""
    held = classes.sparkSession.sparkContext.broadcast(rarity(classes))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                t = tokens_of(_matrix(b.column(1)))
                order = np.lexsort((t, held.value[_bucket(t)]), axis=1)[:, :PREFIX]
                t = np.take_along_axis(t, order, 1)
                yield pa.RecordBatch.from_arrays([pa.array(t.ravel()), pa.array(np.repeat(b.column(0).to_numpy(zero_copy_only=False), PREFIX))], names=["token", "cls"])

    return classes.select("cls", "sig").mapInArrow(post, "token long, cls long")


def collide(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` and ``b`` collide in MATCHES coordinates.

    The coordinates are merged in three steps; a pair is skipped as soon as those that remain
    cannot bring its count to MATCHES.
    """
    live, count = np.arange(len(b)), np.zeros(len(b), np.int64)
    for lo, hi in ((0, 40), (40, 52), (52, COORDINATES)):
        left = a[:, lo:hi] if len(a) == 1 else a[live, lo:hi]
        count = count + (left == b[live, lo:hi]).sum(1)
        keep = count + (COORDINATES - hi) >= MATCHES
        live, count = live[keep], count[keep]
    out = np.zeros(len(b), bool)
    out[live] = True
    return out


def _alike(pairs: DataFrame) -> DataFrame:
    """The (u, v) of (u, v, n, sig, n2, sig2) whose sizes allow the similarity and whose signatures collide often enough."""

    def keep(batches):
        for b in batches:
            if not b.num_rows:
                continue
            hits = pa.array(collide(_matrix(b.column(2)), _matrix(b.column(3))))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(hits), b.column(1).filter(hits)], names=["u", "v"])

    allowed = pairs.filter(F.lit(100) * F.least("n", "n2") >= F.lit(75) * F.greatest("n", "n2"))
    return allowed.select("u", "v", "sig", "sig2").mapInArrow(keep, "u long, v long")


class _Sets:
    """Labels of the rows of one group, joined as links are found."""

    def __init__(self, labels: np.ndarray):
        self.label = labels.copy()

    def join(self, a: int, b: int) -> None:
        x, y = self.label[a], self.label[b]
        self.label[self.label == max(x, y)] = min(x, y)


def _spanning(cls: np.ndarray, n: np.ndarray, sig: np.ndarray, label: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges that connect rows of different labels whose signatures collide often enough."""
    order = np.argsort(n, kind="stable")
    cls, n, sig = cls[order], n[order], sig[order]
    _, start = np.unique(label[order], return_inverse=True)
    sets, u, v = _Sets(start), [], []
    for a in range(len(cls)):
        end = np.searchsorted(n, n[a] * 100 / 75, side="right")
        cand = np.flatnonzero(sets.label[a + 1 : end] != sets.label[a]) + a + 1
        if len(cand):
            cand = cand[collide(sig[a : a + 1], sig[cand])]
        for b in cand:
            if sets.label[a] != sets.label[b]:
                sets.join(a, b)
                u.append(int(cls[a]))
                v.append(int(cls[b]))
    return u, v


def _parts(df: DataFrame) -> int:
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _unsettled(df: DataFrame, key: str, work: Scratch) -> DataFrame:
    """Rows (cls, label) of groups with several labels, dealt to (key, i, j) so that each two rows of different labels meet.

    Of two rows with different labels one at least is outside the most frequent label of the
    group. Only these rows go against the whole group, in blocks of BLOCK rows: a large group
    that its leader has settled but for a few rows costs work in proportion to its size.
    """
    each = df.groupBy(key, "label").agg(F.count("*").alias("m"))
    groups = each.groupBy(key).agg(F.sum("m").alias("c"), F.max(F.struct("m", "label")).alias("main"), F.count("*").alias("labels")).filter("labels > 1")
    d = df.join(work.keep(groups, "unsettled"), key)  # a written table: Spark splits a skewed partition only where both sides are plain shuffles
    nb, nu = (F.ceil(c / BLOCK).cast("int") for c in (F.col("c"), F.col("c") - F.col("main.m")))
    mine, own = (F.pmod(F.xxhash64("cls"), n).cast("int") for n in (nb, nu))
    seen = F.transform(F.sequence(F.lit(0), nu - 1), lambda i: F.struct(i.alias("i"), mine.alias("j")))
    asks = F.transform(F.sequence(F.lit(0), nb - 1), lambda j: F.struct(own.alias("i"), j.alias("j")))
    at = F.when(F.col("label") == F.col("main.label"), seen).otherwise(F.array_distinct(F.concat(seen, asks)))
    return d.withColumn("ij", F.explode(at)).select("*", "ij.i", "ij.j").drop("ij", "c", "main", "labels")


def families(classes: DataFrame, work: Scratch) -> DataFrame:
    """(cls, fam): classes connected by signatures with MATCHES collisions.

    First each posting list is joined with its least member only, which settles lists of two.
    Longer lists whose members are then still in several groups are compared in blocks, which
    return no more edges than they have members.
    """
    posts = work.keep(postings(classes), "postings")
    lists = work.keep(posts.groupBy("token").agg(F.min("cls").alias("lead"), F.count("*").alias("c")).filter("c > 1"), "lists")
    stars = posts.join(lists, "token").filter("cls <> lead").select(F.col("cls").alias("u"), F.col("lead").alias("v")).distinct()
    side = classes.select(F.col("cls"), "n", "sig")
    pairs = stars.join(side.withColumnRenamed("cls", "u"), "u").join(side.toDF("v", "n2", "sig2"), "v")
    first = work.keep(_alike(pairs), "stars")
    up = first.groupBy(F.col("u").alias("cls")).agg(F.min("v").alias("up"))
    up = salted_join(up, up.select(F.col("cls").alias("up"), F.col("up").alias("up2")), "up", "cls", "left")
    up = work.keep(up.select("cls", F.coalesce("up2", "up").alias("up")), "up")
    named = posts.join(lists.filter("c > 2").select("token"), "token").join(up, "cls", "left").withColumn("label", F.coalesce("up", "cls")).drop("up")
    open_ = _unsettled(work.keep(named, "named"), "token", work).join(side, "cls")

    def link(t: pa.Table) -> dict:
        _, at = np.unique(t["cls"].to_numpy(), return_index=True)
        u, v = _spanning(*(t[c].to_numpy()[at] for c in ("cls", "n")), _matrix(t["sig"])[at], t["label"].to_numpy()[at])
        return {"u": u, "v": v}

    second = map_groups(open_.select("token", "i", "j", "cls", "n", "sig", "label"), ["token", "i", "j"], link, "u long, v long", _parts(classes))
    out = components(first.unionByName(second.distinct())).toDF("cls", "fam")
    work.drop("postings", "lists", "stars", "up", "named", "unsettled")
    return out


def _exact(sets: list[np.ndarray], sig: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Labels (least row) of rows connected by 100 * intersection >= 75 * union; rows of equal ``start`` are connected already.

    A row is compared with the rows of other components that sizes and signatures allow: few of
    them one by one, the most alike first; many at once by counting the rows that hold each of
    its shingles.
    """
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable")
    n, sig, ordered = n[order], sig[order], [sets[i] for i in order]
    found = _Sets(np.arange(len(n)) if start is None else np.unique(start[order], return_inverse=True)[1])
    inverted = None
    for a in range(len(n)):
        end = np.searchsorted(n, n[a] * 100 / 75, side="right")
        cand = np.flatnonzero(found.label[a + 1 : end] != found.label[a]) + a + 1
        if not len(cand):
            continue
        hits = (sig[cand] == sig[a]).sum(1)
        cand, hits = cand[hits >= MATCHES], hits[hits >= MATCHES]
        cand = cand[np.argsort(-hits, kind="stable")]
        tried = 0
        while len(cand) and tried < 24:
            b = cand[0]
            both = len(np.intersect1d(ordered[a], ordered[b], assume_unique=True))
            if 100 * both >= 75 * (n[a] + n[b] - both):
                found.join(a, b)
            tried += 1
            cand = cand[1:]
            cand = cand[found.label[cand] != found.label[a]]
        if len(cand):
            if inverted is None:
                rows = np.repeat(np.arange(len(n)), n)
                keys, where = np.unique(np.concatenate(ordered), return_inverse=True)
                by = np.argsort(where, kind="stable")
                inverted = (keys, np.concatenate([[0], np.cumsum(np.bincount(where, minlength=len(keys)))]), rows[by])
            keys, starts, rows = inverted
            at = np.searchsorted(keys, ordered[a])
            both = np.bincount(np.concatenate([rows[starts[i] : starts[i + 1]] for i in at]), minlength=len(n))[cand]
            for b in cand[100 * both >= 75 * (n[a] + n[cand] - both)]:
                found.join(a, b)
    out = np.empty(len(n), np.int64)
    least: dict[int, int] = {}
    for r, x in zip(order, found.label, strict=True):
        least[x] = min(least.get(x, len(n)), int(r))
    for r, x in zip(order, found.label, strict=True):
        out[r] = least[x]
    return out


def _confirm(t: pa.Table, label: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(cls, least cls of its component) of the classes in ``t`` by their texts."""
    hashes = WordHashes()
    cls = t["cls"].to_numpy()
    cls, at = np.unique(cls, return_index=True)
    texts = t["text"]
    sets = [set_of(texts[int(i)].as_py(), hashes) for i in at]
    start = None if label is None else t[label].to_numpy()[at]
    return cls, cls[_exact(sets, np.array([signature(s) for s in sets]), start)]


def _linked(docs: DataFrame, id_col: str, text_col: str, work: Scratch) -> tuple[DataFrame, DataFrame]:
    """All rows with their class, and (cls, label) of the classes that are linked with another one."""
    rows = work.keep(signatures(docs, id_col, text_col), "signatures")
    full = rows.filter("n > 0")
    classes = full.groupBy("cls").agg(*[F.first(c).alias(c) for c in ("n", "sig")], F.min(F.struct(*ROW)).alias("who"))
    classes = work.keep(classes.select("cls", "n", "sig", "who.*"), "classes")
    fam = families(classes, work)
    fam = work.keep(fam, "families")
    sizes = work.keep(fam.groupBy("fam").agg(F.count("*").alias("c")).filter("c > 1"), "sizes")
    member = work.keep(fam.join(sizes, "fam").join(classes.select("cls", *ROW), "cls"), "members")
    # only the texts of members are shuffled
    texts = docs.withColumns(row_key(id_col, text_col)).select(*ROW, F.col(text_col).alias("text"))
    texts = texts.filter(possibly_in(member)(ROW[0])).dropDuplicates(list(ROW))
    member = work.keep(texts.join(member, list(ROW)).select("fam", "cls", "c", "text"), "texts")
    work.drop("members", "classes", "families", "sizes")

    # a family of at most CHUNK classes is compared in one task; a larger one in chunks, each with the leader (the least class)
    nb = F.ceil(F.col("c") / CHUNK).cast("int")
    at = F.when(F.col("cls") == F.col("fam"), F.sequence(F.lit(0), nb - 1)).otherwise(F.array(F.pmod(F.xxhash64("cls"), nb).cast("int")))

    def chunk(t: pa.Table) -> dict:
        cls, label = _confirm(t)
        return {"fam": np.full(len(cls), t["fam"][0].as_py()), "cls": cls, "label": label, "whole": np.full(len(cls), t["c"][0].as_py() <= CHUNK)}

    first = map_groups(member.withColumn("k", F.explode(at)), ["fam", "k"], chunk, "fam long, cls long, label long, whole boolean", _parts(docs))
    first = work.keep(first.filter("label <> cls OR NOT whole"), "chunks")
    whole = first.filter("whole").select("cls", "label")
    # classes that the leader did not reach are compared with the rest of their family
    parted = first.filter("NOT whole").select("fam", "cls", "label").distinct()
    open_ = _unsettled(parted, "fam", work).join(member.select("cls", "text"), "cls")

    def rest(t: pa.Table) -> dict:
        cls, label = _confirm(t, "label")
        own = dict(zip(t["cls"].to_pylist(), t["label"].to_pylist(), strict=True))
        pairs = {(own[a], own[b]) for a, b in zip(cls.tolist(), label.tolist(), strict=True) if own[a] != own[b]}
        return {"u": [a for a, _ in pairs], "v": [b for _, b in pairs]}

    second = work.keep(map_groups(open_.select("fam", "i", "j", "cls", "label", "text"), ["fam", "i", "j"], rest, "u long, v long", _parts(docs)), "rest")
    parted = parted.select("cls", "label")
    if second.limit(1).count():
        more = components(second).toDF("label", "least")
        parted = parted.join(more, "label", "left").select("cls", F.coalesce("least", "label").alias("label"))
    joined = work.keep(whole.unionByName(whole.select(F.col("label").alias("cls"), "label")).unionByName(parted).distinct(), "joined")
    work.drop("texts", "chunks", "rest", "unsettled")
    return rows, joined


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents linked by 100 * intersection >= 75 * union of their shingle sets.

    Words are runs without white space, A-Z lower-cased; a set has the runs of five words (of
    fewer words the whole sequence). Null, empty and blank texts have an empty set and are linked
    with nothing. Documents with equal sets are one class from the start, so exact copies are
    never compared. Classes are grouped by their signatures into families; inside a family links
    are confirmed on full sets: first with a leader, in chunks, then what it did not reach.
    Repeated ids and null ids are allowed: component_id is the least non-null id of the
    component. One row per input row; other columns are ignored.
    """
    work = Scratch(docs.sparkSession, "near-dup")
    rows, joined = _linked(docs, id_col, text_col, work)
    reps = rows.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c"))
    # a class of one document that is linked with nothing needs no join
    named = reps.join(joined, "cls", "left").filter("c > 1 OR label IS NOT NULL").select("cls", "rep", F.coalesce("label", "cls").alias("label"))
    named = work.keep(named, "named")
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = work.keep(salted_join(named, least, "label", "cls").select("cls", "component_id", F.lit(True).alias("found")), "components")
    out = salted_join(rows.filter("n > 0").select("doc_id", "n", "cls", ROW[0]), named, "cls", ROW[0], "left")
    component = F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    out = materialize(out.unionByName(rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))), "near-dup")
    work.drop()
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, without near-duplicates: one row of each component stays.

    That is the row with the least id (null last); of rows with one id, which may have different
    texts, the verdict is each row's own. Of repeated rows with the same id and text one stays.
    Texts without words are linked with nothing and all stay. Rows that go or repeat are found by
    a bitmap of their hashes first, so the other texts are not shuffled.
    """
    work = Scratch(docs.sparkSession, "near-dup-drop")
    rows, joined = _linked(docs, id_col, text_col, work)
    who = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *ROW)
    full = rows.filter("n > 0").groupBy("cls", "doc_id", *ROW).agg(F.count("*").alias("n"))
    full = full.join(joined, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    full = work.keep(full.select("label", "doc_id", *ROW, "n"), "labels")
    best = full.groupBy("label").agg(F.min(who).alias("best"), F.sum("n").alias("all")).filter("all > 1").drop("all")
    marked = salted_join(full, best, "label", ROW[0]).withColumn("gone", who != F.col("best")).filter("gone OR n > 1")
    marked = materialize(marked.select(*ROW, "gone"), "near-dup-marked")
    work.drop()
    own = [f"c{i}" for i in range(len(docs.columns))]  # no name clashes with the marks
    at = dict(zip(docs.columns, own, strict=True))
    keyed = docs.toDF(*own).withColumns(row_key(at[id_col], at[text_col]))
    suspect = possibly_in(marked)(ROW[0])
    some = keyed.filter(suspect).join(marked, list(ROW), "left")
    alone = some.filter("gone IS NULL").select(*own)
    one = some.filter("NOT gone").groupBy(*ROW).agg(F.min(F.struct(*own)).alias("row")).select("row.*")
    return keyed.filter(~suspect).select(*own).unionByName(alone).unionByName(one).toDF(*docs.columns)
