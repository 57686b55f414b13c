"""A stored inverted index over text blocks: segments of postings with positions, deletions, merges and searches.

A folder holds one sub-folder for each segment:

* ``postings/bucket=…``: term, key, tf, len, words (the numbers of the words it stands in). The bucket is a
  hash of a term's first two letters, so a term and all terms with one prefix lie in one folder. Each
  task writes the postings of its share of the texts as a file in each bucket, sorted by term, so that Parquet's
  statistics skip the pages of other terms; only texts are shuffled, never postings. A task orders the terms of its share
  before it makes rows of them, so Spark's sort of the rows finds them in order.
* ``postings/bucket=-1``: a row without a term for each document, with its key and len (null for a null text), written in the same pass.
* ``gone``: keys that the segment takes out of older segments, with the length they had.
* ``meta``: one row with totals, written last; a segment without it was not committed and is not read.

Searches read postings and totals only, never a text.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.text import folded
from granary.session import remove

#: Letters of a term that choose its bucket, and the shortest prefix that is found in one bucket.
LEAD = 2
BUCKETS = 32
#: Bytes of text that a task turns into postings and sorts, and keys taken out of older segments that are broadcast at most.
SHARE = 16 << 20
MOST_GONE = 1_000_000
#: Tokens whose postings a merge sorts in one task, about those of a share; texts that are split at once.
SHARE_TOKENS = SHARE // 6
TEXTS = 1000
#: Bytes of distinct keys up to which a file names each key once; a merge puts the keys of many shares into a file.
KEYS = 16 << 20
#: Stands for the characters between two terms of a word.
MARK = "\x01"

_META = "segment long, keys long, texts long, tokens long, gone_keys long, gone_texts long, gone_tokens long, replaces array<long>"


def _bucket(term: Column) -> Column:
    """The folder of a term, for searches; ``_buckets`` has the same for the terms of a task."""
    return F.pmod(F.crc32(F.left(term, F.lit(LEAD)).cast("binary")), F.lit(BUCKETS)).cast("int")


def _buckets(terms: pa.Array) -> np.ndarray:
    lead = pc.utf8_slice_codeunits(terms, 0, LEAD).dictionary_encode()
    return np.array([zlib.crc32(x.encode()) % BUCKETS for x in lead.dictionary.to_pylist()], "int32")[lead.indices.to_numpy()]


def _grouped(key: pa.Array, text: pa.Array, docs: bool) -> Iterator[pa.Table]:
    """The postings of some texts, whose words are parted by white space and the terms of a word by marks.

    They come in order of their buckets and terms; ``docs`` adds the bucket, and first the rows of the documents.
    """
    words = pc.ascii_split_whitespace(text)
    runs = pc.split_pattern(words.flatten(), MARK)
    some = pc.not_equal(runs.flatten(), "")
    term = runs.flatten().filter(some).dictionary_encode()
    code, word = term.indices.to_numpy(), pc.list_parent_indices(runs).filter(some).to_numpy()
    doc = pc.list_parent_indices(words).to_numpy()[word]
    size = np.bincount(doc, minlength=len(key))
    bucket = _buckets(term.dictionary)
    by_place = pc.sort_indices(pa.table([pa.array(bucket), term.dictionary], names=["bucket", "term"]), [("bucket", "ascending"), ("term", "ascending")]).to_numpy()
    place = np.empty(len(by_place), "int64")
    place[by_place] = np.arange(len(by_place))
    group = place[code] * len(key) + doc
    order = np.argsort(group, kind="stable")  # in order of the words
    first = np.flatnonzero(np.diff(group[order], prepend=-1))
    ends = np.append(first, len(order))
    at = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((word - words.offsets.to_numpy()[doc])[order], pa.int32()))
    names, one = ["term", "key", "tf", "len", "words", *["bucket"] * docs], order[first]
    if docs:
        n, none = len(key), pa.array(np.zeros(len(key) + 1), pa.int32())
        yield pa.table([pa.nulls(n, pa.string()), key, pa.array(np.zeros(n), pa.int64()), pa.array(size, pa.int64(), mask=text.is_null().to_numpy(zero_copy_only=False)), pa.ListArray.from_arrays(none, pa.array([], pa.int32())), pa.array(np.full(n, -1), pa.int32())], names=names)
    found = [term.dictionary.take(pa.array(code[one])), key.take(pa.array(doc[one])), pa.array(np.diff(ends), pa.int64()), pa.array(size[doc[one]], pa.int64()), at]
    yield pa.table([*found, *[pa.array(bucket[code[one]])] * docs], names=names)


def _pieces(batches: Iterator[pa.RecordBatch], texts: int, held: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Keys and texts of batches, so many texts or bytes at once."""
    kept, rows, size = [], 0, 0
    for batch in batches:
        for i in range(0, batch.num_rows, TEXTS):
            kept.append(b := batch.slice(i, TEXTS))
            rows, size = rows + b.num_rows, size + b.get_total_buffer_size() * b.num_rows // batch.num_rows
            if rows >= texts or size >= held:
                t = pa.Table.from_batches(kept).combine_chunks()
                yield tuple(t.column(k).chunk(0) for k in (0, 1))
                kept, rows, size = [], 0, 0
    if kept:
        t = pa.Table.from_batches(kept).combine_chunks()
        yield tuple(t.column(k).chunk(0) for k in (0, 1))


def postings_of(blocks: DataFrame, key: str = "key", body: str = "body", *, docs: bool = False) -> DataFrame:
    """(term, key, tf, len, words): a row for each term of each block, with the numbers of the words, from 0, that hold it.

    A block is one row, so its terms are grouped where it stands, without a shuffle. The text is folded and its letters
    are told from other characters on the JVM, once for a whole text; Arrow splits it. ``docs`` adds a row without a term for each
    block and the bucket of each row, and all texts of a task up to two shares come in order of buckets and terms.
    """
    marked = F.regexp_replace(folded(F.trim(body)), r"[^\p{L}\p{N}\s]+", MARK)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _pieces(batches, 1 << 30 if docs else TEXTS, 2 * SHARE):
            for t in _grouped(keys, texts, docs):
                yield from t.to_batches(max_chunksize=100_000)

    return blocks.select(F.col(key).cast("string").alias("key"), marked.alias("marked")).mapInArrow(group, "term string, key string, tf long, len long, words array<int>" + ", bucket int" * docs)


class TextIndex:
    """The index in a folder. Every change is a new segment; what is read is fixed when a search is built."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._meta: dict[int, dict] | None = None

    # --- segments

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def segments(self) -> dict[int, dict]:
        """The committed segments by number, without those that a later one replaces."""
        if self._meta is None:
            fs, at = self._fs(f"{self.path}/*/meta/_SUCCESS")
            found = [str(s.getPath().getParent()) for s in (fs.globStatus(at) or [])]
            rows = [r.asDict() for r in self.spark.read.schema(_META).parquet(*found).collect()] if found else []  # one row a segment
            old = {s for r in rows for s in r["replaces"]}
            self._meta = {r["segment"]: r for r in sorted(rows, key=lambda r: r["segment"]) if r["segment"] not in old}
        return self._meta

    def _next(self) -> int:
        """A number above those of all segments, committed or not."""
        fs, at = self._fs(f"{self.path}/*")
        return 1 + max((int(s.getPath().getName()) for s in (fs.globStatus(at) or [])), default=0)

    def _commit(self, n: int, replaces: Sequence[int] = ()) -> None:
        held = lambda of: [F.count("*").alias(f"{of}keys"), F.count("len").alias(f"{of}texts"), F.coalesce(F.sum("len"), F.lit(0)).alias(f"{of}tokens")]
        docs, gone = self._read("docs", [n]).agg(*held("")), self._read("gone", [n]).agg(*held("gone_"))
        one = docs.crossJoin(gone).select(F.lit(n).cast("long").alias("segment"), *docs.columns, *gone.columns, F.array(*[F.lit(x).cast("long") for x in replaces]).cast("array<long>").alias("replaces"))
        one.coalesce(1).write.parquet(f"{self.path}/{n}/meta")
        self._meta = None

    def _read(self, what: str, segments: Sequence[int]) -> DataFrame:
        schema = {"gone": "key string, len long"}.get(what, "term string, key string, tf long, len long, words array<int>, bucket int")
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{n}/{'gone' if what == 'gone' else 'postings'}").withColumn("segment", F.lit(n).cast("long")) for n in segments]
        out = parts[0] if parts else self.spark.createDataFrame([], schema + ", segment long")
        for p in parts[1:]:
            out = out.unionByName(p)
        if what == "docs":
            return out.filter("bucket = -1").select("key", "len", "segment")
        return out.filter("bucket >= 0") if what == "postings" else out

    def _write_postings(self, postings: DataFrame, n: int) -> None:
        postings.sortWithinPartitions("bucket", "term").write.option("compression", "zstd").option("parquet.dictionary.page.size", KEYS).partitionBy("bucket").parquet(f"{self.path}/{n}/postings")

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """Texts in shares whose postings a task sorts in memory."""
        held = rows.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
        return rows.repartition(self._shares(held, SHARE), "key")

    def _shares(self, held: int, share: int) -> int:
        return max(math.ceil(held / share), min(self.spark.sparkContext.defaultParallelism, math.ceil(16 * held / share)), 1)

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows of keys that no later segment takes out."""
        with_gone = [n for n, m in self.segments().items() if m["gone_keys"]]
        if not with_gone:
            return rows
        gone = self._read("gone", with_gone).groupBy("key").agg(F.max("segment").alias("_until"))
        if sum(self.segments()[n]["gone_keys"] for n in with_gone) <= MOST_GONE:
            gone = F.broadcast(gone)  # a checked size; more keys are shuffled with the rows
        return rows.join(gone, "key", "left").filter(F.col("_until").isNull() | (F.col("segment") >= F.col("_until"))).drop("_until")

    # --- changes

    def add(self, blocks: DataFrame, key: str = "asset_id", body: str = "body", *, copies: bool = False) -> None:
        """Add texts, one row for each key; keys that are already there are replaced. Null texts hold nothing.

        With ``copies`` a key may have many rows with the same text, which count once: the shuffle that deals the texts brings
        them together, so they need not be told apart, and shuffled, before.
        """
        known = list(self.segments())
        n = self._next()
        rows = self._dealt(blocks.select(F.col(key).cast("string").alias("key"), F.col(body).alias("body")))
        self._write_postings(postings_of(rows.dropDuplicates(["key"]) if copies else rows, docs=True), n)
        new = self._read("docs", [n]).select("key")
        self._live(self._read("docs", known)).join(new, "key", "left_semi").select("key", "len").write.parquet(f"{self.path}/{n}/gone")
        self._commit(n)

    def delete(self, keys: DataFrame, key: str = "asset_id") -> None:
        """Take contents out; keys that are not there are ignored."""
        known = list(self.segments())
        n = self._next()
        wanted = keys.select(F.col(key).cast("string").alias("key"))
        self._write_postings(postings_of(self.spark.createDataFrame([], "key string, body string"), docs=True), n)
        self._live(self._read("docs", known)).join(wanted, "key", "left_semi").select("key", "len").write.parquet(f"{self.path}/{n}/gone")
        self._commit(n)

    def merge(self) -> None:
        """Write all live postings as one segment and drop the old ones; searches built before must have ended."""
        known = list(self.segments())
        if len(known) < 2:
            return
        n = self._next()
        # files are read many to a task, the same number of splits each, so that a task sorts at most what it does for a share of texts
        rows, shares = self._read("all", known), self._shares(sum(self.segments()[x]["tokens"] for x in known), SHARE_TOKENS)
        splits = rows.rdd.getNumPartitions()
        self._write_postings(self._live(rows).drop("segment").coalesce(math.ceil(splits / max(splits // shares, 1))), n)
        self._read("gone", []).select("key", "len").write.parquet(f"{self.path}/{n}/gone")
        self._commit(n, known)
        for old in known:
            remove(self.spark, f"{self.path}/{old}/meta")  # first, so that a half deleted segment is never read
            remove(self.spark, f"{self.path}/{old}")

    # --- searches

    def totals(self) -> tuple[int, int]:
        """Live documents and their tokens, from the segments' totals."""
        m = self.segments().values()
        return sum(x["keys"] - x["gone_keys"] for x in m), sum(x["tokens"] - x["gone_tokens"] for x in m)

    def _mean(self) -> float:
        """Tokens of a live text; null texts are none, as in an average of SQL."""
        n = sum(x["texts"] - x["gone_texts"] for x in self.segments().values())
        return self.totals()[1] / max(n, 1)

    def postings(self, terms: Sequence[str] | None = None, prefix: str | None = None) -> DataFrame:
        """(key, term, tf, len, words): live postings, of some terms, of all terms with a prefix, or all."""
        rows = self._read("postings", list(self.segments()))
        if terms is not None:
            wanted = [folded(F.lit(x)) for x in dict.fromkeys(terms)]
            rows = rows.filter(F.col("bucket").isin([_bucket(w) for w in wanted]) & F.col("term").isin(wanted)) if wanted else rows.filter(F.lit(False))
        if prefix is not None:
            lead = folded(F.lit(prefix))
            rows = rows.filter(F.startswith("term", lead))
            if len(prefix) >= LEAD:
                rows = rows.filter(F.col("bucket") == _bucket(lead))
        return self._live(rows).select("key", "term", "tf", "len", "words")

    def holding(self, terms: Sequence[str]) -> DataFrame:
        """(key): documents that hold every term; no terms match nothing."""
        n = self._distinct(terms)
        return self.postings(terms).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") == n).select("key")

    def prefix(self, prefix: str) -> DataFrame:
        """(key, n): documents with tokens that begin with a prefix, and how many."""
        return self.postings(prefix=prefix).groupBy("key").agg(F.sum("tf").alias("n"))

    def bm25(self, terms: Sequence[str], *, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(key, score, words): documents that hold every term, their score, and the words that hold the terms."""
        n, _ = self.totals()
        hits = self.postings(terms)
        df = hits.groupBy("term").agg(F.count("*").alias("df"))  # one row for each term
        idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(self._mean())))
        found = hits.join(F.broadcast(df), "term").groupBy("key").agg(F.sum(part).alias("score"), F.count("*").alias("found"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("words")))).alias("words"))
        return found.filter(F.col("found") == self._distinct(terms)).drop("found")

    def _distinct(self, terms: Sequence[str]) -> Column:
        return F.size(F.array_distinct(F.array(*[folded(F.lit(x)) for x in terms]))) if terms else F.lit(0)


def snippets(hits: DataFrame, blocks: DataFrame, *, key: str = "asset_id", body: str = "body", width: int = 12) -> DataFrame:
    """``hits`` (key, words, …) with a snippet: ``width`` words around the first that was found, found ones in brackets.

    Bodies are read for the hits only and not searched: the index knows the words.
    """
    first = F.greatest(F.get("words", F.lit(0)) - width // 2, F.lit(0))
    own = hits.join(blocks.select(F.col(key).alias("key"), F.col(body).alias("_body")), "key")
    cut = F.slice(F.split(F.trim("_body"), r"\s+"), first + 1, width)
    shown = F.transform(cut, lambda w, i: F.when(F.array_contains("words", (first + i).cast("int")), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
    return own.withColumn("snippet", F.array_join(shown, " ")).drop("_body")
