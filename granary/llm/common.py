"""What several operators of this subpackage use."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: a maximal run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: str) -> list[bytes]:
    """The words of WORD in order, as UTF-8 with A-Z in lower case (bytes know no other letters or spaces)."""
    return text.encode().lower().split()


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    limit = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit changes every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``size`` words; of fewer words, of the whole sequence; of none, nothing."""
    n = len(h)
    if n == 0:
        return h
    k = min(n, size)
    x = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        x = mixed(x * np.uint64(0x9E3779B97F4A7C15) + h[j : n - k + 1 + j])
    return np.unique(x)


def map_rows(df: DataFrame, fn: Callable[[], Callable[[dict], dict]], schema: str, chunk: int = 256) -> DataFrame:
    """Arrow-batched map: ``fn()`` runs once per task and gives a function from columns to columns.

    Batches are cut into ``chunk`` rows, so what Python holds at once stays small even when
    single texts are very long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = fn()
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                out = step({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_pydict(out, schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    return df.mapInArrow(run, schema)


#: Columns that stand for the values of a row: two independent hashes, so that rows need no unique id.
ROW = ("_row1", "_row2")


def row_key(*cols: str) -> dict[str, Column]:
    """The columns ROW, from the values of ``cols`` together."""
    at = [F.col(f"`{c}`") for c in cols]
    return {ROW[0]: F.xxhash64(F.lit(1), *at), ROW[1]: F.xxhash64(F.lit(2), *at, F.lit(3))}


#: Bits of the bitmap of ``possibly_in``: 8 MiB, whatever the input.
FILTER_BITS = 1 << 26


def possibly_in(keys: DataFrame, key: str = ROW[0]) -> Callable[[str], Column]:
    """A test whether a hash may be among those of ``keys``; it never denies one that is.

    The hashes are put into a bitmap of a fixed size by a grouped aggregation. Rows that fail the
    test need no shuffle before an exact join; with very many keys the bitmap fills up, and the
    exact join then does all the work. Only the hash goes to Python.
    """
    bits = keys.select((F.col(key).bitwiseAND(F.lit(FILTER_BITS - 1))).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 AS int)))").alias("set")).toPandas()
    bitmap = np.zeros(FILTER_BITS // 64, np.uint64)
    bitmap[words["word"].to_numpy(np.int64)] = words["set"].to_numpy(np.int64).view(np.uint64)
    held = keys.sparkSession.sparkContext.broadcast(bitmap)

    @F.arrow_udf("boolean")
    def test(h: pa.Array) -> pa.Array:
        bit = h.to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(FILTER_BITS - 1)
        return pa.array((held.value[(bit >> np.uint64(6)).astype(np.intp)] >> (bit & np.uint64(63))) & np.uint64(1) == 1)

    return test


#: Tasks that the rows of one key are dealt to.
SALTS = 8


def salted_join(left: DataFrame, right: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row for each ``key`` and is repeated SALTS times.

    Rows of a frequent key on the left are dealt to SALTS tasks by the hash of their column
    ``by``, which is the same in every attempt of a task.
    """
    many = right.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    salt = F.pmod(F.xxhash64(F.col(by), F.lit("salt")), F.lit(SALTS)).cast("int")
    return left.withColumn("_salt", salt).join(many, [key, "_salt"], how).drop("_salt")


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], dict], schema: str, parts: int) -> DataFrame:
    """``fn`` of the rows of each group of the long columns ``keys``; groups have to fit into a task.

    The work on small groups is CPU time and not bytes, so they are dealt to a given number of
    partitions, which Spark does not merge, and sorted there: one task serves many groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, done, rows = [], None, [], 0

        def close():
            out = pa.RecordBatch.from_pydict(fn(pa.Table.from_batches(own)), schema=target)
            done.append(out)
            return out.num_rows

        for b in batches:
            at = np.stack([b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys])
            cuts = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1
            for s, e in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if s == e:
                    continue
                now = tuple(at[:, s])
                if own and now != last:
                    rows += close()
                    own.clear()
                own.append(b.slice(s, e - s))
                last = now
            if rows > 4096:
                yield from done
                done.clear()
                rows = 0
        if own:
            close()
        yield from done

    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    return df.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def place_in(cuts: list, *, right: bool) -> Callable[[Column], Column]:
    """How many of the sorted ``cuts`` are below a value (``right``: below or equal), by binary search; null stays null.

    A range partition with thousands of bounds takes few steps a row; only the value goes to Python.
    """
    held = sorted(cuts)
    side = bisect_right if right else bisect_left

    @F.arrow_udf("int")
    def place(v: pa.Array) -> pa.Array:
        return pa.array([None if x is None else side(held, x) for x in v.to_pylist()], pa.int32())

    return place
