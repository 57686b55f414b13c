"""Document fingerprints by consistent weighted sampling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import WordHashes, mixed, place_in, words_of

#: Samples of a fingerprint, and rows of the tables of variates from which a term's hash picks.
SAMPLES, TABLE_ROWS = 64, 1 << 14
EMPTY = "0" * (4 * SAMPLES)


@lru_cache(maxsize=1)
def _variates() -> tuple[np.ndarray, ...]:
    """r, ln c and b of consistent weighted sampling: r and c are Gamma(2, 1), b is uniform.

    A term's hash picks one row for r and b and another for c. Two terms share all three with a
    probability of 2**-28; that some terms of a long text share r and b alone, with a c of their
    own, leaves each sample's winner unbiased and only correlates such terms a little.
    """
    rng = np.random.default_rng(20_100_717)
    r = rng.gamma(2.0, 1.0, (TABLE_ROWS, SAMPLES)).astype(np.float32)
    lnc = np.log(rng.gamma(2.0, 1.0, (TABLE_ROWS, SAMPLES))).astype(np.float32)
    b = rng.random((TABLE_ROWS, SAMPLES), np.float32)
    return r, lnc, b, r * (1 - b)


def weighted_terms(text: str, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different pairs of neighbouring words (the first word stands with the start) and their counts."""
    h = hashes.of(words_of(text))
    before = np.empty_like(h)
    before[:1] = np.uint64(0x5851F42D4C957F2D)
    before[1:] = h[:-1]
    return np.unique(mixed(before * np.uint64(0x9E3779B97F4A7C15) + h), return_counts=True)


def sample(terms: np.ndarray, weights: np.ndarray) -> np.ndarray | None:
    """The 16-bit code of (term, quantised weight) that wins each sample.

    For each sample a term of weight w has t = floor(ln w / r + b), y = exp(r (t - b)) and
    a = c / (y e^r); the least a wins. Two weighted sets agree in a sample with a probability
    that is their generalised Jaccard similarity, the sum of least over the sum of greatest weights.
    """
    if not len(terms):
        return None
    r, lnc, b, one = _variates()
    best = np.full(SAMPLES, np.inf, np.float32)
    code = np.zeros(SAMPLES, np.uint64)
    heavy = weights > 1
    for which in (~heavy, heavy):
        own, w = terms[which], weights[which]
        for at in range(0, len(own), 512):
            x = own[at : at + 512]
            i = (x & np.uint64(TABLE_ROWS - 1)).astype(np.intp)
            a = lnc[((x >> np.uint64(20)) & np.uint64(TABLE_ROWS - 1)).astype(np.intp)]
            t = None
            if which is heavy:
                t = np.floor(np.log(w[at : at + 512].astype(np.float32))[:, None] / r[i] + b[i])
                a -= r[i] * (t - b[i] + 1)
            else:
                a -= one[i]
            low = a.min(0)
            row, col = np.nonzero(a == low)
            use = low[col] < best[col]
            row, col = row[use], col[use]
            c = x[row] if t is None else x[row] + (t[row, col].astype(np.int64).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
            code[col] = c
            np.minimum(best, low, out=best)
    return (mixed(code) >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """The share of equal samples; two empty texts are alike, an empty and another are not."""
    if a is None or b is None:
        return float(a is None and b is None)
    return float((a == b).mean())


def to_string(s: np.ndarray | None) -> str:
    return EMPTY if s is None else s.astype(">u2").tobytes().hex()


def from_string(s: str) -> np.ndarray | None:
    return None if s == EMPTY else np.frombuffer(bytes.fromhex(s), ">u2").astype(np.uint16)


def fingerprint_with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of whole texts and of texts whose second half comes from the next document.

    The next document is that with the next smaller id (null ids last, rows with one id by the
    hash of the text); after the last comes the first. Rows are dealt by ranges of the id, so one
    shuffle of the texts gives every task one range in order; the first document of a range
    also goes to the end of the range before it. Null texts are empty; one row per input row.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    m = int(parts or 4 * n)
    cuts = docs.select(F.percentile_approx(F.col(id_col), [(i + 1) / m for i in range(m)], 10_000), F.max(id_col)).first()
    cuts = sorted({c for c in [*(cuts[0] or []), cuts[1]] if c is not None})  # at most the parts; each the greatest id of its range
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    part = F.lit(0)
    at = F.array(F.struct(part.alias("part"), F.lit(False).alias("guest")))
    if cuts:
        part = F.coalesce(place_in(cuts, right=False)(F.col("id")), F.lit(0))
        own = F.struct(part.alias("part"), F.lit(False).alias("guest"))
        other = F.struct(((part + 1) % len(cuts)).cast("int").alias("part"), F.lit(True).alias("guest"))
        at = F.when(F.col("id").isin(cuts), F.array(own, other)).otherwise(F.array(own))
    kind = docs.schema[id_col].dataType.simpleString()
    order = [F.col("at.part"), F.col("at.guest"), F.col("id").desc_nulls_last(), F.xxhash64("text"), F.col("text")]
    dealt = rows.withColumn("at", F.explode(at)).repartitionById(max(1, len(cuts)), "at.part").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        fp = lambda t: sample(*weighted_terms(t, hashes))
        now = first = None
        out: list[list] = [[] for _ in NAMES]

        def emit(row, nxt):
            _, i, text, own = row
            half = len(text) // 2
            edited = text[: len(text) - half] + nxt[2][:half]
            changed = own if edited == text else fp(edited)
            values = (i, len(text), hashlib.sha256(edited.encode()).hexdigest(), to_string(own), to_string(changed), likeness(own, changed), likeness(own, nxt[3]))
            for c, v in zip(out, values, strict=True):
                c.append(v)

        def flush():
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=NAMES)
            for c in out:
                c.clear()
            return got

        types = None
        for whole in batches:
            types = types or [whole.schema.field("id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            for s in range(0, whole.num_rows, 128):
                b = whole.slice(s, 128).to_pydict()
                for p, guest, i, text in zip(b["part"], b["guest"], b["id"], b["text"], strict=True):
                    if now is not None and now[0] != p:
                        emit(now, first)  # only without any id: the ring closes in this task
                        now = None
                    if guest and now is None:
                        continue
                    row = (p, i, text, fp(text))
                    if now is None:
                        first = row
                    else:
                        emit(now, row)
                    now = None if guest else row
                if len(out[0]) >= 256:
                    yield flush()
        if now is not None:
            emit(now, first)
        if out[0]:
            yield flush()

    NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("at.part", "at.guest", "id", "text").mapInArrow(run, schema)
