"""Whitening of embeddings: a compensated covariance, its eigenvectors, and the projections.

Vectors are integers after scaling, so sums and centred values n*x - S are exact. Centred values
are split into slices of 20 bits, whose outer products over a block of rows are exact in doubles
(an error-free transformation by matrix products); blocks, tasks and slices are added up in
double-double. Only matrices of the dimension's square meet on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import map_groups

#: Scale and offset of the integers, and the components returned.
SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Bits of a slice and rows of a block: 2 * 19 + 12 bits of a sum of products stay below 53.
SLICE, BLOCK = 20, 4096
#: Dimensions up to which the covariance is held at once (two matrices of 128 MiB).
MOST_DIMENSIONS = 4096


def integers(c: np.ndarray) -> np.ndarray:
    """x of an array of entries; what a long does not hold is cut to 62 bits."""
    x = np.floor(SCALE * c.astype(np.float64))
    return np.clip(x, -(2.0**62), 2.0**62 - 1024).astype(np.int64) + OFFSET


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b and its rounding error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(hi: np.ndarray, lo: np.ndarray, more: np.ndarray, least: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """hi + lo plus more + least, as a double-double."""
    s, e = two_sum(hi, more)
    t, f = two_sum(lo, np.asarray(least) + np.zeros_like(lo))
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def slices(y: np.ndarray) -> list[np.ndarray]:
    """Integers as doubles of SLICE bits, signed, the lowest first; exact for integers of any size."""
    out, half = [], 1 << (SLICE - 1)
    while y.any():
        low = ((y + half) & ((1 << SLICE) - 1)) - half
        out.append(low.astype(np.float64))
        y = (y - low) >> SLICE
    return out


def outer_products(y: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """hi + lo plus the sum of the outer products of the rows of y; each product of two slices is exact."""
    for at in range(0, len(y), BLOCK):
        parts = slices(y[at : at + BLOCK])
        for i, a in enumerate(parts):
            for j, b in enumerate(parts[: i + 1]):
                p = a.T @ b
                hi, lo = add(hi, lo, np.ldexp(p if i == j else p + p.T, SLICE * (i + j)))
    return hi, lo


def eigen(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of the symmetric matrix hi + lo.

    LAPACK's syevd (Householder tridiagonal form, then divide and conquer) gives the vectors; two
    Newton steps over the matrix in extended precision take out what it rounded.
    """
    e, q = np.linalg.eigh(hi)
    wide = hi.astype(np.longdouble) + lo
    q = q.astype(np.longdouble)
    eye = np.eye(len(e), dtype=np.longdouble)
    for _ in range(2):
        r, s = eye - q.T @ q, q.T @ wide @ q
        r, s = (r + r.T) / 2, (s + s.T) / 2  # so that the step keeps the vectors orthogonal
        e = np.diag(s) / (1 - np.diag(r))
        apart = e[None, :] - e[:, None]
        close = np.abs(apart) <= 4 * len(e) * np.finfo(np.float64).eps * max(np.abs(e).max(initial=0), np.finfo(np.float64).tiny)
        step = np.where(close, r / 2, (s + e[None, :] * r) / np.where(close, 1, apart))
        q = q + q @ step
    order = np.argsort(-e, kind="stable")
    q = q[:, order] / np.sqrt((q[:, order] ** 2).sum(0))
    return e[order].astype(np.float64), q.astype(np.float64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and integers of batches whose vectors all have the same dimension."""
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            part = b.slice(at, BLOCK)
            vectors = part.column(1)
            yield part.column(0), integers(vectors.flatten().to_numpy(zero_copy_only=False)).reshape(len(vectors), -1)


def _wide(x: np.ndarray, bound: int) -> np.ndarray:
    """x, as Python integers where results up to ``bound`` would not fit into a long."""
    return x if bound < 1 << 62 else x.astype(object)


def fit_sums(rows: DataFrame) -> tuple[int, list[int], int] | None:
    """Rows, sums and greatest magnitude of x over the vectors of the most frequent dimension (ties: the largest)."""

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            sizes = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(sizes):
                own = b.column(1).filter(pa.array(sizes == d))
                x = integers(own.flatten().to_numpy(zero_copy_only=False)).reshape(len(own), -1)
                most = int(np.abs(x).max(initial=0))
                s = _wide(x, most * len(x)).sum(0)
                n, old, top = held.get(d, (0, 0, 0))
                held[d] = [n + len(x), old + s.astype(object), max(top, most)]
        for d, (n, s, top) in held.items():
            yield pa.RecordBatch.from_pydict({"dim": [int(d)] * d, "pos": list(range(d)), "n": [n] * d, "s": [str(int(v)) for v in s], "top": [top] * d})

    parts = rows.mapInArrow(run, "dim long, pos long, n long, s string, top long")
    by_place = parts.groupBy("dim", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.max("top").alias("top"))
    by_dim = by_place.groupBy("dim").agg(F.max("n").alias("n"), F.max("top").alias("top"), F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("sums"))
    got = by_dim.orderBy(F.desc("n"), F.desc("dim")).first()
    return got and (got["n"], [int(p["s"]) for p in got["sums"]], got["top"])


def covariance(rows: DataFrame, n: int, sums: list[int], top: int) -> tuple[np.ndarray, np.ndarray]:
    """The covariance (divisor n) of x as a double-double matrix: high and low parts.

    A task adds up its own rows and gives one row for each row of the matrix; these are added up
    by matrix row in as many tasks as there are. Partitions are merged so far that the partial
    matrices number a few for each core.
    """
    d, bound = len(sums), 2 * n * top
    held = np.array(sums, dtype=object)

    def run(batches):
        hi = lo = np.zeros((d, d))
        s = held if bound >= 1 << 62 else held.astype(np.int64)
        for _, x in _blocks(batches):
            hi, lo = outer_products(n * _wide(x, bound) - s, hi, lo)
        if hi.any():
            yield pa.RecordBatch.from_pydict({"i": list(range(d)), "hi": list(hi), "lo": list(lo)})

    def merged(t: pa.Table) -> dict:
        hi = lo = np.zeros(d)
        for h, low in zip(t["hi"].to_pylist(), t["lo"].to_pylist(), strict=True):
            hi, lo = add(hi, lo, np.array(h), np.array(low))
        v = [(Fraction(float(h)) + Fraction(float(low))) / n**3 for h, low in zip(hi, lo, strict=True)]
        high = [float(q) for q in v]
        return {"i": [t["i"][0].as_py()], "hi": [high], "lo": [[float(q - Fraction(h)) for q, h in zip(v, high, strict=True)]]}

    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = rows.coalesce(4 * cores).mapInArrow(run, "i long, hi array<double>, lo array<double>")
    hi, lo = np.zeros((d, d)), np.zeros((d, d))
    for r in map_groups(parts, ["i"], merged, "i long, hi array<double>, lo array<double>", min(d, cores)).toLocalIterator():
        hi[r["i"]], lo[r["i"]] = r["hi"], r["lo"]
    return hi, lo


def _whitener(n: int, sums: list[int], top: int, w: np.ndarray) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """x to its exact centred integers n*x - S and its whitened values."""
    bound = 2 * n * top
    held = np.array(sums, dtype=object if bound >= 1 << 62 else np.int64)

    def whiten(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = n * _wide(x, bound) - held
        return y, (y.astype(np.float64) / n) @ w

    return whiten


def identity_error(rows: DataFrame, n: int, whiten: Callable, k: int) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""

    def run(batches):
        total, products = np.zeros(k), np.zeros((k, k))
        low1, low2 = np.zeros(k), np.zeros((k, k))
        for _, x in _blocks(batches):
            z = whiten(x)[1]
            total, low1 = add(total, low1, z.sum(0))
            products, low2 = add(products, low2, z.T @ z)
        yield pa.RecordBatch.from_pydict({"at": list(range(k + k * k)), "hi": np.concatenate([total, products.ravel()]), "lo": np.concatenate([low1, low2.ravel()])})

    parts = rows.mapInArrow(run, "at long, hi double, lo double").groupBy("at").agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo"))
    got = np.zeros(k + k * k)
    for r in parts.collect():  # k + k * k rows
        got[r["at"]] = r["hi"] + r["lo"]
    mean = got[:k] / n  # the values are centred: all but zero
    return float(np.abs(got[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())


def whitened(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of every vector on the first ``components`` principal components.

    Entries c become x = floor(1024 c) + 100000. Covariances are over all vectors that stay, with
    divisor n, centred before multiplying. One row for each vector and component: vec_id,
    component, n, deviation (exact), whitened, explained, identity_error (one value for all rows).

    Vectors that are null, empty, or hold null or non-finite entries are dropped; so are those of
    another dimension than the most frequent one (ties: the larger). A component without
    variance (a single vector, copies only, more dimensions than vectors) has null as whitened
    value and is left out of identity_error, which is null if none has any; explained is then 0, or null
    without any variance. A deviation beyond a long is null. Repeated rows and null ids count
    each; an empty table gives no rows; other columns are ignored. More than 4,096 dimensions are an error.
    """
    schema = f"vec_id {table.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = table.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))))
    fit = fit_sums(rows)
    if fit is None:
        return table.sparkSession.createDataFrame([], schema)
    n, sums, top = fit
    d = len(sums)
    if d > MOST_DIMENSIONS:
        raise ValueError(f"{d} dimensions; at most {MOST_DIMENSIONS} are handled")
    rows = rows.filter(F.size("vector") == d)
    hi, lo = covariance(rows, n, sums, top)
    e, q = eigen(hi, lo)
    trace = float(sum(Fraction(float(v)) for v in np.diag(hi)))
    k = min(components, d)
    live = int((e[:k] > d * np.finfo(np.float64).eps * trace).sum())
    whiten = _whitener(n, sums, top, q[:, :live] / np.sqrt(e[:live]))
    error = identity_error(rows, n, whiten, live) if live else None
    explained = [float(v / trace) if i < live else 0.0 for i, v in enumerate(e[:k])] if trace else [None] * k
    exact = 2 * n * top < 1 << 31 or d * (2 * n * top) ** 2 < 1 << 62

    def run(batches):
        kind = None
        for ids, x in _blocks(batches):
            y, z = whiten(x)
            y = y if exact else y.astype(object)
            dev = [v if v < 1 << 63 else None for v in map(int, (y * y).sum(1))]
            m = len(x)
            kind = kind or pa.schema([("vec_id", ids.type), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
            values = np.full((m, k), np.nan)
            values[:, :live] = z
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)),
                    pa.array([v for v in dev for _ in range(k)], pa.int64()),
                    pa.array(values.ravel(), mask=np.isnan(values.ravel())),
                    pa.array(explained * m, pa.float64()),
                    pa.array([error] * (m * k), pa.float64()),
                ],
                schema=kind,
            )

    return rows.mapInArrow(run, schema)
