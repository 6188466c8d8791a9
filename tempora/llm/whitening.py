"""Whitening of embeddings by exact covariances from bit planes.

An entry c becomes the integer x = floor(1024 c) + OFFSET. Tasks take their rows in blocks: every dimension is shifted by
its smallest value in the block and cut into bit planes, each packed across the rows into 64-bit words. The product of
two dimensions is then a sum over pairs of planes of 2^(b + c) times the number of rows that have both bits, an AND and
a population count, so sums of x and of x x' are exact integers. Each task sends one row of sums (D numbers and
D (D + 1) / 2 products); Spark adds them up as decimals. The driver holds nothing but these sums, whose size is that of
the covariance whatever the number of rows: n Sxx - S S' is taken in integers, and only this centred matrix is rounded to
doubles for the eigenvectors. A second scan adds up the covariance of the whitened rows (centred block by block, blocks
merged by their means), a third writes the result; nothing but sums is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

SCALE = 1024
OFFSET = 100_000
COMPONENTS = 8
#: Entries beyond so much have no place in the sums (a sum of squares over 2^40 rows must fit 38 digits).
LARGEST = 2.0**30
#: Rows of a block; its planes stay in the processor's cache.
BLOCK = 8192
#: Part of the trace below which an eigenvalue counts as none.
FLAT = 1e-13


def bit_planes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes (n_planes, words) of non-negative integers (rows, dims), and the dimension and the bit of each plane."""
    rows, dims = v.shape
    widths = [max(1, int(top).bit_length()) for top in v.max(0)]
    padded = np.zeros((-(-rows // 64) * 64, dims), np.int64)
    padded[:rows] = v
    by_bit = [np.ascontiguousarray(np.packbits(((padded >> b) & 1).astype(np.uint8), axis=0).T).view(np.uint64) for b in range(max(widths))]
    dim = np.repeat(np.arange(dims), widths)
    bit = np.concatenate([np.arange(w) for w in widths])
    return np.stack([by_bit[b][d] for d, b in zip(dim, bit)]), dim, bit


def cross_products(v: np.ndarray) -> np.ndarray:
    """v'v of non-negative integers (rows, dims), exact, by AND and population count of bit planes."""
    planes, dim, bit = bit_planes(v)
    counts = np.zeros((len(planes), len(planes)), np.int64)
    for i in range(len(planes)):
        counts[i, i:] = np.bitwise_count(planes[i] & planes[i:]).sum(1, dtype=np.int64)
    counts = np.maximum(counts, counts.T)
    wide = 2 * (int(bit.max()) + 1) + len(v).bit_length() > 62
    weights = np.array([1 << int(b) for b in bit], dtype=object if wide else np.int64)
    first = np.flatnonzero(bit == 0)
    return np.add.reduceat(np.add.reduceat(counts * weights[:, None] * weights[None, :], first, axis=0), first, axis=1)


def block_sums(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and cross-products of integers (rows, dims) as Python integers."""
    low = u.min(0)
    v = u - low
    s, low = v.sum(0).astype(object), low.astype(object)
    shifted = cross_products(v).astype(object) + np.outer(low, s) + np.outer(s, low) + len(u) * np.outer(low, low)
    return s + len(u) * low, shifted


@dataclass
class Whitening:
    """A fitted whitening: rows, their dimensions, sums of x, components (k, dims) scaled by 1 / sqrt(e), and shares."""

    n: int
    dims: int
    sums: list[int]
    directions: np.ndarray
    explained: np.ndarray
    flat: np.ndarray
    identity_error: float = 0.0


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector holds finite numbers only, none beyond LARGEST; an empty vector is none."""
    entry = lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) > LARGEST)
    return vectors.where(F.col(column).isNotNull() & (F.size(column) > 0) & ~F.exists(column, entry))


def _integers(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """floor(1024 c) of a batch's vectors, without the offset, which no covariance sees."""
    flat = pc.list_flatten(batch.column("v")).to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).astype(np.int64).reshape(-1, dims)


def _collect_sums(vectors: DataFrame, dims: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, sums and cross-products over all rows; D (D + 3) / 2 + 1 numbers reach the driver."""
    upper = np.triu_indices(dims)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, xx = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for batch in batches:
            u = _integers(batch, dims)
            for at in range(0, len(u), BLOCK):
                own, products = block_sums(u[at:at + BLOCK])
                n, s, xx = n + len(u[at:at + BLOCK]), s + own, xx + products
        if n:
            values = [n, *s.tolist(), *xx[upper].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(map(str, values), pa.string())], ["i", "t"])

    # decimals of 38 digits add up exactly; a text carries them out of Python
    sums = vectors.mapInArrow(partial, "i int, t string").groupBy("i").agg(F.sum(F.col("t").cast("decimal(38,0)")).cast("string").alias("t"))
    found = {r["i"]: int(r["t"]) for r in sums.collect()}
    values = [found[i] for i in range(1 + dims + len(upper[0]))]
    xx = np.zeros((dims, dims), object)
    xx[upper] = values[1 + dims:]
    return values[0], np.array(values[1:1 + dims], object), np.where(np.tri(dims, k=-1, dtype=bool), xx.T, xx)


def _project(u: np.ndarray, fitted: Whitening) -> np.ndarray:
    """(rows, k) whitened values; the centre is exact to a double before it is subtracted."""
    # n is a common factor: |u| stays below 2^41, so u is exact as a double
    centre = np.array([(s - OFFSET * fitted.n) / fitted.n for s in fitted.sums])
    return (u - centre) @ fitted.directions.T


def _deviations(u: np.ndarray, fitted: Whitening) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 of each row; None where it is beyond a long."""
    n, s = fitted.n, [v - OFFSET * fitted.n for v in fitted.sums]
    most = max((max(abs(n * int(hi) - own), abs(n * int(lo) - own)) for hi, lo, own in zip(u.max(0), u.min(0), s)), default=0)
    if most * most * len(s) < 1 << 63:
        d = u * n - np.array(s, np.int64)
        return (d * d).sum(1).tolist()
    d = u.astype(object) * n - np.array(s, object)
    return [v if v < 1 << 63 else None for v in (d * d).sum(1).tolist()]


def _identity_error(vectors: DataFrame, fitted: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity."""
    k, dims = len(fitted.directions), fitted.dims

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, scatter = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            z = _project(_integers(batch, dims), fitted)
            if len(z):
                own = z.mean(0)
                step = own - mean
                scatter += (z - own).T @ (z - own) + np.outer(step, step) * (n * len(z) / (n + len(z)))
                mean += step * (len(z) / (n + len(z)))
                n += len(z)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([mean.tolist()], pa.list_(pa.float64())),
                                              pa.array([scatter.ravel().tolist()], pa.list_(pa.float64()))], ["n", "mean", "scatter"])

    # the mean of all rows is 0 up to rounding, so a part's distance to it is its own mean
    tasks = vectors.mapInArrow(partial, "n long, mean array<double>, scatter array<double>")
    outer = F.flatten(F.transform("mean", lambda a: F.transform("mean", lambda b: a * b * F.col("n"))))
    cells = tasks.select(F.posexplode(F.zip_with("scatter", outer, lambda a, b: a + b)).alias("i", "v"))
    total = {r["i"]: r["v"] for r in cells.groupBy("i").agg(F.sum("v").alias("v")).collect()}
    error = np.array([total[i] for i in range(k * k)]).reshape(k, k) / fitted.n - np.eye(k)
    live = ~fitted.flat
    return float(np.abs(error[np.ix_(live, live)]).max(initial=0.0))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on vectors (v ARRAY<DOUBLE>) that are usable and of one length; None without rows."""
    top = vectors.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if top is None:
        return None
    dims = top["dims"]
    n, s, xx = _collect_sums(vectors.where(F.size("v") == dims), dims)
    centred = n * xx - np.outer(s, s)
    square = n * n
    cov = np.array([[v / square for v in row] for row in centred.tolist()])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components].T
    axes = axes * np.where(axes[np.arange(len(axes)), np.abs(axes).argmax(1)] < 0, -1.0, 1.0)[:, None]
    trace = float(np.trace(cov))
    flat = values <= FLAT * trace
    directions = np.where(flat[:, None], 0.0, axes / np.sqrt(np.where(flat, 1.0, values))[:, None])
    explained = np.maximum(values, 0.0) / trace if trace > 0 else np.zeros(len(values))
    fitted = Whitening(n, dims, [int(v) + OFFSET * n for v in s], directions, explained, flat)
    fitted.identity_error = _identity_error(vectors.where(F.size("v") == dims), fitted)
    return fitted


def whiten(docs: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row and component.

    Rows go whose vector is NULL or empty, holds NULL, NaN or infinity, an entry beyond LARGEST, or has another length
    than most vectors (of equally frequent lengths the longer counts). A NULL vec_id stays NULL; repeated rows count and
    appear as often as they stand. Components are numbered from 1 by falling eigenvalue, at most ``components`` and at
    most the length of the vectors; the largest entry of each is positive. A component without variance (one row, equal
    rows) has NULL for ``whitened`` and takes no part in ``identity_error``. ``deviation`` is NULL beyond a long. Other
    columns are not read; an empty table gives no rows.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = usable(docs).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fitted = fit(vectors, components)
    if fitted is None:
        return docs.sparkSession.createDataFrame([], schema)
    k = len(fitted.directions)
    types = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                       ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = _integers(batch, fitted.dims)
            if not len(u):
                continue
            m = len(u)
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                pa.array(np.full(m * k, fitted.n), pa.int64()), pa.array(_deviations(u, fitted), pa.int64()).take(each),
                pa.array(_project(u, fitted).ravel(), mask=np.tile(fitted.flat, m)), pa.array(np.tile(fitted.explained, m)),
                pa.array(np.full(m * k, fitted.identity_error))], schema=types)

    return vectors.where(F.size("v") == fitted.dims).mapInArrow(rows, schema)
