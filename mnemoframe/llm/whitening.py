"""Whitening of embeddings: exact integer sums give the mean, a second pass sums centred outer products, LAPACK turns them.

An entry c is taken as the integer ``floor(64 * c) + 1000000``, held within +-2**62. The fit list holds each distinct integer vector
once; it is made with map-side combining, so that a vector which fills a third of the table is one row of the shuffle, and is stored
for the three passes over it:

1. sums of each dimension, as integers, merged by ``treeAggregate``;
2. outer products of the vectors less their mean, one matrix product a batch, merged by ``treeAggregate``;
3. mean and covariance of the whitened fit list, which measure how far it is from the identity.

The driver holds matrices of dimensions x dimensions only. The projection is broadcast (dimensions x components), and the table is
projected where it lies, without a shuffle.

Defined cases: a vector that is null, or holds a null, NaN or infinite entry, is left out; so is one of another length than most of the
other vectors have (of equally frequent lengths the longer counts), an empty one among them. A null id stays null; repeated rows are
returned as often as they come, with equal figures to the last bit. Directions without variance (1e-10 of the greatest eigenvalue or
less) are no components, so a fit list of one vector has none. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoframe.llm.common import dropped, stored

SCALE, BASE, MOST = 64, 1_000_000, 1 << 62
FLAT = 1e-10  # eigenvalues up to this share of the greatest have no direction of their own
WIDTHS = (np.int16, np.int32, np.int64)


class Fit(NamedTuple):
    """What the passes learn: size of the fit list, sums, eigenvalues by fall, their share of all variance, projection, measured error."""

    n: int
    sums: list[int]
    values: np.ndarray
    explained: np.ndarray
    projection: np.ndarray
    identity_error: float


def integer_vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integer vectors) of the rows of each length that hold finite entries only."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()  # the entries of rows that are not null
    entries = pc.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    firsts = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        block = entries[firsts[rows][:, None] + np.arange(size)]
        whole = np.isfinite(block).all(axis=1)
        x = np.clip(np.floor(SCALE * block[whole]), -float(MOST), float(MOST) - 2**10).astype(np.int64) + BASE
        yield rows[whole], x


def pack(x: np.ndarray) -> list[bytes]:
    """Each vector less ``BASE`` in the narrowest integers that hold it: equal vectors, and no others, give equal bytes."""
    low = x - BASE
    most = np.abs(low).max(axis=1) if x.size else np.zeros(len(x), np.int64)
    out = np.empty(len(x), object)
    for lower, kind in zip((-1, *(np.iinfo(w).max for w in WIDTHS)), WIDTHS):
        rows = np.flatnonzero((most > lower) & (most <= np.iinfo(kind).max))
        out[rows] = [v.tobytes() for v in low[rows].astype(kind)]
    return out.tolist()


def unpack(column: pa.Array, dims: int) -> Iterator[np.ndarray]:
    """The integer vectors, one block for each width that occurs."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        joined = b"".join(column.filter(pa.array(sizes == size)).to_pylist())
        yield np.frombuffer(joined, WIDTHS[{2: 0, 4: 1, 8: 2}[int(size) // dims]]).reshape(-1, dims).astype(np.int64) + BASE


def packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, x in integer_vectors(batch.column(0)):
            yield pa.record_batch([pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array(pack(x), pa.binary())], ["dims", "packed"])


def scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, exactly: as 64-bit integers where they hold it, else as Python's."""
    most = int(np.abs(x).max(initial=0)) * n
    if 2 * most < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return np.asarray(scaled(x, n, sums) / n, np.float64)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[Decimal | None]:
    """Sum over the dimensions of ``(n * x - sums) ** 2``, exactly; null beyond 38 digits."""
    v = scaled(x, n, sums)
    if v.dtype != object and int(np.abs(v).max(initial=0)) ** 2 * x.shape[1] >= 1 << 63:
        v = v.astype(object)
    return [Decimal(k) if k < 10**38 else None for k in map(int, (v * v).sum(axis=1))]


def tree(partials: DataFrame, zero, decode, merge):
    """Merge what the partitions found, level by level on the executors."""
    return partials.rdd.treeAggregate(zero, lambda acc, row: merge(acc, decode(row)), merge, depth=3)


def integer_sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for batch in batches:
            for x in unpack(batch.column(0), dims):
                n += len(x)  # halves, so that no sum of a batch leaves 64 bits
                total = [t + (int(a) << 31) + int(b) for t, a, b in zip(total, (x >> 31).sum(axis=0), (x & 0x7FFFFFFF).sum(axis=0))]
        yield pa.record_batch([pa.array([n], pa.int64()), pa.array([[str(t) for t in total]], pa.list_(pa.string()))], ["n", "sums"])

    return tree(fit.mapInArrow(partial, "n long, sums array<string>"), (0, [0] * dims), lambda r: (r.n, list(map(int, r.sums))), lambda a, b: (a[0] + b[0], [p + q for p, q in zip(a[1], b[1])]))


def outer_products(fit: DataFrame, dims: int, n: int, sums: list[int]) -> np.ndarray:
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            for x in unpack(batch.column(0), dims):
                c = centred(x, n, sums)
                total += c.T @ c
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["products"])

    flat = tree(fit.mapInArrow(partial, "products binary"), np.zeros(dims * dims), lambda r: np.frombuffer(bytes(r.products)), lambda a, b: a + b)
    return flat.reshape(dims, dims)


def project(c: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Row by row in one order of summation, so that equal rows of batches of any size give equal bits, as a matrix product wouldn't."""
    return np.column_stack([(c * w).sum(axis=1) for w in projection.T]) if projection.shape[1] else np.zeros((len(c), 0))


def moments(n: int, mean: np.ndarray, spread: np.ndarray, m: int, mean2: np.ndarray, spread2: np.ndarray):
    """Two sets' sizes, means and centred products as one set's."""
    if not n or not m:
        return (m, mean2, spread2) if not n else (n, mean, spread)
    step = mean2 - mean
    return n + m, mean + step * (m / (n + m)), spread + spread2 + np.outer(step, step) * (n * m / (n + m))


def whitened_covariance(fit: DataFrame, dims: int, n: int, sums: list[int], projection: np.ndarray) -> np.ndarray:
    k = projection.shape[1]
    zero = (0, np.zeros(k), np.zeros((k, k)))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = zero
        for batch in batches:
            for x in unpack(batch.column(0), dims):
                w = project(centred(x, n, sums), projection)
                mean = w.mean(axis=0)
                acc = moments(*acc, len(w), mean, (w - mean).T @ (w - mean))
        yield pa.record_batch([pa.array([acc[0]], pa.int64()), pa.array([acc[1].tobytes()], pa.binary()), pa.array([acc[2].tobytes()], pa.binary())], ["n", "mean", "spread"])

    size, _, spread = tree(fit.mapInArrow(partial, "n long, mean binary, spread binary"), zero, lambda r: (r.n, np.frombuffer(bytes(r.mean)), np.frombuffer(bytes(r.spread)).reshape(k, k)), lambda a, b: moments(*a, *b))
    return spread / max(1, size)


def learn(df: DataFrame, vector: str = "embedding", components: int = 16) -> Fit | None:
    """Fit on the distinct integer vectors of ``df``; None where no vector remains."""
    vectors = df.select(vector).mapInArrow(packed_rows, "dims int, packed binary").groupBy("dims", "packed").agg(F.count("*").alias("copies"))
    kept = stored(vectors, "vectors")
    common = kept.groupBy("dims").agg(F.sum("copies").alias("rows")).orderBy(F.desc("rows"), F.desc("dims")).first()
    if common is None:
        dropped(kept)
        return None
    dims = common.dims
    fit = kept.where(F.col("dims") == dims).select("packed")
    n, sums = integer_sums(fit, dims)
    covariance = outer_products(fit, dims, n, sums) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    many = min(components, int((values > max(values[0], 0) * FLAT).sum()))
    total = float(np.trace(covariance))
    projection = np.ascontiguousarray(vectors[:, :many] / np.sqrt(values[:many]))
    error = float(np.abs(whitened_covariance(fit, dims, n, sums, projection) - np.eye(many)).max(initial=0))
    dropped(kept)
    return Fit(n, sums, values[:many], values[:many] / total if many else values[:0], projection, error)


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """Per remaining row: ``key``, whitened array<double> by falling eigenvalue, deviation decimal(38, 0), n, explained array<double>,
    identity_error.

    ``deviation`` is the exact sum over the dimensions of (n * x - S) ** 2, null where it has more than 38 digits; ``explained`` is each
    component's share of all variance; ``identity_error`` is the largest entry of the fit list's whitened covariance less the identity.
    """
    kind = df.schema[key].dataType.simpleString()
    fit = learn(df, vector, components)
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(fit)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = shared.value
        for batch in batches:
            for rows, x in integer_vectors(batch.column(1)):
                if fit is None or x.shape[1] != len(fit.sums):
                    continue
                w = project(centred(x, fit.n, fit.sums), fit.projection)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
                yield pa.record_batch([batch.column(0).take(pa.array(rows)), lists, pa.array(deviations(x, fit.n, fit.sums), pa.decimal128(38, 0))], [key, "whitened", "deviation"])

    out = df.select(key, vector).mapInArrow(projected, f"`{key}` {kind}, whitened array<double>, deviation decimal(38,0)")
    explained = F.array(*[F.lit(float(e)) for e in fit.explained]) if fit is not None else F.array()
    return out.select(key, "whitened", "deviation", F.lit(fit.n if fit else 0).cast("long").alias("n"), explained.cast("array<double>").alias("explained"), F.lit(fit.identity_error if fit else 0.0).alias("identity_error"))


def by_component(white: DataFrame, key: str = "vec_id") -> DataFrame:
    """One row for each row and component of ``whiten``'s result, components numbered from 1; a deviation beyond 64 bits is null."""
    parts = white.select(key, "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), "identity_error", "explained", F.posexplode("whitened").alias("place", "whitened"))
    return parts.select(key, (F.col("place") + 1).alias("component"), "n", "deviation", "whitened", F.element_at("explained", F.col("place") + 1).alias("explained"), "identity_error")
