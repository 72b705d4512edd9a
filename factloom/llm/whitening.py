"""Whitening of embeddings from an exact integer scatter.

Entries become integers, floor(scale * c), and every distinct integer vector counts once (the fit list). Tasks add up
counts, sums and cross-products of the fit list in integers of any size: entries are cut into limbs of ``LIMB`` bits,
limb products of ``BLOCK`` rows are below 2^53 and so exact in a floating-point matrix product, and running totals carry
into higher limbs. Spark adds the tasks' limbs as longs. The driver gets one total per pair of dimensions, whatever the
number of rows, forms n * XtX - S * St in Python's integers, and only then divides and calls ``eigh``. A constant added
to all entries changes nothing in that matrix, so the offset of the contract (``OFFSET``) is left out of the sums.

Defined cases: vectors that are null or hold a null, NaN or infinite entry are left out; vectors of another length than
the one that most of the fit list has (of the longer of two, where equal) are left out as well, and so are empty ones;
integers saturate at 2^60; repeated rows and null ids keep a row each; components whose eigenvalue is not above the
rounding error of the matrix (all of them where every vector is the same) don't exist, so there may be fewer than asked
for, and an empty table gives an empty result; a deviation of over 63 bits is null; extra columns are ignored.
Longer vectors than ``LARGEST_DIM`` are refused.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
LIMB, BLOCK, LIMBS = 20, 4096, 12  # 2 * LIMB + log2(BLOCK) < 53
BLOCKS_A_CARRY = 128  # 4 limb pairs add up in one place: 4 * 128 * 2^52 < 2^63
LARGEST, LARGEST_DIM = 1 << 60, 2048
WIDTHS = (2, 4, 8)


@dataclass(frozen=True)
class Whitening:
    """``n`` vectors with sums ``sums`` (of integers without offset), and unit components with their eigenvalues."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray  # (dimensions, components)
    eigenvalues: np.ndarray
    explained: np.ndarray

    @property
    def dim(self) -> int:
        return len(self.sums)


def _vector_column(vectors: DataFrame, vector_col: str) -> Column:
    kind = vectors.schema[vector_col].dataType
    plain = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))
    return F.col(f"`{vector_col}`") if plain else F.col(f"`{vector_col}`").cast("array<double>")


def integers(column: pa.Array, scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, int64 matrix) of the usable vectors of a batch, one for each length."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == dim)
        entries = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # nulls become NaN
        good = np.isfinite(entries).all(1)
        with np.errstate(over="ignore"):
            whole = np.clip(np.floor(scale * entries[good]), -LARGEST, LARGEST)
        yield dim, at[good], whole.astype(np.int64)


def pack(rows: np.ndarray) -> list[bytes]:
    """Each row's bytes, in the narrowest of ``WIDTHS`` that holds all its entries, so equal vectors have equal bytes."""
    most = np.maximum(rows.max(1), -(rows.min(1) + 1))
    out: list[bytes] = [b""] * len(rows)
    for width, low in zip(WIDTHS, (0, 1 << 15, 1 << 31), strict=True):
        at = np.flatnonzero((most >= low) & (most < (1 << (8 * width - 1))))
        raw, step = rows[at].astype(f"<i{width}").tobytes(), width * rows.shape[1]
        for k, row in enumerate(at.tolist()):
            out[row] = raw[k * step : (k + 1) * step]
    return out


def unpack(column: pa.Array, dim: int) -> np.ndarray:
    raw = column.to_pylist()
    out = np.empty((len(raw), dim), np.int64)
    by_width = np.fromiter(map(len, raw), np.int64, len(raw)) // dim
    for width in WIDTHS:
        at = np.flatnonzero(by_width == width)
        if len(at):
            out[at] = np.frombuffer(b"".join([raw[i] for i in at.tolist()]), f"<i{width}").reshape(-1, dim)
    return out


def fit_list(vectors: DataFrame, vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(dim, x): every distinct integer vector once, written. Repeats are dropped in their own task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, _, rows in integers(batch.column(0), scale):
                yield pa.RecordBatch.from_arrays([pa.array([dim] * len(rows), pa.int32()), pa.array(pack(rows), pa.binary())], ["dim", "x"])

    return materialize(vectors.select(_vector_column(vectors, vector_col).alias("v")).mapInArrow(run, "dim int, x binary").distinct(), "fit-list")


def _limbs(block: np.ndarray) -> list[np.ndarray]:
    """Signed integers as limbs, lowest first; all but the last are not negative."""
    out = []
    while np.abs(block).max(initial=0) >= 1 << (LIMB - 1):
        out.append((block & ((1 << LIMB) - 1)).astype(np.float64))
        block = block >> LIMB
    return [*out, block.astype(np.float64)]


def _carry(totals: np.ndarray) -> None:
    for k in range(LIMBS - 1):
        totals[k + 1] += totals[k] >> LIMB
        totals[k] &= (1 << LIMB) - 1


def scatter_limbs(matrices: Iterator[np.ndarray], dim: int) -> np.ndarray:
    """(LIMBS, cells) longs: cross-products above and on the diagonal, then sums, then the count."""
    upper = np.triu_indices(dim)
    cells = len(upper[0])
    totals = np.zeros((LIMBS, cells + dim + 1), np.int64)
    blocks = 0
    for rows in matrices:
        for low in range(0, len(rows), BLOCK):
            block = rows[low : low + BLOCK]
            limbs = _limbs(block)
            for (i, a), (j, b) in itertools.product(enumerate(limbs), repeat=2):
                totals[i + j, :cells] += (a.T @ b)[upper].astype(np.int64)
            for i, a in enumerate(limbs):
                totals[i, cells:-1] += a.sum(0).astype(np.int64)
            totals[0, -1] += len(block)
            blocks += 1
            if blocks % BLOCKS_A_CARRY == 0:
                _carry(totals)
    _carry(totals)
    return totals


def exact_scatter(fit: DataFrame, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """n, sums and cross-products of the fit list, as Python integers in object arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = scatter_limbs((unpack(batch.column(0), dim) for batch in batches if batch.num_rows), dim)
        limb, cell = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(limb.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(totals[limb, cell])], ["limb", "cell", "value"])

    sums = fit.select("x").mapInArrow(run, "limb int, cell int, value long").groupBy("limb", "cell").agg(F.sum("value").alias("value")).toArrow()  # at most LIMBS a pair of dimensions
    upper = np.triu_indices(dim)
    cells = len(upper[0])
    flat = np.zeros(cells + dim + 1, object)
    limb, cell = sums["limb"].to_numpy(), sums["cell"].to_numpy()
    value = sums["value"].to_numpy().astype(object)
    for k in np.unique(limb).tolist():
        at = limb == k
        flat[cell[at]] += value[at] * (1 << (LIMB * k))
    cross = np.zeros((dim, dim), object)
    cross[upper] = flat[:cells]
    cross.T[upper] = flat[:cells]
    return int(flat[-1]), flat[cells:-1], cross


def decompose(n: int, sums: np.ndarray, cross: np.ndarray, most: int = COMPONENTS) -> Whitening:
    """Components by falling eigenvalue; the entry of largest size of each is positive."""
    scatter = n * cross - np.multiply.outer(sums, sums)  # exact
    covariance = (scatter / (n * n)).astype(np.float64) if n else np.zeros(scatter.shape)
    trace = sum(scatter.diagonal().tolist()) / (n * n) if n else 0.0
    values, columns = np.linalg.eigh(covariance)
    values, columns = values[::-1], columns[:, ::-1]
    real = int((values > trace * len(values) * np.finfo(np.float64).eps).sum())
    k = min(most, real)
    values, columns = values[:k], columns[:, :k]
    lead = columns[np.abs(columns).argmax(0), np.arange(k)] if k else np.empty(0)
    return Whitening(n, tuple(int(s) for s in sums), columns * np.where(lead < 0, -1.0, 1.0), values, values / trace if k else values)


def fit_whitening(fit: DataFrame, most: int = COMPONENTS) -> Whitening:
    """The whitening of a written ``fit_list``."""
    sizes = fit.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if sizes is None:
        return Whitening(0, (), np.empty((0, 0)), np.empty(0), np.empty(0))
    if sizes["dim"] > LARGEST_DIM:
        raise ValueError(f"vectors of {sizes['dim']} entries; at most {LARGEST_DIM} can be whitened")
    return decompose(*exact_scatter(fit.where(F.col("dim") == sizes["dim"]), sizes["dim"]), most)


def centred(rows: np.ndarray, model: Whitening) -> np.ndarray:
    """n * x - S, exact: longs where they are sure to fit, else Python integers."""
    largest = model.n * int(np.abs(rows).max(initial=0)) + max(map(abs, model.sums))
    if largest < 1 << 62:
        return model.n * rows - np.array(model.sums, np.int64)
    return model.n * rows.astype(object) - np.array(model.sums, object)


def deviations(exact: np.ndarray) -> list[int | None]:
    """The squared length of each row, exact; null beyond 63 bits."""
    largest = max(abs(int(exact.max(initial=0))), abs(int(exact.min(initial=0))))
    if exact.dtype != object and exact.shape[1] * largest * largest < 1 << 63:
        return (exact * exact).sum(1).tolist()
    whole = exact.astype(object)
    return [s if s < 1 << 63 else None for s in (whole * whole).sum(1).tolist()]


def projected(exact: np.ndarray, model: Whitening) -> np.ndarray:
    return (exact / model.n).astype(np.float64) @ model.components / np.sqrt(model.eigenvalues)


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest entry by which the whitened fit list's covariance differs from the identity, measured on all its rows."""
    k = len(model.eigenvalues)
    upper = np.triu_indices(k)
    shared = fit.sparkSession.sparkContext.broadcast(model)  # a matrix of dimensions by components

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        totals = np.zeros(len(upper[0]) + k)
        for batch in batches:
            if batch.num_rows:
                w = projected(centred(unpack(batch.column(0), m.dim), m), m)
                totals += np.concatenate([(w.T @ w)[upper], w.sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(totals), dtype=np.int32)), pa.array(totals)], ["cell", "value"])

    sums = fit.where(F.col("dim") == model.dim).select("x").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    flat = np.zeros(len(upper[0]) + k)
    for cell, value in sums.collect():  # one a pair of components
        flat[cell] = value / model.n
    shared.destroy()
    mean = flat[len(upper[0]) :]
    return float(np.abs(flat[: len(upper[0])] - mean[upper[0]] * mean[upper[1]] - (upper[0] == upper[1])).max(initial=0.0))


def whiten(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """id, deviation (squared length of n * x - S) and whitened (array<double>) of every usable vector."""
    ids = vectors.schema[id_col].dataType
    if not len(model.eigenvalues):
        return vectors.sparkSession.createDataFrame([], T.StructType([T.StructField("id", ids), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))]))
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for dim, at, rows in integers(batch.column(1), scale):
                if dim == m.dim and len(at):
                    exact = centred(rows, m)
                    w = projected(exact, m)
                    offsets = pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(deviations(exact), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))], ["id", "deviation", "whitened"])

    schema = T.StructType([T.StructField("id", ids), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    return vectors.select(F.col(f"`{id_col}`").alias("id"), _vector_column(vectors, vector_col).alias("v")).mapInArrow(run, schema)


def whitened_embeddings(vectors: DataFrame) -> DataFrame:
    """The contract's digest: a row for each usable vector and component."""
    fit = fit_list(vectors)
    model = fit_whitening(fit)
    error = identity_error(fit, model) if len(model.eigenvalues) else 0.0
    share = F.array(*[F.lit(float(e)) for e in model.explained]).cast("array<double>")
    rows = whiten(vectors, model).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        F.col("id").cast("long").alias("vec_id"), (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
