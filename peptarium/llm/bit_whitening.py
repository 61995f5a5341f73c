"""Whitening of embeddings from an exact, bit-sliced scatter matrix.

Entries become whole numbers ``x = floor(256 * c)``. Each distinct x-vector is taken once. In blocks of
rows every dimension is shifted to start at 0 and cut into bit planes; a plane packs one bit of 64 rows
into a word. The cross-product of two dimensions is then the sum over pairs of planes of
``2**(i + j) * popcount(plane_i AND plane_j)``, which is exact. Blocks add up as whole numbers (32-bit
limbs in Spark, Python integers on the driver, dimension**2 of them), and ``n * Q - S S'`` centres them as
whole numbers too; only the finished covariance is rounded to doubles for ``eigh``.

Defined cases: rows whose vector is null, empty, or holds a null or non-finite entry are dropped, and so
are vectors of another length than the most common one (the longest of those on a tie); values beyond a
long saturate; ``deviation`` is null where it exceeds a long; components without variance, to rounding,
are left out, so equal vectors and single rows give no components and an empty table gives no rows;
repeated rows count once in the fit and each get their own result; a null id stays null; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peptarium.llm.common import stored

SCALE = 256
COMPONENTS = 4
BLOCK = 1 << 14
_LIMBS = 6
_WIDTHS = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}
_TOP, _LOW = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def whole_vectors(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, x) for each vector length among the usable rows of a list column."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy().astype(np.int64)
    flat = pc.fill_null(vectors.flatten().cast(pa.float64()), float("nan")).to_numpy()
    starts = np.cumsum(sizes) - sizes
    good = np.zeros(len(sizes) + 1, np.int64)
    bad_before = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = (sizes > 0) & (bad_before[starts + sizes] == bad_before[starts])
    for size in np.unique(sizes[good]).tolist():
        rows = np.flatnonzero(good & (sizes == size))
        with np.errstate(over="ignore"):
            v = np.floor(flat[starts[rows][:, None] + np.arange(size)] * SCALE)
        inside = (v < 2.0**63) & (v >= -(2.0**63))
        x = np.where(inside, v, 0).astype(np.int64)
        yield rows, np.where(inside, x, np.where(v > 0, _TOP, _LOW))


def packed(x: np.ndarray) -> list[bytes]:
    """Each vector in the narrowest whole-number width that holds it; equal vectors give equal bytes."""
    high, low = x.max(axis=1), x.min(axis=1)
    width = np.select([(low >= -(1 << (8 * w - 1))) & (high < 1 << (8 * w - 1)) for w in (1, 2, 4)], [1, 2, 4], 8)
    out: list = [None] * len(x)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        for k, vector in zip(rows.tolist(), x[rows].astype(_WIDTHS[w]), strict=True):
            out[k] = bytes([w]) + vector.tobytes()
    return out


def unpacked(vectors: list[bytes]) -> np.ndarray:
    """Packed vectors of one length as a matrix of longs."""
    groups = [np.array([np.frombuffer(v, _WIDTHS[w], offset=1) for v in vectors if v[0] == w], np.int64) for w in sorted({v[0] for v in vectors})]
    return np.concatenate(groups)


def bit_planes(u: np.ndarray) -> np.ndarray:
    """Planes of unsigned ``u`` (rows, dimensions): (dimensions, bits, words of 64 rows)."""
    bits = int(u.max()).bit_length()
    rows = -(-len(u) // 64) * 64
    padded = np.zeros((rows, u.shape[1]), np.uint64)
    padded[: len(u)] = u
    planes = np.empty((u.shape[1], bits, rows // 64), np.uint64)
    for k in range(bits):
        ones = ((padded >> np.uint64(k)) & np.uint64(1)).astype(bool)
        planes[:, k] = np.ascontiguousarray(np.packbits(ones, axis=0).T).view(np.uint64)
    return planes


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums (d) and cross-products (d, d; upper half) of the rows of ``x``, as Python integers."""
    low = x.min(axis=0)
    u = x.view(np.uint64) - low.view(np.uint64)
    planes = bit_planes(u)
    d, bits, _ = planes.shape
    weight = np.array([1 << k for k in range(bits)], object)
    small = 2 * bits + len(x).bit_length() < 62
    if small:
        weight = weight.astype(np.int64)
    ones = np.bitwise_count(planes).sum(axis=2, dtype=np.int64)
    sums = ((ones if small else ones.astype(object)) @ weight).astype(object) if bits else np.zeros(d, object)
    products = np.zeros((d, d), object)
    for a in range(d):
        row = np.zeros((d - a, bits), weight.dtype)
        for i in range(bits):
            both = np.bitwise_count(planes[a, i] & planes[a:]).sum(axis=2, dtype=np.int64)
            row = row + (both if small else both.astype(object)) * weight[i]
        if bits:
            products[a, a:] = row @ weight
    shift, n = low.astype(object), len(x)
    products += np.outer(shift, sums) + np.outer(sums, shift) + n * np.outer(shift, shift)
    return sums + n * shift, products


def _limbs(value: int) -> list[int]:
    return [(value >> (32 * k)) & 0xFFFFFFFF for k in range(_LIMBS - 1)] + [value >> (32 * (_LIMBS - 1))]


@dataclass
class Whitening:
    """n fitted vectors with sums S; ``vectors`` (d, k) are unit eigenvectors with ``values``, largest first."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float


def solve(n: int, sums: np.ndarray, products: np.ndarray, components: int) -> Whitening:
    """Centre as whole numbers, then decompose. ``products`` needs its upper half only.

    ``identity_error`` is taken from the exact covariance V: the covariance of the whitened fit list is
    ``D E' V E D`` for eigenvectors E and D = 1 / sqrt(values).
    """
    d = len(sums)
    upper = np.triu(np.ones((d, d), bool))
    centred = n * products - np.outer(sums, sums)
    cov = np.zeros((d, d))
    cov[upper] = [c / (n * n) for c in centred[upper].tolist()]
    cov = cov + np.triu(cov, 1).T
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(np.trace(cov))
    k = int((values[:components] > trace * d * np.finfo(float).eps).sum())
    values, vectors = values[:k].copy(), vectors[:, :k].copy()
    if k:
        vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    scaled = vectors / np.sqrt(values)
    error = np.abs(scaled.T @ cov @ scaled - np.eye(k))
    return Whitening(n, sums, vectors, values, values / trace if k else values, float(error.max()) if k else 0.0)


def fit(df: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct whole vectors of ``column``; None if there are none."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in whole_vectors(batch.column(0)):
                for k in range(0, len(x), BLOCK):
                    part = packed(x[k : k + BLOCK])
                    yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]] * len(part), pa.int32()), pa.array(part, pa.binary())], ["d", "x"])

    distinct = stored(df.select(F.col(column)).mapInArrow(pack, "d int, x binary").distinct(), "vectors")
    top = distinct.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if top is None:
        return None

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: tuple | None = None
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                x = unpacked(batch.column(0).slice(k, BLOCK).to_pylist())
                got = (len(x), *scatter(x))
                total = got if total is None else tuple(p + q for p, q in zip(total, got, strict=True))
        if total is not None:
            n, sums, products = total
            a, b = np.triu_indices(len(sums))
            rows = [(-1, -1, n), *((-1, k, s) for k, s in enumerate(sums.tolist())), *zip(a.tolist(), b.tolist(), products[a, b].tolist(), strict=True)]
            limbs = zip(*(_limbs(int(v)) for _, _, v in rows), strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), *(pa.array(x, pa.int64()) for x in limbs)],
                ["a", "b", *(f"l{k}" for k in range(_LIMBS))],
            )

    limbs = [f"l{k}" for k in range(_LIMBS)]
    parts = distinct.where(F.col("d") == top["d"]).select("x").mapInArrow(add, "a int, b int, " + ", ".join(f"{x} bigint" for x in limbs))
    d = top["d"]
    n, sums, products = 0, np.zeros(d, object), np.zeros((d, d), object)
    for row in parts.groupBy("a", "b").agg(*[F.sum(x).alias(x) for x in limbs]).collect():  # d * (d + 3) / 2 + 1 rows
        value = sum(row[x] << (32 * k) for k, x in enumerate(limbs))
        if row["b"] < 0:
            n = value
        elif row["a"] < 0:
            sums[row["b"]] = value
        else:
            products[row["a"], row["b"]] = value
    return solve(n, sums, products, components)


def centred(x: np.ndarray, model: Whitening) -> np.ndarray:
    """n * x - S, exact: longs where they hold it with room to square and add, else Python integers."""
    reach = model.n * max(int(x.max()), -int(x.min())) + max(abs(int(s)) for s in model.sums)
    if x.shape[1] * reach * reach < 2**63:
        return model.n * x - model.sums.astype(np.int64)
    return model.n * x.astype(object) - model.sums


def whiten(df: DataFrame, model: Whitening | None, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key, deviation (sum of squares of n * x - S), whitened (array, one entry a component) of each usable row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for rows, x in whole_vectors(batch.column(1)):
                if model is None or x.shape[1] != len(model.sums):
                    continue
                scaled = model.vectors / np.sqrt(model.values) / model.n
                for k in range(0, len(x), BLOCK):
                    y = centred(x[k : k + BLOCK], model)
                    squares = (y * y).sum(axis=1).tolist()
                    z = y.astype(np.float64) @ scaled
                    ends = np.arange(len(y) + 1, dtype=np.int32) * z.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(rows[k : k + BLOCK])),
                            pa.array([s if s <= _TOP else None for s in squares], pa.int64()),
                            pa.ListArray.from_arrays(pa.array(ends), pa.array(z.ravel())),
                        ],
                        ["_key", "deviation", "whitened"],
                    )

    out = df.select(F.col(key).cast("long").alias("_key"), F.col(column)).mapInArrow(run, "_key bigint, deviation bigint, whitened array<double>")
    return out.withColumnRenamed("_key", key)


def whitening_report(df: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error; one row per usable row and component."""
    model = fit(df, components=components)
    long = whiten(df, model).select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    shares = F.array(*[F.lit(float(e)) for e in model.explained]) if model and len(model.explained) else F.array().cast("array<double>")
    return long.select(
        "vec_id",
        (F.col("_at") + 1).cast("int").alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.try_element_at(shares, F.col("_at") + 1).alias("explained"),
        F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )
