"""Whitening of embeddings from an exact bit-sliced scatter.

Entries become whole numbers, x = floor(``SCALE`` * c) + ``SHIFT``.  A task takes its rows in
packs, subtracts each dimension's smallest entry of the pack, and slices what is left into bit
planes: plane (d, b) holds bit b of dimension d for 64 rows a word.  The sum of products of two
dimensions is the sum over plane pairs of 2^(a + b) times the popcount of their AND, so the
scatter needs no multiplication of entries and is exact.  Each task emits one triangle of
sums; Spark adds the triangles as decimals, and the d x d result is centred as whole numbers,
n * sum(x y) - sum(x) sum(y), before anything is rounded.  Only this matrix, whose size depends
on the dimensions alone, reaches the driver, where ``eigh`` solves it.

Defined results: vectors that are null or hold null, NaN or infinite entries take no part;
vectors of different lengths are fitted apart, each length as a fit list of its own; empty
vectors give no rows; rows with null or repeated ids stay rows of their own; components whose
eigenvalue is not above rounding (constant dimensions, fewer vectors than components) have a
null ``whitened`` and do not count in ``identity_error``; an empty table gives an empty result.
Entries must fit a long after scaling; ``deviation`` is a decimal of 38 digits.  Only the two
named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swapledger.llm.common import written

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Rows that are sliced into bit planes at once (a multiple of 64).
PACK = 8192
#: Whole numbers below this size are kept as longs without loss through every sum of a pack.
_SAFE = 2**62


@dataclass(frozen=True)
class Whitener:
    """Fit of the vectors of one length."""

    n: int
    #: Sum of each dimension.
    sums: tuple[int, ...]
    #: (dimension x component) unit eigenvectors, and their eigenvalues, falling.
    axes: np.ndarray
    values: np.ndarray
    trace: float

    def usable(self) -> np.ndarray:
        """Components with an eigenvalue above rounding."""
        return self.values > self.trace * len(self.sums) * np.finfo(float).eps


def whole(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and x (whole numbers) of the vectors that take part."""
    usable = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return (
        vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
        .where(F.col("v").isNotNull() & (F.size("v") > 0)).where(usable)
        .select("vec_id", F.transform("v", lambda c: F.floor(F.lit(float(SCALE)) * c) + F.lit(SHIFT)).alias("x"))
    )


def bit_planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(planes x words) words, and each plane's dimension and weight exponent, of nonnegative rows."""
    n, dims = y.shape
    height = [int(m).bit_length() for m in y.max(axis=0)]
    words = -(-n // 64)
    dim = np.repeat(np.arange(dims), height)
    place = np.concatenate([np.arange(h) for h in height]).astype(np.int64) if dims else np.zeros(0, np.int64)
    planes = np.zeros((len(dim), words * 8), np.uint8)
    for p, (d, b) in enumerate(zip(dim.tolist(), place.tolist())):
        bits = np.packbits((y[:, d] >> b) & 1, bitorder="little")
        planes[p, : len(bits)] = bits
    return planes.view(np.uint64), dim, place


def sliced_scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and the upper triangle of sums of products of whole-number rows, as unbounded whole numbers."""
    n, dims = x.shape
    low = x.min(axis=0)
    planes, dim, place = bit_planes(x - low)
    weight = np.array([1 << int(p) for p in place], object)
    ones = np.bitwise_count(planes).sum(axis=1, dtype=np.int64)
    shifted = np.zeros(dims, object)
    np.add.at(shifted, dim, ones * weight)
    cross = np.zeros((dims, dims), object)
    small = max((int(w) for w in weight), default=1) ** 2 * 4 * n < _SAFE
    held = weight.astype(np.int64) if small else weight
    # Planes of one dimension lie together, so their weighted counts are summed by runs.
    names, begins = np.unique(dim, return_index=True)
    for turn, (d, at) in enumerate(zip(names.tolist(), begins.tolist())):
        runs = begins[turn:] - at
        for p in np.flatnonzero(dim == d):
            both = np.bitwise_count(planes[p] & planes[at:]).sum(axis=1, dtype=np.int64)
            cross[d, names[turn:]] += int(weight[p]) * np.add.reduceat(both * held[at:], runs)
    base = low.astype(object)
    outer = np.multiply.outer(base, shifted)
    cross = cross + outer + outer.T + n * np.multiply.outer(base, base)
    return shifted + n * base, cross


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(length, rows) packs of vectors of one length."""
    held: dict[int, list[np.ndarray]] = {}
    count: dict[int, int] = {}
    for batch in batches:
        column = batch.column("x")
        size = np.diff(column.offsets.to_numpy())
        flat = column.flatten().to_numpy(zero_copy_only=False)
        starts = np.cumsum(size) - size
        for dims in np.unique(size).tolist():
            picked = flat[starts[size == dims][:, None] + np.arange(dims)]
            held.setdefault(dims, []).append(picked)
            count[dims] = count.get(dims, 0) + len(picked)
            if count[dims] >= PACK:
                yield dims, np.concatenate(held.pop(dims))
                count[dims] = 0
    for dims, parts in sorted(held.items()):
        yield dims, np.concatenate(parts)


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, list] = {}
    for dims, rows in _rows(batches):
        sums, cross = sliced_scatter(rows)
        have = total.setdefault(dims, [0, np.zeros(dims, object), np.zeros((dims, dims), object)])
        have[0] += len(rows)
        have[1] = have[1] + sums
        have[2] = have[2] + cross
    for dims, (n, sums, cross) in sorted(total.items()):
        i, j = np.triu_indices(dims)
        # Row -1 holds the count, row i with column -1 the sum of dimension i.
        at = [(-1, -1, n), *((d, -1, int(s)) for d, s in enumerate(sums)), *zip(i.tolist(), j.tolist(), map(int, cross[i, j]))]
        yield pa.RecordBatch.from_pydict({
            "dims": pa.array([dims] * len(at), pa.int32()), "i": pa.array([a for a, _, _ in at], pa.int32()),
            "j": pa.array([b for _, b, _ in at], pa.int32()), "total": pa.array([str(v) for _, _, v in at]),
        })


def solve(n: int, sums: list[int], cross: np.ndarray, most: int = COMPONENTS) -> Whitener:
    """Leading components of the covariance, centred as whole numbers."""
    s = np.array(sums, object)
    centred = n * cross - np.multiply.outer(s, s)
    v = np.array([[float(c) for c in r] for r in centred.tolist()]) / float(n) / float(n)
    values, axes = np.linalg.eigh(v)
    by = np.argsort(-values, kind="stable")[:most]
    return Whitener(n, tuple(int(x) for x in sums), axes[:, by], values[by], float(sum(int(c) for c in np.diag(centred))) / float(n) / float(n))


def fit(rows: DataFrame, most: int = COMPONENTS) -> dict[int, Whitener]:
    """One fit for each length of ``x``; the driver gets the sums of d (d + 3) / 2 + 1 columns a length."""
    sums = rows.mapInArrow(_scatter, "dims int, i int, j int, total string")
    table = sums.groupBy("dims", "i", "j").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    out: dict[int, Whitener] = {}
    for dims in sorted({r["dims"] for r in table}):
        mine = {(r["i"], r["j"]): int(r["total"]) for r in table if r["dims"] == dims}
        cross = np.array([[mine[min(i, j), max(i, j)] for j in range(dims)] for i in range(dims)], object)
        out[dims] = solve(mine[-1, -1], [mine[d, -1] for d in range(dims)], cross, most)
    return out


def project(x: np.ndarray, fitted: Whitener) -> tuple[list[int], np.ndarray]:
    """Exact deviation of each row, and its whitened components."""
    sums, n = np.array(fitted.sums, object), fitted.n
    wide = max(abs(int(x.max())), abs(int(x.min()))) * n + max(map(abs, fitted.sums)) >= _SAFE
    gap = n * x.astype(object) - sums if wide else n * x - sums.astype(np.int64)
    most = max(abs(int(gap.max())), abs(int(gap.min())))
    # Unbounded whole numbers where squares may pass a long.
    square = gap if most * most * x.shape[1] < _SAFE else gap.astype(object)
    deviation = [int(d) for d in (square * square).sum(axis=1)]
    scale = np.where(fitted.usable(), np.sqrt(np.maximum(fitted.values, 0)), np.nan)
    with np.errstate(invalid="ignore", divide="ignore"):
        return deviation, (gap.astype(np.float64) / n) @ fitted.axes / scale


def _project(fits: dict[int, Whitener]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("x")
            size = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(size) - size
            for dims in np.unique(size).tolist():
                at = np.flatnonzero(size == dims)
                deviation, w = project(flat[starts[at][:, None] + np.arange(dims)], fits[dims])
                yield pa.RecordBatch.from_pydict({
                    "vec_id": batch.column("vec_id").take(pa.array(at)), "dims": pa.array(np.full(len(at), dims), pa.int32()),
                    "deviation": pa.array([str(d) for d in deviation]),
                    "w": pa.array([[None if np.isnan(c) else c for c in r] for r in w.tolist()], pa.list_(pa.float64())),
                })

    return run


def whitened(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """vec_id, dims, component, n, deviation, whitened, explained, identity_error: a row per vector and component."""
    spark = vectors.sparkSession
    rows = whole(vectors, vec_id, embedding)
    fits = fit(rows, most)
    kind = dict(rows.dtypes)["vec_id"]
    out = written(
        rows.mapInArrow(_project(fits), f"vec_id {kind}, dims int, deviation string, w array<double>")
        .withColumn("deviation", F.col("deviation").cast("decimal(38,0)")), "whitened")
    pairs = [(i, j) for i in range(most) for j in range(i, most)]
    cov = {(i, j): F.covar_pop(F.get("w", F.lit(i)), F.get("w", F.lit(j))).alias(f"c_{i}_{j}") for i, j in pairs}
    # One row for each length: the covariance of what was written, not of what was meant.
    error = {}
    for r in out.groupBy("dims").agg(*cov.values()).collect():
        gaps = [abs(r[f"c_{i}_{j}"] - (i == j)) for i, j in pairs if r[f"c_{i}_{j}"] is not None]
        error[r["dims"]] = max(gaps, default=None)
    facts = spark.createDataFrame(
        [(d, c, f.n, float(f.values[c] / f.trace) if f.trace else None, error.get(d)) for d, f in fits.items() for c in range(len(f.values))],
        "dims int, c int, n long, explained double, identity_error double")
    # At most ``most`` rows for each length of vector.
    long = out.select("vec_id", "dims", "deviation", F.posexplode("w").alias("c", "whitened"))
    return long.join(F.broadcast(facts), ["dims", "c"]).select(
        "vec_id", "dims", (F.col("c") + 1).alias("component"), "n", "deviation", "whitened", "explained", "identity_error")
