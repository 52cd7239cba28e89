"""Embedding whitening with exact integer statistics: a digit-slice GEMM.

Entries become integers. Batches are centred by an integer near each dimension's mean and
split into signed digits of ``DIGIT_BITS`` bits; products of digit matrices are sums of at most
``BATCH_ROWS`` products below 2**40, so float64 BLAS gives them exactly. Spark adds up these products
by (row, column, power) as decimals of 38 digits; the driver recombines d x d big integers,
subtracts what the integer centre left of the mean, and takes eigenvectors of the covariance.

What leaves a task has size d x d, whatever the number of rows.

Defined cases: rows whose vector is null, empty, or holds a null or non-finite entry are
dropped, as are vectors of another length than the most frequent (of equally frequent ones the
longest); repeated rows and ids count as often as they stand there; null ids are kept; an empty
list gives no rows; eigenvalues that are zero up to rounding have no component. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
DIGIT_BITS = 20
#: 2**40 times this many rows stays below 2**53.
BATCH_ROWS = 4_096
COMPONENTS = 32
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """n vectors with sums, unit eigenvectors (columns) by falling eigenvalue, and the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def integers(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>) of the rows without null or non-finite entries."""
    c = df[vector_col].cast("array<double>")
    fine = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = df.where(df[vector_col].isNotNull() & (F.size(df[vector_col]) > 0) & fine)
    return whole.select(df[id_col].cast("long").alias("vec_id"), F.transform(c, lambda v: (F.floor(v * SCALE) + SHIFT).cast("long")).alias("x"))


def of_length(rows: DataFrame, d: int) -> DataFrame:
    return rows.where(F.size("x") == d)


def _matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    lists = batch.column(name)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, BATCH_ROWS):
            yield b.slice(at, BATCH_ROWS)


def digits(y: np.ndarray) -> list[np.ndarray]:
    """Signed digits of int64 values, least first, as float64: y = sum of digit k times 2**(DIGIT_BITS * k)."""
    out, half = [], 1 << (DIGIT_BITS - 1)
    while True:
        low = ((y + half) & ((1 << DIGIT_BITS) - 1)) - half if np.abs(y).max(initial=0) >= half else y
        out.append(low.astype(np.float64))
        y = (y - low) >> DIGIT_BITS
        if not y.any():
            return out


def gram_slices(y: np.ndarray) -> dict[int, np.ndarray]:
    """Digit products of y by power: the Gram matrix is the sum of slice p times 2**(DIGIT_BITS * p), exactly."""
    parts, out = digits(y), {}
    for a, left in enumerate(parts):
        for b, right in enumerate(parts):
            product = (left.T @ right).astype(np.int64)
            out[a + b] = out.get(a + b, 0) + product
    return out


def gram(rows: DataFrame, centre: list[int]) -> list[list[int]]:
    """The exact Gram matrix of x - centre. Tasks give digit products, Spark adds them, the driver recombines them."""
    d = len(centre)
    upper = np.triu_indices(d)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in _batches(batches):
            for p, m in gram_slices(_matrix(b) - np.array(centre, dtype=np.int64)).items():
                # sums of a task are big integers, so no number of batches can overflow them
                sums[p] = sums.get(p, 0) + m[upper].astype(object)
        for p, m in sums.items():
            yield pa.RecordBatch.from_pydict({"i": pa.array(upper[0], pa.int32()), "j": pa.array(upper[1], pa.int32()), "p": pa.array([p] * len(m), pa.int32()), "v": pa.array([str(v) for v in m])})

    summed = rows.mapInArrow(partial, "i int, j int, p int, v string").groupBy("i", "j", "p").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    out = [[0] * d for _ in range(d)]
    for r in summed.collect():  # at most d * d entries a power
        out[r.i][r.j] += int(r.v) << (DIGIT_BITS * r.p)
    for i in range(d):
        for j in range(i):
            out[i][j] = out[j][i]
    return out


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``integers``; None if there are no rows."""
    entries = rows.select(F.size("x").alias("d"), F.posexplode("x").alias("i", "v"))
    sums = entries.groupBy("d", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).collect()
    if not sums:
        return None
    n, d = max((r.n, r.d) for r in sums)
    s = [int(r.s) for r in sorted((r for r in sums if r.d == d), key=lambda r: r.i)]
    rows = of_length(rows, d)
    centre = [(2 * v + n) // (2 * n) for v in s]
    g, left = gram(rows, centre), [v - n * c for v, c in zip(s, centre, strict=True)]
    # n * n * V is an integer; the division is correctly rounded
    v = np.array([[(n * g[i][j] - left[i] * left[j]) / (n * n) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    kept = min(components, int((values > d * np.finfo(float).eps * max(values[0], 0)).sum()))
    trace = sum(n * g[i][i] - left[i] * left[i] for i in range(d)) / (n * n)
    return Whitening(n, s, vectors[:, :kept], values[:kept], trace)


def _centred(x: np.ndarray, model: Whitening) -> np.ndarray:
    """n * x - S: int64 while it fits, else big integers."""
    most = max(int(np.abs(x).max(initial=0)) * model.n, max(map(abs, model.sums)))
    kind = np.int64 if most < 1 << 62 else object
    return x.astype(kind) * model.n - np.array(model.sums, dtype=kind)


def _deviation(c: np.ndarray) -> np.ndarray:
    """Exact row sums of squares; an error if one has no place in a long."""
    high = float(np.abs(c).max(initial=0))
    if high * high * c.shape[1] < 2.0**62:
        return (c.astype(np.int64) ** 2).sum(axis=1)
    return np.array([sum(v * v for v in map(int, row)) for row in c], dtype=np.int64)


def _project(c: np.ndarray, model: Whitening) -> np.ndarray:
    return (c / model.n).astype(np.float64) @ (model.vectors / np.sqrt(model.values))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, from the vectors themselves."""
    k = len(model.values)
    upper = np.triu_indices(k)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(k), np.zeros((k, k))
        for b in _batches(batches):
            w = _project(_centred(_matrix(b), model), model)
            total, products = total + w.sum(axis=0), products + w.T @ w
        yield pa.RecordBatch.from_pydict({"i": pa.array([*upper[0], *range(k)], pa.int32()), "j": pa.array([*upper[1], *[-1] * k], pa.int32()), "v": pa.array([*products[upper], *total], pa.float64())})

    summed = rows.mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    mean = {r.i: r.v / model.n for r in summed if r.j < 0}
    return max((abs(r.v / model.n - mean[r.i] * mean[r.j] - (r.i == r.j)) for r in summed if r.j >= 0), default=0.0)


def whiten(df: DataFrame, model: Whitening | None = None, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = integers(df, id_col, vector_col)
    model = model or fit(rows, components)
    if model is None:
        return df.sparkSession.createDataFrame([], _OUT)
    rows = of_length(rows, len(model.sums))
    error, k = identity_error(rows, model), len(model.values)
    shares = model.values / model.trace if model.trace else model.values

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            c = _centred(_matrix(b), model)
            w, r = _project(c, model), len(c)
            ids = b.column("vec_id").take(pa.array(np.repeat(np.arange(r), k)))
            columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), r)), pa.array(np.full(r * k, model.n)), pa.array(np.repeat(_deviation(c), k)), pa.array(w.ravel()), pa.array(np.tile(shares, r)), pa.array(np.full(r * k, error))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(apply, _OUT)


def whitened_embeddings(df: DataFrame) -> DataFrame:
    return whiten(df)
