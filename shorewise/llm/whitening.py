"""Whitening of embeddings by a one-sided Jacobi SVD of the R that a blockwise TSQR leaves.

Entries are quantised to whole numbers, so that their sums are exact and don't
depend on how rows are dealt. Each partition reduces its centred rows, block by
block, to a triangular R; a tree of merges of FAN each reduces these to one. Plane
rotations then make R's columns orthogonal: the accumulated rotations are the
components, the columns' lengths their standard deviations. Products of the data
with itself, which would square its condition, are never formed.

Rows stay where they are read: what is shuffled or reaches the driver is sums,
triangles and components, whose sizes depend on the dimension alone.

Defined results: rows whose vector is null or empty, or holds null or non-finite
entries, are dropped, and so are vectors of another length than the most
frequent one (the longer of equally frequent). Entries that are more than 2^40
steps from 0 count as that far. Repeated rows, null and repeated ids count and
come back as often as they are there. A component without variance has null
`whitened`, and identity_error is of the others (0 if there are none). deviation
is null where it exceeds a long. There are as many components as asked for, or
as dimensions if these are fewer. An empty table gives an empty result; columns
that aren't asked for aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shorewise.llm.common import settled, table

COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
#: Triangles that one merge takes; rows that a QR takes beside the triangle so far.
FAN, BLOCK_ROWS = 16, 2048
_LIMIT, _SWEEPS, _FLAT = 2.0**40, 60, 1e-13


@dataclass
class Whitening:
    """n rows, the sums of their x by dimension (exact), eigenvalues falling, and unit components as rows."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float

    def scales(self) -> np.ndarray:
        """Standard deviations; NaN for components without variance."""
        e = self.eigenvalues
        return np.sqrt(np.where(e > _FLAT * e[:1].sum(), e, np.nan))


def vectors_of(column: pa.Array, scale: int, shift: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of an Arrow list column, for each length: length, places of the complete vectors, and their x."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    whole = (lengths > 0) & (wrong[starts + lengths] == wrong[starts])
    for d in np.unique(lengths[whole]):
        at = np.flatnonzero(whole & (lengths == d))
        rows = values[starts[at][:, None] + np.arange(d)]
        yield int(d), at, np.clip(np.floor(rows * scale), -_LIMIT, _LIMIT).astype(np.int64) + shift


def _sums(df: DataFrame, scale: int, shift: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums by dimension; (0, []) without vectors."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at, x in vectors_of(b.column(0), scale, shift):
                yield pa.RecordBatch.from_pydict({"d": [d], "n": [len(at)], "sums": [x.sum(axis=0)]}, schema=pa.schema([("d", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))

    partial = settled(df.mapInArrow(f, "d int, n long, sums array<long>"))
    most = partial.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return 0, []
    each = partial.where(F.col("d") == most.d).select(F.posexplode("sums").alias("i", "s"))
    found = each.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # a row for each dimension
    return most.n, [int(r.s) for r in sorted(found)]


def _centring(n: int, sums: list[int]) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """f of x: x less the mean's whole part (exact), and less all of the mean."""
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
    return lambda x: (x - whole, (x - whole) - rest / n)


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _leaves(df: DataFrame, n: int, sums: list[int], scale: int, shift: int) -> DataFrame:
    """(node, r): each partition's triangle, flat."""
    d, centred = len(sums), _centring(n, sums)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for b in batches:
            for length, _, x in vectors_of(b.column(0), scale, shift):
                for a in range(0, len(x) if length == d else 0, BLOCK_ROWS):
                    r = _triangle(np.vstack([r, centred(x[a : a + BLOCK_ROWS])[1]]))
        if len(r):
            yield pa.RecordBatch.from_pydict({"node": [TaskContext.get().partitionId()], "r": [r.ravel()]}, schema=pa.schema([("node", pa.int64()), ("r", pa.list_(pa.float64()))]))

    return df.mapInArrow(f, "node long, r array<double>")


def _stacked(pdf: pd.DataFrame, d: int) -> np.ndarray:
    return _triangle(np.vstack([r.reshape(-1, d) for r in pdf.sort_values("node")["r"]]))


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared lengths of r's columns after plane rotations have made them orthogonal, falling, and the accumulated rotations' columns as rows.

    A sweep meets every pair of columns once, in rounds of disjoint pairs; it ends when no pair is turned any more.
    """
    a, d = r.copy(), r.shape[1]
    v, even = np.eye(d), d + d % 2
    for _ in range(_SWEEPS):
        turned, order = False, np.arange(even)
        for _ in range(even - 1):
            i, j = order[: even // 2], order[even // 2 :][::-1]
            real = (i < d) & (j < d)
            i, j = i[real], j[real]
            p, q, m = (a[:, i] ** 2).sum(axis=0), (a[:, j] ** 2).sum(axis=0), (a[:, i] * a[:, j]).sum(axis=0)
            skew = np.abs(m) > 1e-16 * d * np.sqrt(p * q)
            if skew.any():
                turned, i, j = True, i[skew], j[skew]
                z = (q[skew] - p[skew]) / (2 * m[skew])
                t = np.where(z < 0, -1.0, 1.0) / (np.abs(z) + np.hypot(1, z))
                c = 1 / np.hypot(1, t)
                s = c * t
                for w in (a, v):
                    w[:, i], w[:, j] = c * w[:, i] - s * w[:, j], s * w[:, i] + c * w[:, j]
            order = np.concatenate([order[:1], order[-1:], order[1:-1]])
        if not turned:
            break
    lengths = (a**2).sum(axis=0)
    order = np.argsort(-lengths, kind="stable")
    v = v[:, order].T
    signs = np.sign(v[np.arange(d), np.abs(v).argmax(axis=1)])
    return lengths[order], v * signs[:, None]


def fit(df: DataFrame, vector: str, *, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> Whitening | None:
    """The whitening of all complete vectors of a column; None without any."""
    df = df.select(F.col(vector).cast("array<double>").alias("vector"))
    n, sums = _sums(df, scale, shift)
    if not n:
        return None
    d = len(sums)
    level = settled(_leaves(df, n, sums, scale, shift))
    while level.count() > FAN:

        def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"node": [key[0]], "r": [_stacked(pdf, d).ravel()]})

        level = settled(level.groupBy(F.expr(f"node div {FAN}").alias("up")).applyInPandas(merge, "node long, r array<double>"))

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths, v = jacobi(_stacked(pdf, d))
        return pd.DataFrame({"k": np.arange(d), "length": lengths, "v": list(v)})

    found = level.groupBy().applyInPandas(last, "k int, length double, v array<double>")
    rows = sorted(found.where(F.col("k") < components).collect())  # at most `components` rows
    trace = found.agg(F.sum("length")).first()[0] / n
    return Whitening(n, sums, np.array([r.length for r in rows]) / n, np.array([r.v for r in rows]), trace)


def _projected(model: Whitening, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x less the mean's whole part, and the whitened rows."""
    whole, c = _centring(model.n, model.sums)(x)
    return whole, c @ model.components.T / model.scales()


def deviations(model: Whitening, whole: np.ndarray) -> list[int | None]:
    """Of each row the sum over dimensions of (n * x - sum)^2, exact."""
    n, rest = model.n, [s % model.n for s in model.sums]
    most = float(np.abs(whole).max(initial=0)) * n + n
    if most * most * len(rest) < 2.0**62:
        return ((whole * n - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
    exact = (sum((n * int(x) - r) ** 2 for x, r in zip(row, rest, strict=True)) for row in whole)
    return [s if s < 2**63 else None for s in exact]


def identity_error(df: DataFrame, vector: str, model: Whitening, *, scale: int = SCALE, shift: int = SHIFT) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity, over components with variance."""
    varied = ~np.isnan(model.scales())
    d, k = len(model.sums), int(varied.sum())

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for b in batches:
            for length, _, x in vectors_of(b.column(0), scale, shift):
                if length == d:
                    z = _projected(model, x)[1][:, varied]
                    first, second = first + z.sum(axis=0), second + z.T @ z
        yield pa.RecordBatch.from_pydict({"s": [np.concatenate([first, second.ravel()])]}, schema=pa.schema([("s", pa.list_(pa.float64()))]))

    sums = df.select(F.col(vector).cast("array<double>").alias("vector")).mapInArrow(f, "s array<double>")
    found = sorted(sums.select(F.posexplode("s").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s")).collect())
    every = np.array([r.s for r in found]) / model.n
    # the rows are centred already; what rounding leaves of their mean is taken off too
    off = every[k:].reshape(k, k) - np.outer(every[:k], every[:k]) - np.eye(k)
    return float(np.abs(off).max(initial=0))


def whiten(df: DataFrame, vector: str, keep: list[str], *, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """A row for each complete vector and component: the columns of keep, component (from 1), n, deviation, whitened, explained and identity_error."""
    own = df.select(*keep).schema.fields
    made = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own), made])
    model = fit(df, vector, components=components, scale=scale, shift=shift)
    if model is None:
        return df.sparkSession.createDataFrame([], kinds)
    error, d, k = identity_error(df, vector, model, scale=scale, shift=shift), len(model.sums), len(model.eigenvalues)
    explained = model.eigenvalues / model.trace if model.trace > 0 else np.zeros(k)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for length, at, x in vectors_of(b.column(b.num_columns - 1), scale, shift):
                if length != d:
                    continue
                whole, z = _projected(model, x)
                rows, flat = pa.array(np.repeat(at, k)), z.ravel()
                arrays = [
                    *[c.take(rows) for c in b.columns[:-1]],
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(rows), model.n)),
                    pa.array(deviations(model, whole), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k))),
                    pa.array(flat, mask=np.isnan(flat)),
                    pa.array(np.tile(explained, len(at))),
                    pa.array(np.full(len(rows), error)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=[*b.schema.names[:-1], "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return df.select(*keep, F.col(vector).cast("array<double>").alias("__vector")).mapInArrow(f, kinds)


def op11_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), "embedding", ["vec_id"])


QUERIES = {"op11_jacobi_whitening": op11_jacobi_whitening}
