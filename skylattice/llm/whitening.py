"""Whitening of embeddings, with all covariances recovered from variances of sums.

Entries become whole numbers, so that every sum is exact. One pass adds up each dimension. A second subtracts each
dimension's rounded mean and adds up the squares of every dimension and of every sum of two dimensions; with
var(a + b) = var(a) + var(b) + 2 cov(a, b) the differences give all cross-covariances as exact fractions, which are
rounded once and go to eigh. Tasks hold one number for each pair of dimensions, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
#: Whole numbers beyond this are taken as this, so that sums of squares of 10^9 rows have at most 38 digits.
LARGEST = 1 << 46
#: Numbers that a task works on at once.
BLOCK = 1 << 18
#: Eigenvalues of at most this share of the largest one count as none: eigh leaves errors of this kind.
NO_VARIANCE = 1e-12
_LONG = 1 << 63


@dataclass
class Whitening:
    """n rows with integer sums; `components` are the unit eigenvectors (rows) by falling eigenvalue."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    eigenvalues: np.ndarray
    components: np.ndarray

    @property
    def middle(self) -> np.ndarray:
        """Each dimension's mean, rounded to a whole number."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def rest(self) -> list[int]:
        """What is left of the sums after the rounded means."""
        return [s - self.n * int(m) for s, m in zip(self.sums, self.middle, strict=True)]

    @property
    def explained(self) -> np.ndarray:
        """Each component's share of the total variance; 0 without any variance."""
        total = float(np.trace(self.covariance))
        return self.eigenvalues / total if total > 0 else np.zeros(len(self.eigenvalues))

    def used(self, k: int) -> np.ndarray:
        """Which of the first `k` components have variance beyond what rounding leaves of the largest."""
        top = self.eigenvalues[: min(k, len(self.eigenvalues))]
        return top > NO_VARIANCE * max(top.max(initial=0.0), 0.0)

    def project(self, centred: np.ndarray, k: int) -> np.ndarray:
        """Whitened values of rows less `middle`; NaN for components without variance."""
        used = self.used(k)
        x = centred.astype(np.float64) - np.array([r / self.n for r in self.rest])
        out = np.full((len(x), len(used)), np.nan)
        out[:, used] = x @ self.components[: len(used)][used].T / np.sqrt(self.eigenvalues[: len(used)][used])
        return out

    def deviations(self, centred: np.ndarray) -> list[int]:
        """Sums over dimensions of (n * x - sum)^2, exact."""
        bound = self.n * (int(np.abs(centred).max(initial=0)) + 1)
        if bound * bound * centred.shape[1] < _LONG:
            d = self.n * centred - np.array(self.rest, np.int64)
            return (d * d).sum(1).tolist()
        rest = self.rest
        return [sum((self.n * x - r) ** 2 for x, r in zip(row, rest, strict=True)) for row in centred.tolist()]


def _whole(column: pa.Array) -> np.ndarray:
    """Rows of whole numbers floor(64 * c) + 1000000 of vectors of one length."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.clip(np.floor(SCALE * values), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    step = max(1, BLOCK // dims)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """`key` and the vectors as doubles; null and empty vectors and those with null or non-finite entries go."""
    return (vectors.select(F.col(key).alias("key"), F.col(column).cast("array<double>").alias("v"))
            .where("size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"))


def _totals(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and sums of their dimensions; of several lengths, of the most frequent one (the longest of ties)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[int, int] = {}
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            lengths = np.diff(batch.column(0).offsets.to_numpy())
            for length in np.unique(lengths).tolist():
                same = batch.column(0).filter(pa.array(lengths == length))
                for at in range(0, len(same), max(1, BLOCK // length)):
                    x = _whole(same.slice(at, max(1, BLOCK // length)))
                    total[length] = total.get(length, 0) + x.sum(0)
                    count[length] = count.get(length, 0) + len(x)
        for length, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([length] * length, pa.int32()), pa.array(range(length), pa.int32()), pa.array([count[length]] * length, pa.int64()), pa.array(sums)],
                                             ["length", "dim", "n", "s"])

    parts = rows.select("v").mapInArrow(add, "length int, dim int, n long, s long").groupBy("length", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    packed = parts.groupBy("length").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("dim", "s"))).alias("sums"))
    best = packed.orderBy(F.desc("n"), F.desc("length")).limit(1).collect()
    return (best[0]["n"], [int(s["s"]) for s in best[0]["sums"]]) if best else (0, [])


def _squares(rows: DataFrame, middle: np.ndarray) -> dict[tuple[int, int], int]:
    """Sums of squares of each centred dimension (i, i) and of each sum of two of them (i, j), i < j."""
    dims = len(middle)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = [0] * (dims * dims)
        held, bound = np.zeros((dims, dims), np.int64), 0

        def keep() -> None:
            for at, value in enumerate(held.ravel().tolist()):
                exact[at] += value
            held[:] = 0

        for block in _blocks(batches, dims):
            z = (_whole(block.column(0)) - middle).T.copy()
            most = len(block) * (2 * int(np.abs(z).max()) + 1) ** 2
            if bound + most >= _LONG:
                keep()
                bound = 0
            bound += most
            if most >= _LONG:
                z, bound = z.astype(object), 0
                for i in range(dims):
                    for j in range(i, dims):
                        s = z[i] + z[j] if j > i else z[i]
                        exact[i * dims + j] += int((s * s).sum())
                continue
            for i in range(dims):
                own = z[i + 1 :] + z[i]
                held[i, i] += int((z[i] * z[i]).sum())
                held[i, i + 1 :] += np.einsum("jr,jr->j", own, own)
        keep()
        if any(exact):
            i, j = np.triu_indices(dims)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array([str(exact[a * dims + b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)])], ["i", "j", "q"])

    parts = rows.where(F.size("v") == dims).select("v").mapInArrow(add, "i int, j int, q string")
    return {(r["i"], r["j"]): int(r["q"]) for r in parts.groupBy("i", "j").agg(F.sum(F.col("q").cast("decimal(38,0)")).alias("q")).collect()}


def covariances(n: int, rest: list[int], squares: dict[tuple[int, int], int]) -> np.ndarray:
    """Covariances from sums of squares of dimensions and of pair sums, whose own sums are `rest`; each rounded once."""
    dims = len(rest)

    def spread(i: int, j: int) -> int:
        """n times the sum of squares of the centred dimension or pair sum."""
        return n * squares.get((i, j), 0) - (rest[i] + rest[j] if i != j else rest[i]) ** 2

    own = [spread(i, i) for i in range(dims)]
    out = np.zeros((dims, dims))
    for i in range(dims):
        out[i, i] = own[i] / n**2
        for j in range(i + 1, dims):
            out[i, j] = out[j, i] = (spread(i, j) - own[i] - own[j]) / (2 * n**2)
    return out


def fit(rows: DataFrame) -> Whitening | None:
    """The whitening of `usable` rows; None without any. Eigenvectors have a positive entry of largest size."""
    n, sums = _totals(rows)
    if not n:
        return None
    model = Whitening(n, sums, np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)))
    model.covariance = covariances(n, model.rest, _squares(rows, model.middle))
    values, vectors = np.linalg.eigh(model.covariance)
    model.eigenvalues, model.components = values[::-1].copy(), vectors.T[::-1].copy()
    most = np.abs(model.components).argmax(1)
    model.components *= np.sign(model.components[np.arange(len(most)), most])[:, None]
    return model


def identity_error(rows: DataFrame, model: Whitening, k: int) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity, measured on all rows."""
    used, dims, middle = model.used(k), len(model.sums), model.middle
    size = int(used.sum())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1))
        for block in _blocks(batches, dims):
            y = model.project(_whole(block.column(0)) - middle, k)[:, used]
            y = np.concatenate((np.ones((len(y), 1)), y), axis=1)
            total += y.T @ y
        i, j = np.triu_indices(size + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "s"])

    if not size:
        return 0.0
    total = np.zeros((size + 1, size + 1))
    for r in rows.where(F.size("v") == dims).select("v").mapInArrow(add, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        total[r["i"], r["j"]] = total[r["j"], r["i"]] = r["s"]
    mean = total[0, 1:] / model.n
    return float(np.abs(total[1:, 1:] / model.n - np.outer(mean, mean) - np.eye(size)).max())


def whitened(vectors: DataFrame, k: int = 32, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """`key`, component (1 to `k` or the number of dimensions), n, deviation, whitened, explained, identity_error.

    Null and empty vectors and those with null, NaN or infinite entries are left out, as are vectors of another length than
    the most frequent one (of equally frequent ones the longest). Repeated and null keys are rows of their own. Components
    without variance (NO_VARIANCE) have a null in `whitened` and do not count in `identity_error`; a `deviation` beyond 64 bits is null.
    Entries beyond 2^46 / 64 count as that. A table without usable vectors gives no rows. Other columns are ignored.
    """
    rows = usable(vectors, key, column)
    schema = f"{key} {dict(vectors.dtypes)[key]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(rows)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error, dims, middle = identity_error(rows, model, k), len(model.sums), model.middle
    top = len(model.used(k))
    explained = model.explained[:top]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, max(dims, top)):
            z = _whole(block.column(1)) - middle
            rows = np.repeat(np.arange(len(z)), top)
            y = model.project(z, k).ravel()
            far = pa.array([d if d < _LONG else None for d in model.deviations(z)], pa.int64())
            yield pa.RecordBatch.from_arrays([block.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, top + 1, dtype=np.int32), len(z))), pa.array(np.full(len(y), model.n)), far.take(pa.array(rows)),
                                              pa.array(y, mask=np.isnan(y)), pa.array(np.tile(explained, len(z))), pa.array(np.full(len(y), error))],
                                             [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.where(F.size("v") == dims).mapInArrow(project, schema)
