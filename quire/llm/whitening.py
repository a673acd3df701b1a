"""Whitening of embeddings by shifted CholeskyQR.

Entries become whole numbers ``floor(scale * c) + offset``; the statistics are over the distinct vectors.
Means are exact integer sums, and a centred row is ``(n * x - S) / n`` with an exact numerator, so the offset costs
no precision.  The centred rows A are never orthogonalised in place: a Gram pass sums Q'Q over all rows, where Q is A
after the triangular solves with the factors found so far, and its Cholesky factor is the next one.  The
first pass is shifted, so that it ends for any conditioning; the next ones bring Q to orthonormal columns.
The composed factor R has A = QR, and its singular values and right vectors are those of A: the covariance, whose
condition is the square of A's, is never decomposed.

Each pass gives one small matrix a partition; those are added up in groups of FANIN by ascending partition, level by
level on the executors, so that reruns agree and one matrix reaches the driver.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import prepare
from quire.session import materialize

FANIN = 16
#: Gram passes at most (one shifted, then plain), and how far from orthonormal the last may find the rows.
PASSES, ORTHONORMAL = 6, 1e-13
#: Components whose eigenvalue is below this share of the largest are rounding noise of linearly dependent dimensions.
RANK = 1e-20
#: Entries of a greater size would leave the whole numbers that doubles and sums hold.
LARGEST = float(1 << 30)
OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whole(batch: pa.RecordBatch, scale: float, offset: int) -> pa.Array:
    """The vectors of a batch as int64 bytes; null for those that are null or hold null, non-finite or too large entries."""
    vectors = batch.column("_v")
    flat, off = vectors.flatten(), np.concatenate([[0], np.cumsum(np.diff(vectors.offsets.to_numpy()) * vectors.is_valid().to_numpy(zero_copy_only=False))])
    c = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # a null entry becomes NaN
    fine = np.abs(c) <= LARGEST  # false for NaN
    x = np.floor(scale * np.where(fine, c, 0.0)).astype(np.int64) + offset
    wrong = np.concatenate([[0], np.cumsum(~fine)])
    valid = vectors.is_valid().to_numpy(zero_copy_only=False) & (wrong[off[1:]] == wrong[off[:-1]]) & (np.diff(off) > 0)
    return pa.array([x[a:b].tobytes() if ok else None for a, b, ok in zip(off[:-1], off[1:], valid)], pa.binary())


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: float, offset: int) -> tuple[DataFrame, int]:
    """Written table ``_id, x`` of the usable rows, and their dimension.

    The dimension is the most frequent one (of several, the largest); vectors of another one are not usable."""
    src = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _whole(batch, scale, offset)], ["_id", "x"])

    kind = src.schema["_id"].dataType.simpleString()
    x = materialize(src.mapInArrow(run, f"_id {kind}, x binary").filter("x IS NOT NULL"), "whole-vectors")
    size = x.groupBy(F.octet_length("x").alias("s")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("s")).limit(1).collect()
    return (x.filter(F.octet_length("x") == size[0]["s"]), size[0]["s"] // 8) if size else (x, 0)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, d)


def add_up(rows: DataFrame, partial, like: np.ndarray) -> np.ndarray:
    """The sum of ``partial(batches)`` (an array like ``like``) over all partitions, added in the order of the partitions."""
    shape, kind = like.shape, like.dtype

    def run(batches):
        from pyspark import TaskContext

        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([partial(batches).tobytes()], pa.binary())], ["part", "m"])

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        total = np.zeros(shape, kind)
        for m in table.column("m").to_pylist():
            total = total + np.frombuffer(m, kind).reshape(shape)
        return pa.table({"part": pa.array([table.column("part")[0].as_py() // FANIN], pa.int64()), "m": pa.array([total.tobytes()], pa.binary())})

    sums = materialize(rows.mapInArrow(run, "part long, m binary"), "partial-sums")
    last = sums.agg(F.max("part")).first()[0]
    if last is None:
        return np.zeros(shape, kind)
    while True:
        sums = sums.groupBy(F.floor(F.col("part") / FANIN).alias("_g")).applyInArrow(add, "part long, m binary")
        last //= FANIN
        if last == 0:
            break
    return np.frombuffer(sums.first()["m"], kind).reshape(shape)


class Centre:
    """Exact centring: number of fitted vectors, and their sums as whole numbers."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.base = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """n * x - S; Python's whole numbers where 64 bits might not do."""
        away = x - self.base
        if len(x) and int(np.abs(away).max() + 1) * self.n >= 1 << 62:
            return away.astype(object) * self.n - self.rest
        return away * self.n - self.rest

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.numerators(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of squared numerators; None beyond the range of a long."""
        num = self.numerators(x)
        if num.dtype != object and (not len(num) or int(np.abs(num).max()) ** 2 * x.shape[1] < 1 << 63):
            return (num * num).sum(1).tolist()
        found = (num.astype(object) ** 2).sum(1).tolist()
        return [f if f < 1 << 63 else None for f in found]


def solve(a: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """A times the inverses of the upper triangular factors, the first factor first, by substitution."""
    for r in factors:
        q = np.empty_like(a)
        for j in range(a.shape[1]):
            q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
        a = q
    return a


def cholesky_qr(gram, n: int, d: int) -> np.ndarray:
    """R of the centred rows; ``gram(factors)`` is one distributed pass that sums Q'Q after the solves."""
    factors, u = [], np.finfo(np.float64).eps / 2
    for k in range(PASSES):
        g = gram(factors)
        size = np.linalg.norm(g, 2)
        if k > 1 and np.abs(g - np.eye(d)).max() <= ORTHONORMAL:
            break
        # the published bound for the first pass, but no more than a few digits; later ones only guard against dependent dimensions
        shift = min(11 * (n * d + d * (d + 1)) * u, 1e-10) if k == 0 else d * u
        factors.append(np.linalg.cholesky(g + shift * max(size, np.finfo(np.float64).tiny) * np.eye(d)).T)
        if k == 2 and np.linalg.eigvalsh(g)[0] < 0.5:
            break  # dependent dimensions stay short of orthonormal; more passes would only amplify their noise
    r = np.eye(d)
    for f in factors:
        r = f @ r
    return r


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, scale: float = 64, offset: int = 0) -> DataFrame:
    """One row per usable vector and component: the id, ``component, n, deviation, whitened, explained, identity_error``.

    Components are unit eigenvectors of the covariance of the distinct whole vectors (divisor n), by falling eigenvalue; of
    the two signs the one whose largest entry is positive.  ``explained`` is the eigenvalue's share of the trace, ``deviation``
    the exact sum of ``(n * x - S) ** 2`` (null if it leaves the range of a long) and ``identity_error`` the largest absolute entry of the whitened
    vectors' covariance minus the identity, measured in a pass of its own.

    Null and empty vectors and those with null, non-finite or very large entries (over 2 ** 30) give no rows, and so do
    vectors of another dimension than the most frequent one.  Dimensions that depend on others give no components: there may be fewer than asked for, and
    none for a single distinct vector.  Repeated rows count once in the statistics and each give their rows; a null
    id is kept; other columns, also ones named like the results, are not read."""
    spark = vectors.sparkSession
    prepare(spark)
    x, d = whole_vectors(vectors, id_col, vector_col, scale, offset)
    kind = x.schema["_id"].dataType.simpleString()
    fit = materialize(x.select("x").distinct(), "whitening-fit")
    n = fit.count()
    if n < 2:
        return spark.createDataFrame([], f"{id_col} {kind}, {OUT}")
    mask = (1 << 20) - 1

    def halves(batches):
        total = np.zeros((2, d), np.int64)
        for batch in batches:
            m = _matrix(batch.column("x"), d)
            total += np.stack([(m >> 20).sum(0), (m & mask).sum(0)])
        return total

    high, low = add_up(fit, halves, np.zeros((2, d), np.int64)).tolist()
    centre = Centre(n, [(a << 20) + b for a, b in zip(high, low)])

    def gram(factors):
        def partial(batches):
            total = np.zeros((d, d))
            for batch in batches:
                q = solve(centre.rows(_matrix(batch.column("x"), d)), factors)
                total += q.T @ q
            return total
        return add_up(fit, partial, np.zeros((d, d)))

    _, s, vt = np.linalg.svd(cholesky_qr(gram, n, d))
    e = s * s / n
    rank = int(np.sum(e > RANK * e[0])) if e[0] > 0 else 0
    k = min(components, rank)
    if k == 0:
        return spark.createDataFrame([], f"{id_col} {kind}, {OUT}")
    axes = vt[:k].T * np.sign(vt[np.arange(k), np.abs(vt[:k]).argmax(1)])
    axes, explained = axes / np.sqrt(e[:k]), e[:k] / e.sum()

    def moments(batches):
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = centre.rows(_matrix(batch.column("x"), d)) @ axes
            total += np.concatenate([w.T @ w, w.sum(0)[None]])
        return total

    m = add_up(fit, moments, np.zeros((k + 1, k))) / n
    error = float(np.abs(m[:k] - np.outer(m[k], m[k]) - np.eye(k)).max())

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column("x"), d)
            r = len(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").take(pa.array(np.repeat(np.arange(r), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), r)), pa.array(np.full(r * k, n)),
                 pa.array([v for v in centre.deviations(rows) for _ in range(k)], pa.int64()), pa.array((centre.rows(rows) @ axes).ravel()),
                 pa.array(np.tile(explained, r)), pa.array(np.full(r * k, error))],
                ["_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(run, f"_id {kind}, {OUT}").withColumnRenamed("_id", id_col)
