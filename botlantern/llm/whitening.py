"""Whitening of embeddings by a distributed QR and a one-sided Jacobi SVD.

Entries become whole numbers floor(256 * c), and the fit list has each distinct vector of them once. Its
sums are exact. Rows of the fit list, centred by n * x - S in whole numbers before any rounding, are
reduced block by block to upper triangular factors (TSQR): a task folds its blocks into one factor of
d x d, and factors are folded `FAN` at a time until one is left. The covariance, whose condition is
the square of theirs, is never formed. Plane rotations then make the columns of that factor orthogonal;
their lengths over sqrt(n) are the standard deviations, and the product of all rotations holds the
components. Rotations of disjoint pairs are applied together, in rounds of a tournament.

What reaches the driver depends on the dimension alone: sums, one factor, the moments of whitened
vectors. Vectors go through the components where they lie.

Defined cases: rows whose vector is null or holds a null or non-finite entry are dropped; so are all,
where no entry differs (no variance, hence no component). Vectors shorter than the longest one count as
if zeros followed. Entries beyond +-2**62 / 256 are taken as that bound. Components whose standard
deviation is below `RANK` times the largest are not numbered, as nothing is spread along them: there may
be fewer than asked for. A component's entry of largest size, of equal ones the first, is positive; equal
eigenvalues leave their order to rounding. Null and repeated vec_ids are rows of their own; copies of a
vector count once in the fit. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Factors that one task folds into one.
FAN = 16
#: Rows that are looked at together.
BLOCK = 4096
#: Standard deviations below this share of the largest count as none.
RANK = 1e-12
MOST = 1 << 62
SWEEPS = 60
WHITENED = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """n and sums of the fit list, and the components: rows of directions by falling standard deviation."""

    n: int
    sums: list[int]
    deviations: np.ndarray
    components: np.ndarray
    explained: np.ndarray

    @property
    def kept(self) -> int:
        return int((self.deviations > RANK * self.deviations[0]).sum()) if len(self.deviations) and self.deviations[0] > 0 else 0


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and x, an array of longs, of the rows that have a finite vector."""
    c = F.col("_v")
    finite = F.coalesce(F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("_v")).where(finite)
    entry = lambda e: F.floor(F.greatest(F.least(256 * e, F.lit(float(MOST))), F.lit(-float(MOST))))
    return rows.select("vec_id", F.transform(c, entry).cast("array<long>").alias("x"))


def blocks(batches: Iterator[pa.RecordBatch], dim: int, name: str = "x") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Pieces of batches with their vectors as a matrix of longs, padded with zeros."""
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(at, BLOCK)
            column = batch.column(name)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.diff(column.offsets.to_numpy())
            if (sizes == dim).all():
                yield batch, flat.reshape(-1, dim)
                continue
            rows = np.zeros((len(sizes), dim), dtype=np.int64)
            rows[np.arange(dim)[None, :] < sizes[:, None]] = flat
            yield batch, rows


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S in whole numbers: longs where they fit, Python's integers beyond."""
    if int(np.abs(x).max(initial=0)) * n < MOST and all(abs(s) < MOST for s in sums):
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def _totals(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """How many vectors the fit list has and the exact sum of each dimension: d rows a task, d at the driver."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, np.zeros(dim, dtype=np.int64), np.zeros(dim, dtype=np.int64)
        for _, x in blocks(batches, dim):
            n += len(x)
            # Halves of 32 bits, so that a task's sums of up to 2**31 rows don't overflow.
            low += (x & 0xFFFFFFFF).sum(axis=0)
            high += (x >> 32).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.full(dim, n)), pa.array(low), pa.array(high)], names=["i", "n", "low", "high"])

    parts = fit.mapInArrow(part, "i int, n long, low long, high long").groupBy("i").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("low", "high")])
    rows = {r.i: r for r in parts.collect()}
    return (rows[0].n if rows else 0), [int(rows[i].low) + (int(rows[i].high) << 32) for i in range(dim)] if rows else []


def folded(factors: Iterator[np.ndarray], dim: int) -> np.ndarray:
    """The triangular factor of all rows of some matrices."""
    r = np.zeros((0, dim))
    for f in factors:
        r = np.linalg.qr(np.vstack([r, f]), mode="r")
    return r


def _factor(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the centred fit list: one factor a task, then FAN of them a task until one is left."""
    dim = len(sums)
    schema = "part int, r binary"

    def emit(part: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([r.astype("<f8").tobytes()], pa.binary())], names=["part", "r"])

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = folded((centred(x, n, sums).astype(np.float64) / n for _, x in blocks(batches, dim)), dim)
        if len(r):
            yield emit(TaskContext.get().partitionId(), r)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        # In a fixed order, so that a repeated task gives the same bits.
        rows = rows.sort_values(["part", "r"])
        r = folded((np.frombuffer(b, dtype="<f8").reshape(-1, dim) for b in rows["r"]), dim)
        return pd.DataFrame({"part": [int(rows["part"].iloc[0]) // FAN], "r": [r.tobytes()]})

    parts = stored(fit.mapInArrow(leaf, schema), "factors")
    while parts.count() > FAN:
        parts = stored(parts.groupBy((F.col("part") / FAN).cast("int").alias("lot")).applyInPandas(fold, schema), "factors")
    last = parts.orderBy("part").collect()  # at most FAN factors
    return folded((np.frombuffer(p.r, dtype="<f8").reshape(-1, dim) for p in last), dim)


def tournament(dim: int) -> list[np.ndarray]:
    """Rounds in which each column meets each other once: pairs (2 x many) of a round are disjoint."""
    players = list(range(dim)) + [-1] * (dim % 2)
    rounds = []
    for _ in range(len(players) - 1):
        half = len(players) // 2
        pairs = [(min(p), max(p)) for p in zip(players[:half], reversed(players[half:]), strict=True) if -1 not in p]
        rounds.append(np.array(pairs, dtype=np.int64).reshape(-1, 2).T)
        players = [players[0], players[-1], *players[1:-1]]
    return rounds


def jacobi(r: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of r by falling size, and its right singular vectors as rows.

    Sweeps go on until no two columns are further from orthogonal than rounding makes them.
    """
    dim = r.shape[1]
    scale = np.abs(r).max(initial=0)
    if not scale:
        return np.zeros(dim), np.eye(dim)
    a, v = np.array(r / scale, order="F"), np.eye(dim, order="F")
    rounds = tournament(dim)
    tolerance = np.finfo(float).eps * np.sqrt(dim)
    # Columns shorter than this are rounding of the others; they need not be told apart.
    nothing = (np.finfo(float).eps * dim * np.linalg.norm(a)) ** 2
    for _ in range(sweeps):
        moved = False
        for p, q in rounds:
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            turn = (np.abs(gamma) > tolerance * np.sqrt(alpha * beta)) & (np.maximum(alpha, beta) > nothing)
            if not turn.any():
                continue
            moved = True
            p, q, x, y = p[turn], q[turn], x[:, turn], y[:, turn]
            zeta = (beta[turn] - alpha[turn]) / (2 * gamma[turn])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            a[:, p], a[:, q] = c * x - s * y, s * x + c * y
            x, y = v[:, p], v[:, q]
            v[:, p], v[:, q] = c * x - s * y, s * x + c * y
        if not moved:
            break
    values = np.sqrt((a * a).sum(axis=0)) * scale
    order = np.argsort(-values, kind="stable")
    return values[order], v[:, order].T


def fit_whitening(fit: DataFrame) -> Whitening:
    """The whitening of a list of distinct vectors x (arrays of longs)."""
    dim = fit.agg(F.max(F.size("x")).alias("dim")).first().dim or 0
    n, sums = _totals(fit, dim) if dim else (0, [])
    if not n:
        return Whitening(0, sums, np.zeros(0), np.zeros((0, dim)), np.zeros(0))
    values, components = jacobi(_factor(fit, n, sums))
    most = np.abs(components).argmax(axis=1)
    components = components * np.sign(components[np.arange(dim), most])[:, None]
    squares = (values / values[0]) ** 2 if values[0] else values
    return Whitening(n, sums, values / np.sqrt(n), components, squares / max(squares.sum(), 1e-300))


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """Each x once; vectors that differ only in zeros at their ends are one."""
    dim = vectors.agg(F.max(F.size("x")).alias("dim")).first().dim or 0
    padded = F.when(F.size("x") < dim, F.concat("x", F.array_repeat(F.lit(0).cast("long"), dim - F.size("x")))).otherwise(F.col("x"))
    return vectors.select(padded.alias("x")).distinct()


def _scores(x: np.ndarray, w: Whitening, most: int) -> tuple[np.ndarray, np.ndarray]:
    """n * x - S, and the whitened coordinates of the first components."""
    whole = centred(x, w.n, w.sums)
    k = min(most, w.kept)
    return whole, (whole.astype(np.float64) / w.n) @ (w.components[:k] / w.deviations[:k, None]).T


def _moments(fit: DataFrame, w: Whitening, k: int, mean: np.ndarray | None = None) -> np.ndarray:
    """Means of whitened vectors, or of the products of their deviations from `mean`: few rows a task, summed by Spark."""
    dim = len(w.sums)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k if mean is None else k * k)
        for _, x in blocks(batches, dim):
            y = _scores(x, w, k)[1]
            total += y.sum(axis=0) if mean is None else ((y - mean).T @ (y - mean)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "total"])

    rows = fit.mapInArrow(part, "i int, total double").groupBy("i").agg(F.sum("total").alias("total")).orderBy("i").collect()
    return np.array([r.total for r in rows]) / w.n


def identity_error(fit: DataFrame, w: Whitening, most: int) -> float:
    """How far the covariance of whitened vectors is from the identity, at its worst entry."""
    k = min(most, w.kept)
    mean = _moments(fit, w, k)
    return float(np.abs(_moments(fit, w, k, mean).reshape(k, k) - np.eye(k)).max())


def whiten(embeddings: DataFrame, most: int = 4) -> DataFrame:
    """Rows of WHITENED: for each finite vector its coordinates along the first `most` components."""
    spark = embeddings.sparkSession
    vectors = whole_vectors(embeddings)
    fit = stored(distinct_vectors(vectors), "fit-list")
    w = fit_whitening(fit)
    k, dim = min(most, w.kept), len(w.sums)
    if not k:
        return spark.createDataFrame([], WHITENED)
    error = identity_error(fit, w, most)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in blocks(batches, dim):
            whole, y = _scores(x, w, most)
            far = _squares(whole)
            rows = len(x)
            columns = {
                "vec_id": batch.column("vec_id").take(pa.array(np.arange(rows).repeat(k))),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                "n": pa.array(np.full(rows * k, w.n)),
                "deviation": pa.array([d for d in far for _ in range(k)], pa.string()),
                "whitened": pa.array(y.ravel()),
                "explained": pa.array(np.tile(w.explained[:k], rows)),
                "identity_error": pa.array(np.full(rows * k, error)),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    made = vectors.mapInArrow(score, WHITENED.replace("decimal(38,0)", "string"))
    return made.withColumn("deviation", F.col("deviation").try_cast("decimal(38,0)"))


def _squares(whole: np.ndarray) -> list[str]:
    """The exact sum of squares of each row, in digits."""
    if whole.dtype == np.int64 and whole.size and int(np.abs(whole).max()) < 1 << 27 and whole.shape[1] < 1 << 8:
        return [str(d) for d in (whole * whole).sum(axis=1).tolist()]
    return [str(sum(e * e for e in row)) for row in whole.tolist()]


def whitening_digest(embeddings: DataFrame) -> DataFrame:
    """The query's rows: deviation as a long; null where it does not fit one."""
    return whiten(embeddings).withColumn("deviation", F.col("deviation").try_cast("long"))
