"""Whitening of vectors by a blockwise QR reduction and one-sided Jacobi rotations.

Entries become whole numbers (``floor(scale * c) + shift``), so counts and sums are exact.
Each task centres its rows, ``(n * x - S) / n`` with an exact numerator, and keeps only the
triangular factor R of all its rows so far: blocks are stacked under it and factored
again. The tasks' factors are merged in groups, in rounds, until one is left; it has
the singular values of all centred rows and is as large as the vectors are long, however
many there are. The driver rotates R's columns, pair by pair, until all are orthogonal:
their lengths are the singular values, the accumulated rotations the components. No
covariance is formed, so small deviations keep their digits. The whitened vectors'
covariance is then measured over all rows, task by task around each task's own mean.

Defined cases: vectors that are null or hold null or non-finite entries are dropped. Null
ids stay. Vectors of different lengths are whitened apart, each with those of its own
length (at most ``LENGTHS`` lengths; more fail); empty vectors have no component and give
no row. Repeated rows count each. A direction in which the rows don't differ, to double
precision, has no whitened value and is left out, so one vector alone, or equal vectors,
have no component. Equal eigenvalues: any basis of their space, the same for all rows.
Empty tables give no row. Entries that leave 2**52 when scaled, and sums or deviations
that leave 64 bits, fail. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import Scratch

#: Rows that are factored at a time; states that one task, or the driver, merges; lengths of vectors.
BLOCK, FAN, LENGTHS = 4096, 64, 16
EPS = float(np.finfo(float).eps)


@dataclass(frozen=True)
class Whitening:
    """What the vectors of one length have shown: count, sums, components (columns), their eigenvalues and shares."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray


# --- rows -------------------------------------------------------------------


def whole_numbers(column: pa.Array, scale: int, shift: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, x) for each length of the vectors that are whole, empty ones left out."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    begins = np.append(0, np.cumsum(lengths))[:-1]
    for length in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == length)
        values = flat[begins[rows][:, None] + np.arange(length)]
        good = np.isfinite(values).all(1)
        if good.any():
            scaled = np.floor(scale * values[good])
            if np.abs(scaled).max() > 2.0**52:
                raise OverflowError("an entry of a vector is too large for whole numbers")
            yield length, rows[good], scaled.astype(np.int64) + shift


def numerators(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact."""
    if float(n) * float(np.abs(x).max(initial=0)) + float(np.abs(sums).max(initial=0)) > 9.2e18:
        raise OverflowError("a deviation leaves 64 bits")
    return n * x - sums


# --- states that merge ------------------------------------------------------


def _gather(df: DataFrame, scratch: Scratch, name: str, add: Callable, merge: Callable, scale: int, shift: int) -> dict[int, np.ndarray]:
    """Folds all vectors to one state for each length: tasks fold their rows, then groups of ``FAN`` states, in rounds."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        states: dict[int, np.ndarray] = {}
        for batch in batches:
            for length, _, x in whole_numbers(batch.column(0), scale, shift):
                for at in range(0, len(x), BLOCK):
                    states[length] = add(states.get(length), x[at : at + BLOCK])
                if len(states) > LENGTHS:
                    raise ValueError(f"vectors of more than {LENGTHS} lengths")
        at = TaskContext.get().partitionId()
        for length, state in states.items():
            yield pa.RecordBatch.from_pydict({"length": [length], "at": pa.array([at], pa.int64()), "state": [state.tobytes()]})

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for length, at, raw in zip(*(c.to_pylist() for c in batch.columns)):
                key, state = (length, at), np.frombuffer(raw)
                states[key] = merge(length, states[key], state) if key in states else state
        for (length, at), state in states.items():
            yield pa.RecordBatch.from_pydict({"length": [length], "at": pa.array([at], pa.int64()), "state": [state.tobytes()]})

    kinds = "length long, at long, state binary"
    now, k = scratch.write(df.mapInArrow(fold, kinds), f"{name}_0"), 0
    while now.groupBy("length").count().where(F.col("count") > FAN).head(1):
        k += 1
        grouped = now.withColumn("at", F.floor(F.col("at") / FAN)).repartition("length", "at").sortWithinPartitions("length", "at")
        now = scratch.write(grouped.mapInArrow(unite, kinds), f"{name}_{k}")
    found: dict[int, np.ndarray] = {}
    # at most FAN states for each of at most LENGTHS lengths
    for length, _, raw in now.orderBy("length", "at").collect():
        state = np.frombuffer(raw)
        found[length] = merge(length, found[length], state) if length in found else state
    if len(found) > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} lengths")
    return found


def _as_sums(state: np.ndarray) -> np.ndarray:
    return state.view(np.int64)


def _plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if float(np.abs(a.astype(float) + b).max()) > 9.2e18:
        raise OverflowError("a sum of vectors leaves 64 bits")
    return a + b


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of the rows' QR factors, square: rows of zeros where there are few."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))]) if len(r) < rows.shape[1] else r


def spread(rows: np.ndarray) -> np.ndarray:
    """(count, means, sums of products around the means) as one array."""
    mean = rows.mean(0)
    centred = rows - mean
    return np.concatenate([[len(rows)], mean, (centred.T @ centred).ravel()])


def joined_spread(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    k = int((np.sqrt(4 * len(a) - 3) - 1) / 2 + 0.5)  # 1 + k + k * k numbers
    n, apart = a[0] + b[0], b[1 : k + 1] - a[1 : k + 1]
    products = a[k + 1 :] + b[k + 1 :] + (np.outer(apart, apart) * (a[0] * b[0] / n)).ravel()
    return np.concatenate([[n], a[1 : k + 1] + apart * (b[0] / n), products])


# --- rotations --------------------------------------------------------------


def _rounds(d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of d columns, as rounds of pairs that share no column."""
    ring = list(range(d + d % 2))
    half = len(ring) // 2
    for _ in range(len(ring) - 1):
        pairs = [(a, b) for a, b in zip(ring[:half], reversed(ring[half:])) if a < d and b < d]
        yield np.array([min(p) for p in pairs], int), np.array([max(p) for p in pairs], int)
        ring = [ring[0], ring[-1], *ring[1:-1]]


def one_sided_jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as columns) of R, the largest first."""
    d = r.shape[1]
    a, v = r.T.copy(), np.eye(d)  # rows are R's columns, and the components
    limit = EPS * np.sqrt(d)
    for _ in range(sweeps):
        turned = False
        for p, q in _rounds(d):
            ap, aq = a[p], a[q]
            alpha, beta, gamma = (ap * ap).sum(1), (aq * aq).sum(1), (ap * aq).sum(1)
            some = np.abs(gamma) > limit * np.sqrt(alpha) * np.sqrt(beta)
            if not some.any():
                continue
            turned = True
            p, q = p[some], q[some]
            zeta = (beta[some] - alpha[some]) / (2 * gamma[some])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = (1 / np.hypot(1.0, t))[:, None]
            s = c * t[:, None]
            for m in (a, v):
                mp, mq = m[p], m[q]
                m[p], m[q] = c * mp - s * mq, s * mp + c * mq
        if not turned:
            sizes = np.sqrt((a * a).sum(1))
            order = np.argsort(-sizes, kind="stable")
            return sizes[order], v[order].T
    raise RuntimeError("the rotations did not settle")


# --- the operator -----------------------------------------------------------


def fit(df: DataFrame, components: int = 8, vec_col: str = "embedding", scale: int = 1024, shift: int = 100_000) -> dict[int, Whitening]:
    """A whitening for each length of the vectors, with at most so many components: two scans of the vectors."""
    vectors, scratch = df.select(F.col(vec_col).cast("array<double>").alias("v")), Scratch(df.sparkSession, "whitening")

    def count(state: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        here = np.append(len(x), x.sum(0))
        return here.view(float) if state is None else _plus(_as_sums(state), here).view(float)

    totals = _gather(vectors, scratch, "sums", count, lambda length, a, b: _plus(_as_sums(a), _as_sums(b)).view(float), scale, shift)
    moments = {length: (int(_as_sums(s)[0]), _as_sums(s)[1:].copy()) for length, s in totals.items()}

    def factor(state: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        n, sums = moments[x.shape[1]]
        rows = numerators(x, n, sums) / n
        return triangle(rows if state is None else np.vstack([state.reshape(x.shape[1], -1), rows])).ravel()

    factors = _gather(vectors, scratch, "factors", factor, lambda d, a, b: triangle(np.vstack([a.reshape(d, d), b.reshape(d, d)])).ravel(), scale, shift)
    found = {}
    for length, state in factors.items():
        n, sums = moments[length]
        r = state.reshape(length, length)
        sizes, turned = one_sided_jacobi(r)
        k = min(components, int((sizes > sizes[0] * 8 * length * EPS).sum()))
        whole = (r * r).sum()
        found[length] = Whitening(n, sums, turned[:, :k].copy(), sizes[:k] ** 2 / n, sizes[:k] ** 2 / whole if whole else sizes[:k])
    return found


def projected(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """(n * x - S, whitened rows)."""
    above = numerators(x, model.n, model.sums)
    return above, (above / model.n) @ model.components / np.sqrt(model.eigenvalues)


def identity_errors(df: DataFrame, model: dict[int, Whitening], vec_col: str = "embedding", scale: int = 1024, shift: int = 100_000) -> dict[int, float]:
    """For each length, the largest absolute entry of the whitened vectors' covariance minus the identity: one scan."""

    def add(state: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        here = spread(projected(x, model[x.shape[1]])[1])
        return here if state is None else joined_spread(state, here)

    vectors, scratch = df.select(F.col(vec_col).cast("array<double>").alias("v")), Scratch(df.sparkSession, "whitening")
    states = _gather(vectors, scratch, "spread", add, lambda _, a, b: joined_spread(a, b), scale, shift)
    found = {}
    for length, state in states.items():
        k = model[length].components.shape[1]
        error = state[k + 1 :].reshape(k, k) / state[0] - np.eye(k)
        found[length] = float(np.abs(error).max(initial=0.0))
    return found


def whiten(
    df: DataFrame,
    model: dict[int, Whitening],
    errors: dict[int, float] | None = None,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    scale: int = 1024,
    shift: int = 100_000,
) -> DataFrame:
    """(id, n, deviation, whitened, explained, identity_error) for each whole vector: ``whitened`` and ``explained`` are
    lists, one entry a component. Deviation: the exact sum of (n * x - S)**2. Vectors of a length that was not fitted fail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, rows, x in whole_numbers(batch.column(1), scale, shift):
                one = model[length]
                above, white = projected(x, one)
                if (above.astype(float) ** 2).sum(1).max() > 9.2e18:
                    raise OverflowError("a deviation leaves 64 bits")
                k, m = white.shape[1], len(rows)
                ends = pa.array(np.arange(0, m * k + 1, k, dtype=np.int32) if k else np.zeros(m + 1, np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (white.ravel(), np.tile(one.explained, m))]
                error = pa.array(np.full(m, errors[length]) if errors else [None] * m, pa.float64())
                columns = [batch.column(0).take(pa.array(rows)), pa.array(np.full(m, one.n)), pa.array((above * above).sum(1)), *lists, error]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n", "deviation", "whitened", "explained", "identity_error"])

    lists = [StructField(c, ArrayType(DoubleType())) for c in ("whitened", "explained")]
    kinds = StructType([df.schema[id_col], StructField("n", LongType()), StructField("deviation", LongType()), *lists, StructField("identity_error", DoubleType())])
    return df.select(id_col, F.col(vec_col).cast("array<double>").alias("_v")).mapInArrow(run, kinds)
