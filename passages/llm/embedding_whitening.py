"""Embedding whitening: directions along which the centred vectors are uncorrelated, and their lengths.

The distinct vectors are reduced to one triangle by QR, block by block within each task and then in a tree of merges, so that no
product of the vectors with themselves is ever formed. Householder reflections make the triangle bidiagonal; the dqds algorithm
finds its singular values to high relative accuracy, and twisted factorisations of the shifted bidiagonal give the direction of each.
What meets in one task, and then in the driver, is a few triangles of width x width numbers: it grows with the width only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.llm.common import ship, written

#: Summaries merged at once, and vectors of one block of the reduction.
FAN, BLOCK = 16, 4096

EPS = float(np.finfo(float).eps)

#: A direction counts only if its singular value exceeds the largest one by more than rounding: this times width times that value.
RANK_TOLERANCE = 1e-13

#: Eigenvalues closer than this share of the larger one: their directions are made orthogonal to each other.
CLOSE = 1e-3


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with sums of each entry; the unit directions (width x components) by falling eigenvalue of their covariance."""

    n: int
    sums: tuple[int, ...]
    directions: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float


def quantised(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """Rows (id, x): x is floor(scale * entry) + offset, entry by entry, as longs.

    Rows whose vector is null or empty go, as do those with an entry that is null, not finite, or too large for the result to be
    a long (|entry| from 2^62 / scale on). Repeated and null ids are rows like any other; other columns are ignored.
    """
    entry = lambda c: c.cast("double") * scale
    usable = F.coalesce(F.forall(vector_col, lambda c: F.coalesce(F.abs(entry(c)) < float(1 << 62), F.lit(False))), F.lit(False)) & (F.size(vector_col) > 0)
    rows = embeddings.select(F.col(id_col).alias("id"), F.when(usable, F.col(vector_col)).alias("v")).where("v IS NOT NULL")
    return rows.select("id", F.transform("v", lambda c: F.floor(entry(c)).cast("long") + F.lit(offset).cast("long")).alias("x"))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exact: in machine integers where these suffice, else in Python's."""
    if x.size and n * max(abs(int(x.max())), abs(int(x.min()))) + max(abs(int(s)) for s in sums) >= 1 << 62:
        return n * x.astype(object) - sums
    return n * x - sums.astype(np.int64)


def _by_task(rows: DataFrame, start: Callable, add: Callable) -> DataFrame:
    """One row (task, part array<double>) for each task that has rows: `add` folds its batches into what `start` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, some = start(), False
        for batch in batches:
            if batch.num_rows:
                part, some = add(part, batch.column(0)), True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([part.ravel().tolist()], pa.list_(pa.float64()))], names=["task", "part"])

    return rows.select("x").mapInArrow(run, "task long, part array<double>")


def _merged(parts: DataFrame, merge: Callable[[np.ndarray, np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray | None:
    """All parts merged: in groups of about FAN by shuffles, until as many are left as the driver merges itself. None without parts."""

    def group(frame: pd.DataFrame) -> pd.DataFrame:
        out = np.array(frame["part"].iloc[0]).reshape(shape)
        for part in frame["part"].iloc[1:]:
            out = merge(out, np.array(part).reshape(shape))
        return pd.DataFrame({"task": [frame["slot"].iloc[0]], "part": [out.ravel().tolist()]})

    parts = written(parts, "parts")
    while (n := parts.count()) > FAN:
        slots = -(-n // FAN)
        parts = written(parts.withColumn("slot", F.col("task") % slots).groupBy("slot").applyInPandas(group, "task long, part array<double>"), "parts")
    left = [np.array(r["part"]).reshape(shape) for r in parts.orderBy("task").collect()]
    for part in left[1:]:
        left[0] = merge(left[0], part)
    return left[0] if left else None


def fit(rows: DataFrame, components: int = 16) -> Whitening | None:
    """The whitening of the distinct vectors x of rows (x); None if there are none.

    Vectors of another width than most distinct ones have (ties: the larger width) take no part. At most `components` directions
    are given, fewer where the vectors span fewer dimensions. A direction's largest entry is positive. Copies of a vector are
    summed up before the shuffle that leaves one of each.
    """
    ship(rows.sparkSession)
    distinct = written(rows.select("x").distinct(), "distinct-vectors")
    width, n, sums = _totals(distinct)
    if not n:
        return None
    distinct = distinct.where(F.size("x") == width)

    def add_rows(triangle: np.ndarray, column: pa.ListArray) -> np.ndarray:
        deviations = centred(_matrix(column, width), n, sums)
        for i in range(0, len(deviations), BLOCK):
            triangle = stack(triangle, (deviations[i : i + BLOCK] / n).astype(float))
        return triangle

    def stack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros((width, width))
        r = np.linalg.qr(np.vstack([a, b]), mode="r")
        out[: len(r)] = r
        return out

    triangle = _merged(_by_task(distinct, lambda: np.zeros((width, width)), add_rows), stack, (width, width))
    squares, directions = singular_directions(triangle, components)
    model = Whitening(n, tuple(int(s) for s in sums), directions, squares / n, float((triangle**2).sum()) / n, 0.0)
    return Whitening(model.n, model.sums, directions, model.eigenvalues, model.trace, _identity_error(distinct, model))


def _totals(distinct: DataFrame) -> tuple[int, int, np.ndarray]:
    """Width of most vectors, how many these are, and the exact sums of their entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            column = batch.column(0)
            widths = column.value_lengths().to_numpy(zero_copy_only=False)
            for width in np.unique(widths):
                x = _matrix(column.filter(pa.array(widths == width)), int(width))
                wide = max(abs(int(x.max())), abs(int(x.min()))) * len(x) >= 1 << 62
                total = (x.astype(object) if wide else x).sum(axis=0).astype(object)
                n, before = found.get(int(width), (0, 0))
                found[int(width)] = (n + len(x), before + total)
        for width, (n, total) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([width], pa.int64()), pa.array([n], pa.int64()), pa.array([[Decimal(int(s)) for s in total]], pa.list_(pa.decimal128(38, 0)))], names=["width", "n", "sums"])

    parts = written(distinct.mapInArrow(run, "width long, n long, sums array<decimal(38,0)>"), "totals")
    top = parts.groupBy("width").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if top is None:
        return 0, 0, np.zeros(0)
    sums = parts.where(F.col("width") == top["width"]).select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s").cast("decimal(38,0)").alias("s")).orderBy("at").collect()
    return top["width"], top["n"], np.array([int(r["s"]) for r in sums], object)


def _identity_error(distinct: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened vectors' covariance minus the identity, over the distinct vectors, centred before multiplying."""
    k = len(model.eigenvalues)
    if not k:
        return 0.0

    def summary(values: np.ndarray) -> np.ndarray:
        """Rows of one matrix: how many, twice over all columns; their mean; the products of what is left."""
        mean = values.mean(axis=0)
        return np.vstack([np.full(k, float(len(values))), mean, (values - mean).T @ (values - mean)])

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, m = a[0, 0], b[0, 0]
        if not n or not m:
            return b if not n else a
        apart = b[1] - a[1]
        return np.vstack([a[:1] + b[:1], a[1] + apart * (m / (n + m)), a[2:] + b[2:] + np.outer(apart, apart) * (n * m / (n + m))])

    width = len(model.sums)
    total = _merged(_by_task(distinct, lambda: np.zeros((k + 2, k)), lambda part, column: merge(part, summary(_project(_matrix(column, width), model)[1]))), merge, (k + 2, k))
    return float(np.abs(total[2:] / total[0, 0] - np.eye(k)).max())


def _project(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """n * x - sums, and the whitened vectors."""
    deviations = centred(x, model.n, np.array(model.sums, object))
    return deviations, (deviations / model.n).astype(float) @ (model.directions / np.sqrt(model.eigenvalues))


def whiten(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """Rows (id, component from 1, n, deviation decimal(38,0), whitened, explained, identity_error) for rows (id, x) and each of the model's components.

    deviation is the exact sum of (n * x - sums)^2. No model, or one without components, gives no rows, and neither do vectors of another width.
    """
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, deviation decimal(38,0), whitened array<double>"
    width = len(model.sums) if model else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            deviations, values = _project(_matrix(batch.column(1), width), model)
            if deviations.size and int(np.abs(deviations).max()) ** 2 * width < 1 << 62:
                squares = pa.array((deviations.astype(np.int64) ** 2).sum(axis=1), pa.int64()).cast(pa.decimal128(38, 0))
            else:
                squares = pa.array([Decimal(int(s)) for s in (deviations.astype(object) ** 2).sum(axis=1)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), squares, pa.array(list(values), pa.list_(pa.float64()))], names=["id", "deviation", "whitened"])

    usable = rows.where(F.size("x") == width) if model is not None and len(model.eigenvalues) else rows.where(F.lit(False))
    found = usable.select("id", "x").mapInArrow(run, schema).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = [float(e) / model.trace for e in model.eigenvalues] if model is not None else []
    explained = F.get(F.array(*map(F.lit, shares)).cast("array<double>"), F.col("at"))
    n, error = (model.n, model.identity_error) if model is not None else (0, 0.0)
    return found.select("id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def singular_directions(triangle: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest squared singular values of a square matrix, falling, and its right singular vectors as columns."""
    norm = float(np.abs(triangle).max(initial=0.0))
    width = len(triangle)
    if not norm:
        return np.zeros(0), np.zeros((width, 0))
    diagonal, above, reflectors = bidiagonal(triangle / norm)
    diagonal = np.where(np.abs(diagonal) < 1e-40, 1e-40, diagonal)  # far below rounding: what follows may divide by it
    values = np.array(dqds((diagonal**2).tolist(), (above**2).tolist()))
    count = min(components, int((values > (RANK_TOLERANCE * width) ** 2 * values[0]).sum()))
    wanted = count
    while wanted and wanted < len(values) and values[wanted - 1] - values[wanted] < CLOSE * values[wanted - 1] and values[wanted] > (RANK_TOLERANCE * width) ** 2 * values[0]:
        wanted += 1  # a group of close values is worked out as a whole
    vectors = orthogonal(diagonal, above, values[:wanted], [twisted(diagonal, above, v) for v in values[:wanted]])[:, :count]
    for at, v in reversed(reflectors):
        vectors[at:] -= np.outer(2 * v, v @ vectors[at:])
    vectors *= np.sign(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], 0))
    return values[:count] * norm**2, vectors


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Householder bidiagonalisation: diagonal, what stands above it, and the reflections from the right (first row, unit vector)."""
    a, n, right = matrix.copy(), len(matrix), []

    def reflector(x: np.ndarray) -> np.ndarray | None:
        v = x.copy()
        v[0] += np.copysign(np.linalg.norm(x), x[0])
        length = np.linalg.norm(v)
        return v / length if length and np.any(x[1:]) else None

    for i in range(n):
        if (v := reflector(a[i:, i])) is not None:
            a[i:, i:] -= np.outer(2 * v, v @ a[i:, i:])
        if i + 2 < n and (v := reflector(a[i, i + 1 :])) is not None:
            a[i:, i + 1 :] -= np.outer(a[i:, i + 1 :] @ v, 2 * v)
            right.append((i + 1, v))
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def dqds(q: list[float], e: list[float]) -> list[float]:
    """Squared singular values, falling, of the bidiagonal matrix whose squared entries are q (diagonal) and e (above it).

    Quotient differences with shifts in their differential form, which subtracts nothing but the shift. A shift that proves too
    large is taken back; one of zero never fails. Parts that negligible e leave apart are worked on by themselves.
    """
    found, work, rounds = [], [(list(q), list(e), 0.0)], 0
    while work:
        q, e, shifted = work.pop()
        if len(q) > 1 and q[-1] > q[0]:
            q, e = q[::-1], e[::-1]  # small values are found at the end
        while len(q) > 1:
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= EPS**2 * (shifted + min(q[i], q[i + 1])) or e[i] <= 1e-300), None)
            if cut is not None:
                work.append((q[cut + 1 :], e[cut + 1 :], shifted))
                q, e = q[: cut + 1], e[:cut]
                continue
            q, e, shift = _dqds_step(q, e, shifted)
            shifted += shift
            rounds += 1
            if rounds > 200 * (len(found) + len(work) + len(q) + 50):
                raise ArithmeticError("the singular values do not converge")
        found += [x + shifted for x in q]
    return sorted(found, reverse=True)


def _dqds_step(q: list[float], e: list[float], shifted: float) -> tuple[list[float], list[float], float]:
    """One transform, with the shift that it turned out to bear."""
    # the smaller eigenvalue of the last two rows is a fair guess, never far below the least one
    a, b, c = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-1] + e[-1], q[-2] * e[-1]
    total, product = a + b, a * b - c
    shift = max(0.0, 2 * product / (total + max(0.0, total * total - 4 * product) ** 0.5)) * (1 - 4 * EPS) if total else 0.0
    for attempt in range(6):
        if attempt == 5 or shift < EPS * EPS * shifted:
            shift = 0.0
        out_q, out_e, d = [], [], q[0] - shift
        for i in range(len(e)):
            if d < 0:
                break
            top = d + e[i]
            ratio = q[i + 1] / top if top else 0.0
            out_q.append(top)
            out_e.append(e[i] * ratio)
            d = d * ratio - shift
        if len(out_q) == len(e) and d >= 0:
            return [*out_q, d], out_e, shift
        # a failure in the last row only tells how much was too much; else less is tried
        shift = max(0.0, (shift + d) * (1 - 4 * EPS)) if len(out_q) == len(e) and attempt < 2 else shift / 4
    raise AssertionError("a shift of zero cannot fail")


def twisted(diagonal: np.ndarray, above: np.ndarray, value: float) -> np.ndarray:
    """The unit eigenvector of B'B for an eigenvalue, B bidiagonal: stationary and progressive factorisations meet where their remainder is least."""
    n, tiny = len(diagonal), 1e-290
    pivots, lower = (diagonal**2).tolist(), (above / diagonal[:-1]).tolist()
    for _ in range(3):
        s, down = [-value], []
        for i in range(n - 1):
            plus = s[i] + pivots[i] or tiny
            down.append(pivots[i] * lower[i] / plus)
            s.append(down[i] * lower[i] * s[i] - value)
        p, up = [0.0] * n, [0.0] * (n - 1)
        p[-1] = pivots[-1] - value
        for i in range(n - 2, -1, -1):
            minus = pivots[i] * lower[i] ** 2 + p[i + 1] or tiny
            ratio = pivots[i] / minus
            up[i] = lower[i] * ratio
            p[i] = p[i + 1] * ratio - value
        remainders = [abs(s[i] + p[i] + value) for i in range(n)]
        twist = min(range(n), key=remainders.__getitem__)
        z = np.zeros(n)
        z[twist] = 1.0
        for i in range(twist - 1, -1, -1):
            z[i] = -down[i] * z[i + 1]
        for i in range(twist, n - 1):
            z[i + 1] = -up[i] * z[i]
        size = float(z @ z)
        step = (s[twist] + p[twist] + value) / size
        if not np.isfinite(step) or abs(step) <= 4 * EPS * value:
            break
        value += step
    return z / np.sqrt(size)


def orthogonal(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray, vectors: list[np.ndarray]) -> np.ndarray:
    """The vectors as columns; those of close values are made orthogonal, and one that says nothing new is sought again by inverse iteration."""
    out = np.array(vectors).T if vectors else np.zeros((len(diagonal), 0))
    matrix, first = None, 0
    for j in range(1, len(values)):
        if values[j - 1] - values[j] > CLOSE * values[j - 1]:
            first = j
        before = out[:, first:j]
        left = lambda z: z - before @ (before.T @ z)  # noqa: B023, E731
        if first == j:
            continue
        z = left(left(out[:, j]))
        if np.linalg.norm(z) < 0.1:
            if matrix is None:
                bi = np.diag(diagonal) + np.diag(above, 1)
                matrix = bi.T @ bi
            z = left(np.random.default_rng(j).standard_normal(len(diagonal)))
            for _ in range(4):
                z = left(np.linalg.solve(matrix - values[j] * (1 + 8 * EPS) * np.eye(len(matrix)), left(z / np.linalg.norm(z))))
            z = left(z / np.linalg.norm(z))
        out[:, j] = z / np.linalg.norm(z)
    return out
