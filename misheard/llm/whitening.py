"""Whitening of vectors by the leading eigenvectors of their covariance, found by FEAST.

Sums, covariance and projection run over all vectors in Spark tasks; what the driver
holds is the covariance and blocks of vectors of its width (d by d numbers, whatever the
number of rows). The eigenvalues are cut into intervals by inertia counts: the signs of
the pivots of a symmetric factorisation of V - s I tell how many lie below s. For each
interval a quadrature over the upper half of a circle around it sums complex shifted
solves (z I - V)^-1 Y, which projects Y onto the interval's eigenvectors; Rayleigh-Ritz
extracts them, and the inertia counts verify that none is missed. Every inertia count
and every shifted solve is a row of its own for the tasks.

Vectors that are null or hold null or non-finite entries are left out; so are vectors of
another width than most rows have (of ties the wider), as they share no covariance.
Entries are scaled to whole numbers, those beyond 2^62 counted as 2^62. Directions whose
eigenvalue is below 1e-10 of the largest hold nothing to whiten and give no component:
equal vectors, a single one, and an empty table give no rows. Repeated rows and ids count
as they stand, null ids are kept, other columns are not looked at.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

# --- fixed values: the scale of the whole numbers ----------------------------
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
LEAST_SHARE = 1e-10
INTERVAL = 12              # eigenvalues in an interval, unless they lie too close to part
NODES = 8                  # of the quadrature
SECTIONS = 48              # shifts counted at once
_ROUNDS = 8
_LIMIT = 1 << 62
SEED = 42


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors of doubles without null or non-finite entries, of one width."""
    v = F.col(vector_col).cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("v").isNotNull() & F.forall("v", fine))
    widths = rows.where(F.size("v") > 0).groupBy(F.size("v").alias("d")).count()
    most = widths.orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (most["d"] if most else -1))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def whole(batch: np.ndarray) -> np.ndarray:
    """floor(64 c) + 1000000 as whole numbers."""
    return np.clip(np.floor(SCALE * batch), -float(_LIMIT), float(_LIMIT)).astype(np.int64) + SHIFT


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = whole(_matrix(batch.column(0)))
                high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
                yield pa.RecordBatch.from_pydict({
                    "d": np.arange(x.shape[1]), "n": np.full(x.shape[1], len(x)), "high": high, "low": low,
                })

    parts = rows.select("v").mapInArrow(run, "d long, n long, high long, low long")
    exact = lambda c: F.sum(F.col(c).cast("decimal(28,0)")).alias(c)
    found = parts.groupBy("d").agg(F.sum("n").alias("n"), exact("high"), exact("low")).collect()     # one row a dimension
    totals = {r["d"]: (int(r["high"]) << 32) + int(r["low"]) for r in found}
    return (found[0]["n"] if found else 0), [totals[k] for k in sorted(totals)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n: the whole part of the mean goes first, exactly."""
    down = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - down) - rest


def _covariance(rows: DataFrame, n: int, width: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of the products of `of` a batch of vectors, over n. Each task adds up its own
    matrix; the rows of the matrices are summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                c = of(_matrix(batch.column(0)))
                total += c.T @ c
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_pydict({"i": i, "j": j, "s": total[i, j]})

    parts = rows.select("v").mapInArrow(run, "i long, j long, s double")
    out = np.zeros((width, width))
    for r in parts.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():     # width * width / 2 rows
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["s"] / n
    return out


def _means(rows: DataFrame, n: int, width: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += of(_matrix(batch.column(0))).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"i": np.arange(width), "s": total})

    parts = rows.select("v").mapInArrow(run, "i long, s double")
    found = {r["i"]: r["s"] / n for r in parts.groupBy("i").agg(F.sum("s").alias("s")).collect()}
    return np.array([found[k] for k in range(width)])


def negatives(a: np.ndarray) -> int:
    """Negative eigenvalues of a symmetric matrix: the inertia of its factorisation with
    pivots of one or two rows, the larger ones first (Bunch and Kaufman)."""
    a, below, alpha = a.copy(), 0, (1 + 17**0.5) / 8
    while len(a):
        n = len(a)
        first = np.abs(a[1:, 0])
        most = first.max() if n > 1 else 0.0
        size = 1
        if n > 1 and abs(a[0, 0]) < alpha * most:
            r = int(first.argmax()) + 1
            row = np.abs(a[r]).copy()
            row[r] = 0
            other = row.max()
            if abs(a[0, 0]) * other < alpha * most * most:
                to = 0 if abs(a[r, r]) >= alpha * other else 1
                size = 1 + to
                a[[to, r]] = a[[r, to]]
                a[:, [to, r]] = a[:, [r, to]]
        pivot, side, rest = a[:size, :size], a[size:, :size], a[size:, size:]
        if size == 1:
            below += bool(pivot[0, 0] < 0)
            if pivot[0, 0] == 0:
                a = rest
                continue
            a = rest - np.outer(side[:, 0], side[:, 0]) / pivot[0, 0]
        else:
            below += 1                                   # such a pivot has one of either sign
            a = rest - side @ np.linalg.solve(pivot, side.T)
    return below


def _tasks(spark: SparkSession, n: int, run: Callable[[int], np.ndarray]) -> list[np.ndarray]:
    """run(k) for k below n, each in a task of its own; the results in order."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                out = np.ascontiguousarray(run(k), np.float64)
                yield pa.RecordBatch.from_pydict({"k": [k], "v": [out.tobytes()]})

    rows = spark.range(0, n, 1, n).mapInArrow(step, "k long, v binary").collect()
    return [np.frombuffer(r["v"]) for r in sorted(rows, key=lambda r: r["k"])]


def _above(spark: SparkSession, v: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie above each shift."""
    eye = np.eye(len(v))
    below = _tasks(spark, len(shifts), lambda k: np.array([negatives(v - shifts[k] * eye)]))
    return len(v) - np.array([int(b[0]) for b in below])


def intervals(spark: SparkSession, v: np.ndarray, most: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues) from the top down, until `most` are held or the least
    share is reached; few in each, as far as they can be parted."""
    top = float(np.abs(v).sum(axis=1).max()) * (1 + 1e-9)
    if not top > 0:
        return []
    bottom = LEAST_SHARE * float(np.abs(np.diag(v)).max())
    shifts = np.geomspace(bottom, top, SECTIONS)
    counts = dict(zip(shifts.tolist(), _above(spark, v, shifts).tolist()))
    counts[top] = 0
    for _ in range(_ROUNDS):
        order = sorted(counts, reverse=True)
        crowded = [
            (lo, hi) for hi, lo in zip(order, order[1:])
            if counts[hi] < most and counts[lo] - counts[hi] > INTERVAL and hi - lo > 1e-9 * top
        ]
        if not crowded:
            break
        each = max(2, SECTIONS // len(crowded))
        more = np.concatenate([np.linspace(lo, hi, each + 2)[1:-1] for lo, hi in crowded])
        counts.update(zip(more.tolist(), _above(spark, v, more).tolist()))
    out, high = [], top
    order = sorted(counts, reverse=True)
    for at, low in enumerate(order):
        held = counts[low] - counts[high]
        last = at + 1 == len(order)
        # an interval ends before the next shift would crowd it, or where enough are held
        if held and (last or counts[low] >= most or counts[order[at + 1]] - counts[high] > INTERVAL):
            out.append((low, high, held))
            high = low
            if counts[low] >= most:
                break
        elif not held:
            high = low
    return out


def _filtered(spark: SparkSession, v: np.ndarray, parts: list[tuple[float, float, np.ndarray]]) -> list[np.ndarray]:
    """The projections of each block Y by the quadrature around its interval."""
    x, w = np.polynomial.legendre.leggauss(NODES)
    eye = np.eye(len(v))

    def solve(k: int) -> np.ndarray:
        low, high, y = parts[k // NODES]
        angle = -np.pi / 2 * (x[k % NODES] - 1)
        radius = (high - low) / 2
        turn = radius * np.exp(1j * angle)
        solved = np.linalg.solve(((low + high) / 2 + turn) * eye - v, y.astype(complex))
        return w[k % NODES] / 2 * (turn * solved).real

    terms = _tasks(spark, NODES * len(parts), solve)
    return [
        sum(terms[p * NODES : (p + 1) * NODES]).reshape(parts[p][2].shape) for p in range(len(parts))
    ]


def _ritz(v: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    q, _ = np.linalg.qr(block)
    h = q.T @ v @ q
    e, u = np.linalg.eigh((h + h.T) / 2)
    return e, q @ u


def eigenpairs(spark: SparkSession, v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The `most` largest eigenvalues, falling, and unit eigenvectors as columns, the
    largest entry of each positive."""
    wanted = intervals(spark, v, most)
    if not wanted:
        return np.empty(0), np.empty((len(v), 0))
    draw = np.random.default_rng(SEED)
    size = float(np.abs(v).sum(axis=1).max())
    open_ = {k: draw.standard_normal((len(v), min(len(v), held + held // 2 + 4))) for k, (_, _, held) in enumerate(wanted)}
    done: dict[int, np.ndarray] = {}
    for turn in range(40):
        if not open_:
            break
        keys = sorted(open_)
        blocks = _filtered(spark, v, [(*wanted[k][:2], open_[k]) for k in keys])
        for k, block in zip(keys, blocks):
            low, high, held = wanted[k]
            e, u = _ritz(v, block)
            inside = (e > low) & (e <= high)
            off = np.abs(v @ u[:, inside] - u[:, inside] * e[inside]).max(initial=0.0)
            if inside.sum() == held and off <= 1e-13 * size:
                done[k] = u[:, inside]
                del open_[k]
            elif inside.sum() == held and turn < 12:
                open_[k] = u
            else:                                        # a value at the edge, or too small a block
                more = min(len(v), u.shape[1] + max(4, u.shape[1] // 2))
                fresh = draw.standard_normal((len(v), more - u.shape[1]))
                open_[k] = np.hstack([u, fresh])
                if off <= 1e-12 * size and inside.sum() == held:
                    done[k] = u[:, inside]
                    del open_[k]
    if open_:
        raise RuntimeError(f"eigenvalues not all found in intervals {[wanted[k] for k in sorted(open_)]}")
    e, u = _ritz(v, np.hstack([done[k] for k in sorted(done)]))
    order = np.argsort(-e, kind="stable")[:most]
    e, u = e[order], u[:, order]
    sign = np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])
    return e, u * sign


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n x - S)^2 per row, exact; null where a long cannot hold it."""
    rough = ((centred(x, n, sums) * n) ** 2).sum(axis=1)
    largest = max([int(np.abs(x).max(initial=0)) * n, *map(abs, sums)])
    quick = rough < 8e18 if largest < _LIMIT else np.zeros(len(x), bool)
    out: list[int | None] = [None] * len(x)
    if quick.any():
        y = x[quick] * n - np.array(sums, np.int64)
        for k, d in zip(np.flatnonzero(quick).tolist(), (y * y).sum(axis=1).tolist()):
            out[k] = d
    for k in np.flatnonzero(~quick & (rough < 1e19)).tolist():
        exact = sum((n * a - s) ** 2 for a, s in zip(x[k].tolist(), sums))
        out[k] = exact if exact < 1 << 63 else None
    return out


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """One row per vector and component: id, component, n, deviation, whitened,
    explained, identity_error."""
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = (
        f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    rows = valid(vectors, id_col, vector_col)
    n, sums = _sums(rows)
    if not n:
        return spark.createDataFrame([], schema)
    at = lambda m: centred(whole(m), n, sums)
    v = _covariance(rows, n, len(sums), at)
    e, u = eigenpairs(spark, v, min(components, len(sums)))
    if not len(e):
        return spark.createDataFrame([], schema)
    base = u / np.sqrt(e)
    white = lambda m: at(m) @ base
    mean = _means(rows, n, len(e), white)
    error = float(np.abs(_covariance(rows, n, len(e), lambda m: white(m) - mean) - np.eye(len(e))).max())
    explained = e / np.trace(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(e)
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch.column(1))
            each = np.repeat(np.arange(len(m)), k)
            made = [
                batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(m))),
                pa.array(np.full(len(each), n)), pa.array(_deviation(whole(m), n, sums), pa.int64()).take(pa.array(each)),
                pa.array(white(m).ravel()), pa.array(np.tile(explained, len(m))), pa.array(np.full(len(each), error)),
            ]
            yield pa.RecordBatch.from_arrays(made, schema=pa.schema(zip(
                (id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"), (x.type for x in made)
            )))

    return rows.select("id", "v").mapInArrow(run, schema)
