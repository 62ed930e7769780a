"""Embedding whitening: leading principal components without ever forming a covariance matrix.

A block Lanczos method asks for one thing only, the product of the covariance with a few vectors. That is a
distributed pass: every task centres its rows, multiplies them with the block and with themselves again, and
emits one dimensions x block array of partial sums. The driver holds the basis (dimensions x at most
MOST_BLOCKS blocks), whatever the number of rows.

The fit counts each distinct vector once. Their sums are whole numbers, so the mean is exact up to one
rounding of each centred entry, and so is the trace, which comes from the same whole-number deviations that
the result reports.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgspark.llm.scratch import Scratch, lean

#: A Ritz pair counts as converged when its residual is below this share of the largest eigenvalue.
TOLERANCE = 1e-14
#: What is taken after FEW_RESTARTS, when rounding leaves no more.
ACCEPTED = 1e-12
#: An eigenvalue below this share of the largest is 0: the covariance has no such component.
RANK = 1e-12
#: What is left of a block below this share of its size is a breakdown: new random vectors take its place.
BREAKDOWN = 1e-10
#: Blocks in the basis at most; beyond, the method restarts from the best Ritz vectors.
MOST_BLOCKS, FEW_RESTARTS, MOST_RESTARTS = 40, 10, 200
LONG = (1 << 63) - 1


# ---- vectors


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, x): vectors without nulls and non-finite entries, as floor(scale * entry)."""
    v = F.col(f"`{vector_col}`")
    fine = v.isNotNull() & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    kept = df.select(F.col(f"`{id_col}`").alias("id"), F.when(fine, v).alias("v")).filter("v IS NOT NULL")
    return kept.select("id", F.transform("v", lambda e: F.floor(e.cast("double") * scale)).alias("x"))


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _times(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: int64 where that holds it, else Python's whole numbers."""
    largest = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if n * largest + max(map(abs, sums), default=0) > LONG // 2:
        return x.astype(object) * n - np.array(sums, object)
    return x * n - np.array(sums, np.int64)


def _deviations(t: np.ndarray) -> np.ndarray:
    """Sums of squares of the rows of _times, exact."""
    if t.dtype == object or t.shape[1] * int(np.abs(t).max(initial=0)) ** 2 > LONG:
        t = t.astype(object)
    return (t * t).sum(1)


def _centred(t: np.ndarray, n: int) -> np.ndarray:
    return (t / n).astype(np.float64)


# ---- distributed passes


def _added(fit: DataFrame, of, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all rows of what `of` makes of a batch (an array of shape): summed by the tasks, then by
    Spark; as many numbers as the shape has come to the driver."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += of(_matrix(batch.column("x")))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["p", "s"])

    rows = fit.select("x").mapInArrow(lean(run), "p int, s double").groupBy("p").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(shape[0] * shape[1])
    for p, s in rows:
        out[p] = s
    return out.reshape(shape)


def _product(fit: DataFrame, n: int, sums: list[int], block: np.ndarray) -> np.ndarray:
    """The covariance times a block: X'(X block) / n over centred rows X."""

    def of(x):
        c = _centred(_times(x, n, sums), n)
        return c.T @ (c @ block)

    return _added(fit, of, block.shape) / n


def _moments(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """(rows, sums of each dimension), exact."""
    sums = fit.select(F.posexplode("x").alias("p", "e")).groupBy("p").agg(F.sum(F.col("e").cast("decimal(38,0)")).alias("s")).collect()
    out = [0] * d
    for p, s in sums:
        out[p] = int(s)
    return fit.count(), out


def _trace(fit: DataFrame, n: int, sums: list[int]) -> float:
    """The covariance's trace: the sum of all deviations, exact, over n^3."""

    def run(batches):
        import pyarrow as pa

        total = sum(sum(map(int, _deviations(_times(_matrix(b.column("x")), n, sums)).tolist())) for b in batches if b.num_rows)
        # in parts of 15 digits, as a decimal of Spark ends at 38
        parts = []
        while total:
            total, low = divmod(total, 10**15)
            parts.append(low)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(parts, pa.int64())], ["p", "s"])

    rows = fit.select("x").mapInArrow(lean(run), "p int, s long").groupBy("p").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    return sum(int(s) * 10 ** (15 * p) for p, s in rows) / n**3


# ---- block Lanczos


def _orthonormal(block: np.ndarray, basis: np.ndarray, size: float, rng) -> np.ndarray:
    """An orthonormal block that is orthogonal to the basis: full reorthogonalisation, twice; what a vector has
    lost all but rounding of is a breakdown, and a random direction takes its place. Fewer columns where the
    space has no more room."""
    room = len(block) - basis.shape[1]
    out = np.empty((len(block), 0))
    for v in block.T[:room]:
        for _ in range(10):
            before = max(np.linalg.norm(v), 0.0)
            for _ in range(2):
                v = v - basis @ (basis.T @ v)
                v = v - out @ (out.T @ v)
            left = np.linalg.norm(v)
            if left > BREAKDOWN * max(size, before) and left > 0:
                v = v / left
                v = v - basis @ (basis.T @ v) - out @ (out.T @ v)
                out = np.column_stack([out, v / np.linalg.norm(v)])
                break
            v, size = rng.standard_normal(len(block)), 0.0
    return out


def block_lanczos(product, d: int, wanted: int, tolerance: float = TOLERANCE, most_blocks: int = MOST_BLOCKS, seed: int = 1):
    """(eigenvalues falling, eigenvectors as columns, passes) of the `wanted` largest of a symmetric operator,
    known by its product with a d x b block only."""
    rng = np.random.default_rng(seed)
    width = min(d, wanted + 2)  # more than wanted, so that equal eigenvalues and close ones are separated
    basis, image = np.empty((d, 0)), np.empty((d, 0))
    block, size = rng.standard_normal((d, width)), 0.0
    passes = restarts = 0
    while True:
        block = _orthonormal(block, basis, size, rng)
        if block.shape[1]:
            basis, image = np.column_stack([basis, block]), np.column_stack([image, product(block)])
            passes += 1
        small = basis.T @ image
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        vectors = basis @ turns
        left = image @ turns - vectors * values
        worst = np.linalg.norm(left[:, :wanted], axis=0).max(initial=0)
        size = max(abs(values[0]), abs(values[-1])) if len(values) else 0.0
        if basis.shape[1] >= d or (worst <= tolerance * size and basis.shape[1] > width):
            return values[:wanted], vectors[:, :wanted], passes
        block = left[:, :width]
        if basis.shape[1] + width > most_blocks * width:
            restarts += 1
            if worst <= ACCEPTED * size and restarts > FEW_RESTARTS:  # rounding of the passes keeps it from more
                return values[:wanted], vectors[:, :wanted], passes
            if restarts > MOST_RESTARTS:
                raise ArithmeticError(f"no convergence: a residual of {worst} at eigenvalues up to {size}")
            keep = 2 * width
            basis, image = vectors[:, :keep], image @ turns[:, :keep]


# ---- the operator


class Whitening:
    """A fitted whitening: n, sums, values and components, trace, identity_error."""

    def __init__(self, n, sums, values, vectors, trace, passes):
        self.n, self.sums, self.values, self.vectors, self.trace, self.passes = n, sums, values, vectors, trace, passes
        self.identity_error = 0.0

    def __call__(self, x: np.ndarray):
        """(deviations, whitened coordinates) of rows of whole numbers."""
        t = _times(x, self.n, self.sums)
        return _deviations(t), _centred(t, self.n) @ (self.vectors / np.sqrt(self.values))


def fit_whitening(vectors: DataFrame, components: int, d: int, scratch: Scratch) -> Whitening | None:
    """vectors: x arrays of d entries. None without a component of positive variance."""
    # partial distinct before the shuffle, so many copies of one vector are one row a task
    fit = scratch.cut(vectors.select("x").distinct())
    n, sums = _moments(fit, d)
    if not n or not d:
        return None
    values, basis, passes = block_lanczos(lambda b: _product(fit, n, sums, b), d, min(components, d))
    positive = int((values > max(RANK * max(values[0], 0), 0)).sum()) if len(values) and n > 1 else 0
    if not positive:
        return None
    values, basis = values[:positive], basis[:, :positive]
    basis = basis * np.where(basis[np.abs(basis).argmax(0), np.arange(positive)] < 0, -1.0, 1.0)
    w = Whitening(n, sums, values, basis, _trace(fit, n, sums), passes)

    def squares(x):
        y = w(x)[1]
        return np.vstack([y.T @ y, y.sum(0)])

    got = _added(fit, squares, (positive + 1, positive)) / n
    w.identity_error = float(np.abs(got[:-1] - np.outer(got[-1], got[-1]) - np.eye(positive)).max())
    scratch.drop(fit)
    return w


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """(<id_col>, component, n, deviation, whitened, explained, identity_error) of every remaining row and component.

    Rows whose vector is null or holds null or non-finite entries are dropped. Vectors shorter than the longest
    count as 0 at their end. Components without variance (below RANK of the largest) do not exist: of fewer
    dimensions or distinct vectors there are fewer, of one vector or an empty table no rows at all. Repeated
    rows and null ids stay; copies count once in the fit. A deviation that no long can hold is null. Other
    columns are not looked at. Signs: a component's largest entry is positive."""
    scratch = Scratch(df.sparkSession, "whitening")
    rows = whole_vectors(df, id_col, vector_col, scale)
    d = rows.agg(F.max(F.size("x"))).first()[0] or 0
    rows = rows.select("id", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x"))).alias("x"))
    w = fit_whitening(rows, components, d, scratch)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if w is None:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)

    def run(batches):
        import pyarrow as pa

        k = len(w.values)
        for batch in batches:
            if not batch.num_rows:
                continue
            deviation, y = w(_matrix(batch.column("x")))
            deviation = pa.array([v if v <= LONG else None for v in deviation.tolist()], pa.int64())
            each = np.repeat(np.arange(batch.num_rows), k)
            fixed = lambda v, t: pa.array(np.full(len(each), v), t)
            cols = [batch.column("id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)), fixed(w.n, pa.int64()), deviation.take(pa.array(each))]
            cols += [pa.array(y.ravel()), pa.array(np.tile(w.values / w.trace, batch.num_rows)), fixed(w.identity_error, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(lean(run), schema).withColumnRenamed("id", id_col)
