"""Centroid clustering with exact integer distances, by exponion search.

A vector that is known to lie within `upper` of its centroid and at least `lower` from every other one needs
no distances while upper < lower, or while upper is less than half the way from its centroid to the nearest
other one. Where neither holds, only centroids inside a ball around its current centroid can be nearest or
second nearest: those within 2 * upper + (distance of the nearest other centroid), the first few of a list of
centroids sorted by their distance from it. The ball is closed and the bounds are rounded outwards, so ties
are seen and go to the smaller number: results equal a full scan's, whatever is skipped.

Vectors stay where they are: a round is a narrow pass over a table with each vector's centroid and bounds,
and only partial sums (centroids x dimensions numbers a task) are shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgspark.llm.scratch import Scratch, lean

#: Whole numbers beyond this could make a squared distance of 64 components leave a long.
LARGEST = 1 << 27
#: Bounds are widened by this share, more than rounding can add.
SLACK = 1e-12
STATE = "id long, x array<long>, cluster int, distance long, upper double, lower double"


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, dim: int, scale: int) -> DataFrame:
    """(id, x): vectors of exactly dim components, none null or not finite, as floor(scale * component)."""
    v = F.col(f"`{vector_col}`")
    fine = v.isNotNull() & (F.size(v) == dim) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    # the case keeps floor() away from what does not fit
    kept = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.when(fine, v).alias("v")).filter("v IS NOT NULL")
    return kept.select("id", F.transform("v", lambda e: F.floor(e.cast("double") * scale)).alias("x"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows x centroids, of int64 arrays."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)), 1)
    if x.shape[1] * largest * largest < 1 << 52:  # doubles hold every sum exactly
        dot = (x.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    else:
        dot = x @ c.T
    return (x * x).sum(1)[:, None] - 2 * dot + (c * c).sum(1)[None, :]


class Around:
    """The other centroids of each centroid, by distance."""

    def __init__(self, c: np.ndarray):
        d = squared(c, c)
        np.fill_diagonal(d, -1)
        self.order = np.argsort(d, axis=1, kind="stable")[:, 1:]
        self.far = np.sqrt(np.take_along_axis(d, self.order, 1).astype(np.float64))
        self.nearest = self.far[:, 0] if len(c) > 1 else np.full(1, np.inf)


def exponion(x, a, upper, lower, c, around=None):
    """(cluster, distance, upper, lower, number of distances) after a pass over centroids c; a: the clusters
    before, -1 where there is none; upper, lower: bounds that hold for c."""
    around = around or Around(c)
    a, upper, lower = a.copy(), upper.copy(), lower.copy()
    own = np.empty(len(x), np.int64)
    new = a < 0
    a[new] = 0
    for k in np.unique(a):
        at = np.flatnonzero(a == k)
        own[at] = squared(x[at], c[k : k + 1])[:, 0]
    counted = len(x)
    exact = np.sqrt(own.astype(np.float64)) * (1 + SLACK)
    bound = np.maximum(lower, around.nearest[a] / 2 * (1 - SLACK))
    scan = new | (exact >= bound)
    upper = exact
    if len(c) == 1:
        return a, own, upper, np.full(len(x), np.inf), counted
    reach = np.where(new, np.inf, (2 * upper + around.nearest[a]) * (1 + SLACK))
    todo = np.flatnonzero(scan)
    # vectors with the same centroid and the same number of centroids in reach go together
    many = np.zeros(len(x), np.int64)
    for k in np.unique(a[todo]):
        at = todo[a[todo] == k]
        many[at] = np.searchsorted(around.far[k], reach[at], "right")
    group = a[todo] * len(c) + many[todo]
    for g in np.unique(group):
        at = todo[group == g]
        k, m = divmod(int(g), len(c))
        seen = np.sort(np.append(around.order[k][:m], k))
        d = squared(x[at], c[seen])
        counted += d.size - len(at)
        best = d.argmin(1)  # the first of equals, so the smallest number
        a[at], own[at] = seen[best], d[np.arange(len(at)), best]
        d[np.arange(len(at)), best] = np.iinfo(np.int64).max
        upper[at] = np.sqrt(own[at].astype(np.float64)) * (1 + SLACK)
        lower[at] = np.sqrt(d.min(1).astype(np.float64)) * (1 - SLACK)
    return a, own, upper, lower, counted


def _matrix(column) -> np.ndarray:
    """The arrays of an Arrow column without nulls as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(len(column), -1).astype(np.int64)
    if len(x) and int(np.abs(x).max(initial=0)) >= LARGEST:
        raise ValueError(f"components of {LARGEST} and more after scaling: distances would not fit a long")
    return x


def _pass(table: DataFrame, c: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """One assignment of every vector. moved: how far each centroid went since the bounds were made."""

    def run(batches):
        import pyarrow as pa

        around = Around(c)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            if moved is None:
                a, upper, lower = np.full(len(x), -1), np.full(len(x), np.inf), np.zeros(len(x))
            else:
                a, upper, lower = (batch.column(n).to_numpy() for n in ("cluster", "upper", "lower"))
                a = a.astype(np.int64)
                others = np.sort(moved)[::-1]  # the largest move of another centroid
                away = np.where((moved[a] == others[0]) & (np.count_nonzero(moved == others[0]) == 1), others[1] if len(others) > 1 else 0.0, others[0])
                upper, lower = (upper + moved[a]) * (1 + SLACK), np.maximum(0, (lower - away) * (1 - SLACK))
            a, own, upper, lower, _ = exponion(x, a, upper, lower, c, around)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), pa.array(a.astype(np.int32)), pa.array(own), pa.array(upper), pa.array(lower)], ["id", "x", "cluster", "distance", "upper", "lower"])

    return table.select("id", "x", *(["cluster", "upper", "lower"] if moved is not None else [])).mapInArrow(lean(run), STATE)


def _sums(state: DataFrame, k: int, dim: int):
    """Exact sums and counts of each cluster: partial ones of a task, added by Spark; k x (dim + 1) rows come to the driver."""

    def run(batches):
        import pyarrow as pa

        total, n = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                x, a = _matrix(batch.column("x")), batch.column("cluster").to_numpy()
                for i in np.unique(a):
                    total[i] += x[a == i].sum(0)
                    n[i] += np.count_nonzero(a == i)
        both = np.column_stack([total, n])
        i, p = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(p.astype(np.int32)), pa.array(both[i, p])], ["i", "p", "s"])

    rows = state.select("x", "cluster").mapInArrow(lean(run), "i int, p int, s long").groupBy("i", "p").agg(F.sum("s").alias("s")).collect()
    both = np.zeros((k, dim + 1), object)
    for i, p, s in rows:
        both[i, p] = int(s)
    return both[:, :dim], both[:, dim]


def first_centroids(vectors: DataFrame, k: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of `1:<id>`; of equal ids the least vector comes first, vectors without an id are none."""
    key = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    rows = vectors.filter("id IS NOT NULL").select(key.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64):
    """(assigned, centroids): assigned has (id, x, cluster, distance, upper, lower) of every vector kept, a written
    table; centroids is a k x dim array.

    Vectors that are null, have another length or hold nulls or non-finite entries are left out. With fewer
    vectors than k there are as many clusters as vectors with an id; with none the result is empty. Repeated rows are assigned each. Other columns are not looked at."""
    scratch = Scratch(df.sparkSession, "centroids")
    vectors = whole_vectors(df, id_col, vector_col, dim, scale)
    c = first_centroids(vectors, k)
    if not len(c):
        return df.sparkSession.createDataFrame([], STATE), c
    state, moved = scratch.cut(_pass(vectors, c, None)), None
    for _ in range(rounds):
        total, n = _sums(state, len(c), dim)
        new = np.array([[int(s) // int(m) for s in row] if m else old for row, m, old in zip(total, n, c.tolist())], np.int64)
        moved = np.sqrt(((new - c).astype(np.float64) ** 2).sum(1)) * (1 + SLACK)
        after = scratch.cut(_pass(state, new, moved))
        scratch.drop(state)
        state, c = after, new
    return state, c


def cluster_report(df: DataFrame, **how) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector kept."""
    spark = df.sparkSession
    state, c = cluster(df, **how)
    inertia = {r["cluster"]: int(r["s"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    rows = [(i, inertia.get(i, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for i, v in enumerate(c.tolist())]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    return state.join(F.broadcast(about), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(i: int) -> str:
    near = f"SELECT v.rid, min(struct_pack(d := list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(v.x, c.c)])::BIGINT, k := c.k)) AS m FROM kept v, c{i} c GROUP BY v.rid"
    if i == 3:
        return f"a3 AS ({near})"
    return f"""a{i} AS ({near}),
s{i} AS (SELECT k, list(q ORDER BY p) AS c FROM (
  SELECT k, p, CAST((s - (((s % n) + n) % n)) // n AS BIGINT) AS q FROM (
    SELECT a.m.k AS k, p, sum(v.x[p]) AS s, count(*) AS n FROM a{i} a JOIN kept v USING (rid), (SELECT unnest(range(1, 65)) AS p) GROUP BY a.m.k, p)) GROUP BY k),
c{i + 1} AS (SELECT c.k, coalesce(s.c, c.c) AS c FROM c{i} c LEFT JOIN s{i} s USING (k))"""


SQL = f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, [CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT) for e in embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len([e for e in embedding if e IS NULL OR NOT isfinite(e)]) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), x) - 1 AS k, x AS c FROM kept WHERE vec_id IS NOT NULL ORDER BY k LIMIT 16),
{", ".join(_round_sql(i) for i in range(4))},
i AS (SELECT m.k AS k, CAST(sum(m.d) AS BIGINT) AS s FROM a3 GROUP BY m.k)
SELECT v.vec_id, CAST(a.m.k AS INT) AS cluster, a.m.d AS distance, i.s AS cluster_inertia, CAST((SELECT sum(s) FROM i) AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM kept v JOIN a3 a USING (rid) JOIN c3 c ON c.k = a.m.k JOIN i ON i.k = a.m.k"""
