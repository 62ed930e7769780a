import hashlib

import numpy as np
import pytest

from imgspark.llm import centroids as C

FIELDS = "vec_id long, embedding array<float>, x string, cluster int"


def brute(rows, k=16, rounds=3, dim=64, scale=64):
    """{(id, vector): (cluster, distance)} and centroids, by full scans in Python's whole numbers."""
    kept = [(i, tuple(int(np.floor(scale * float(np.float32(e)))) for e in v)) for i, v, *_ in rows if v is not None and len(v) == dim and all(e is not None and np.isfinite(e) for e in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:k]
    c = [x for _, x in first]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, m)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(near(x)[1], []).append(x)
        c = [tuple(sum(col) // len(groups[j]) for col in zip(*groups[j])) if j in groups else old for j, old in enumerate(c)]
    return [(i, *near(x)[::-1]) for i, x in kept], c


def check(spark, rows, **how):
    want, c = brute(rows, **how)
    out = C.cluster_report(spark.createDataFrame(rows, FIELDS), **how).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in out), key=key) == sorted(want, key=key)
    for r in out:
        assert r["inertia"] == sum(w[2] for w in want) and r["cluster_inertia"] == sum(w[2] for w in want if w[1] == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, c[r["cluster"]])).encode()).hexdigest()


def test_ties_copies_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(-2, 3, 4) / 2).tolist(), "a", i) for i in range(300)]
    rows += [(500 + i, [0.5, -0.5, 0.0, 1.0], "hot", 0) for i in range(150)] + [rows[0], (None, [1.0, 1.0, 0.0, 0.0], "b", None)]
    rows += [(900, None, "", 0), (901, [1.0], "", 0), (902, [1.0, None, 0.0, 0.0], "", 0), (903, [float("nan")] * 4, "", 0), (904, [float("inf"), 0.0, 0.0, 0.0], "", 0), (905, [], "", 0)]
    check(spark, rows, k=7, rounds=4, dim=4, scale=2)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, n):
    rows = [(i, [float(i), 0.0], "", 0) for i in range(n)]
    if n:
        check(spark, rows, k=16, rounds=3, dim=2, scale=64)
    else:
        assert C.cluster_report(spark.createDataFrame([], FIELDS)).count() == 0


def test_all_copies_leave_clusters_empty(spark):
    check(spark, [(i, [1.0, 2.0], "", 0) for i in range(40)], k=4, rounds=3, dim=2, scale=1)


def test_too_large_is_an_error(spark):
    with pytest.raises(Exception, match="would not fit"):
        C.cluster_report(spark.createDataFrame([(1, [3e30, 0.0], "", 0)], FIELDS), dim=2).count()


def test_exponion_equals_a_full_scan_and_skips():
    """Bounds that are carried over moves of the centroids give every nearest centroid and tie, with a share of the distances."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-400, 400, (20, 8))
    x = (centres[rng.integers(0, 20, 4000)] + rng.integers(-9, 10, (4000, 8))).astype(np.int64)
    c = x[:20].copy()
    a, own, up, low, counted = C.exponion(x, np.full(len(x), -1), np.full(len(x), np.inf), np.zeros(len(x)), c)
    total = counted
    for _ in range(6):
        assert (a == C.squared(x, c).argmin(1)).all() and (own == C.squared(x, c).min(1)).all()
        new = np.array([x[a == i].sum(0) // max(1, (a == i).sum()) if (a == i).any() else c[i] for i in range(20)])
        moved = np.sqrt(((new - c) ** 2).sum(1))
        c = new
        a, own, up, low, counted = C.exponion(x, a, up + moved[a], low - moved.max(), c)
        total += counted
    assert total < 0.5 * 7 * 20 * len(x)


def test_exact_beyond_doubles():
    x, c = np.array([[1 << 26, 3]]), np.array([[-(1 << 26), 0]])
    assert C.squared(x, c).tolist() == [[(1 << 54) + 9]]
