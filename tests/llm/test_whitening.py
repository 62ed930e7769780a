import numpy as np
import pytest

from imgspark.llm import whitening as W

SF = "/root/testdata/sf0.001"
FIELDS = "vec_id long, embedding array<double>, n int, id string"


def brute(vectors, components=4, scale=256):
    """Rows (deviation, whitened without sign, explained) by the covariance itself."""
    x = np.floor(scale * np.array(vectors, np.float64)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = (n * fit - s) / n
    values, u = np.linalg.eigh(c.T @ c / n)
    values, u = values[::-1][:components], u[:, ::-1][:, :components]
    t = n * x.astype(object) - s.astype(object)
    return n, [int(v) for v in (t * t).sum(1)], (t / n).astype(float) @ (u / np.sqrt(values)), values / np.trace(c.T @ c / n)


def test_whole_table_equals_brute_force(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = table.select("vec_id", "embedding").collect()
    n, deviation, y, explained = brute([r["embedding"] for r in rows])
    got = {(r["vec_id"], r["component"]): r for r in W.whiten(table).collect()}
    assert len(got) == 4 * len(rows)
    for k in range(4):
        mine = np.array([got[r["vec_id"], k + 1]["whitened"] for r in rows])
        assert min(np.abs(mine - y[:, k]).max(), np.abs(mine + y[:, k]).max()) < 1e-8
        assert [got[r["vec_id"], k + 1]["deviation"] for r in rows] == deviation
        assert abs(got[rows[0]["vec_id"], k + 1]["explained"] / explained[k] - 1) < 1e-9
    one = next(iter(got.values()))
    assert one["n"] == n and one["identity_error"] < 1e-8


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(0)
    good = [(i, rng.normal(0, [4, 3, 2, 1, 0.5]).tolist(), 1, "x") for i in range(60)]
    good += [(None, good[0][1], 1, None), (3, good[3][1], 1, "x"), (3, good[3][1], 1, "x")]
    bad = [(70, None, 0, ""), (71, [1.0, None, 0.0, 0.0, 0.0], 0, ""), (72, [nan] * 5, 0, ""), (73, [inf, 0.0, 0.0, 0.0, 0.0], 0, "")]
    short = [(80, [1.0, 2.0], 1, ""), (81, [], 1, "")]
    out = W.whiten(spark.createDataFrame(good + bad + short, FIELDS)).collect()
    padded = [r[1] + [0.0] * (5 - len(r[1])) for r in good + short]
    n, deviation, y, _ = brute(padded)
    assert n == 62 and len(out) == 4 * len(padded) and {r["n"] for r in out} == {62}
    assert sorted(r["deviation"] for r in out if r["component"] == 1) == sorted(deviation)
    assert sum(r["vec_id"] is None for r in out) == 4 and max(r["identity_error"] for r in out) < 1e-8
    mine = sorted(abs(r["whitened"]) for r in out if r["component"] == 2)
    assert np.allclose(mine, sorted(np.abs(y[:, 1])), atol=1e-8)


@pytest.mark.parametrize("vectors, components", [([], 0), ([[1.0, 2.0]] * 3, 0), ([[1.0, 2.0], [3.0, 6.0]], 1), ([[], []], 0), ([[float(i % 2), float(i // 2)] for i in range(4)], 2)])
def test_few_components(spark, vectors, components):
    out = W.whiten(spark.createDataFrame([(i, v, 0, "") for i, v in enumerate(vectors)], FIELDS)).collect()
    assert len(out) == components * len(vectors)
    assert {r["component"] for r in out} == set(range(1, components + 1))


def test_deviations_beyond_a_long(spark):
    rows = [(i, [float(2**40 * i), float(i)], 0, "") for i in range(50)]
    out = W.whiten(spark.createDataFrame(rows, FIELDS))
    assert {r["deviation"] for r in out.collect()} == {None}
    t = W._times(np.array([[3, 5]]), 7, [1, 2])
    assert W._deviations(t).tolist() == [20**2 + 33**2]
    assert W._deviations(W._times(np.array([[2**40, 0]]), 2**30, [0, 0])).tolist() == [2**140]


def matrix(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize("values", [[9, 9, 9, 9, 9, 9, 9, 1, 1, 0, 0, 0], [5, 4, 3, 2] + [0] * 30, list(range(200, 0, -1)), [1.0 + 1e-6 * i for i in range(40)]])
@pytest.mark.parametrize("most_blocks", [8, 40])
def test_lanczos_with_breakdowns_and_restarts(values, most_blocks):
    a = matrix(sorted(values, reverse=True))
    found, vectors, _ = W.block_lanczos(lambda b: a @ b, len(a), 4, most_blocks=most_blocks)
    assert np.allclose(found, sorted(values)[::-1][:4], rtol=1e-12, atol=1e-12)
    assert np.abs(a @ vectors - vectors * found).max() < 1e-11 * max(values)
    assert np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-12)


def test_no_convergence_is_an_error(monkeypatch):
    a = matrix([1.0 + 1e-6 * i for i in range(200)])
    monkeypatch.setattr(W, "MOST_RESTARTS", 2)
    with pytest.raises(ArithmeticError):
        W.block_lanczos(lambda b: a @ b, 200, 4, most_blocks=4)


def test_passes_are_fewer_than_dimensions_where_values_fall():
    a = matrix([0.7**i for i in range(300)])
    _, _, passes = W.block_lanczos(lambda b: a @ b, 300, 4)
    assert passes <= 12
