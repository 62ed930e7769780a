"""Packed pixels (runs of bytes) against the same operators on one row a pixel, and the large frames made of them."""

import numpy as np
import pytest

from imgspark import catalogue_files as Q
from imgspark.frame import from_arrays, from_pixels, map_frames, to_pixels, to_runs, SCHEMA
from imgspark.operators import kernels as K
from imgspark.operators import pixels as P
from imgspark.operators import tiles as T
from imgspark.sources.bands import png_files
from imgspark.sources.raster import read_png

SF = "/root/testdata/sf0.001"
SHAPES = [(37, 29, 3), (1, 40, 1), (19, 1, 1), (16, 16, 1), (2, 2, 1)]


@pytest.fixture(scope="module")
def frames():
    rng = np.random.default_rng(8)
    return {i: rng.integers(0, 200, s, dtype=np.uint8) for i, s in enumerate(SHAPES)}


@pytest.fixture(scope="module")
def packed(spark, frames):
    rows = from_arrays([(i, "a", a) for i, a in frames.items()]).to_pylist()
    return to_runs(spark.createDataFrame(rows, SCHEMA)).repartition(3).cache()


def seen(df, names=("img_id", "y", "x", "c", "v")):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


OPERATORS = {
    "erode": lambda p: P.erode(p, 20),
    "convolve": lambda p: P.convolve(p, list(range(-7, 8)), 5, 3),
    "gauss": lambda p: P.gaussian_taps(p, 3),
    "resize": lambda p: P.resize_bilinear(p, 11, 23),
    "warp": lambda p: P.warp_affine(p, K.rotation_matrix(30, 12, 9, 1.3), 21, 33, 7),
    "area": lambda p: P.resize_area(p, 7, 9),
    "equalize": P.equalize,
    "normalize": P.normalize,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_packed_equals_pixels(packed, name):
    got = OPERATORS[name](packed)
    assert T.is_packed(got)
    assert seen(T.unpack(got)) == seen(OPERATORS[name](T.unpack(packed)))


@pytest.mark.parametrize("side", [8, 512])
def test_packed_by_tiles_of_any_side(packed, frames, monkeypatch, side):
    erode = T.neighbourhood(packed, lambda a: K.erode(a, 20), 20, side)
    assert seen(T.unpack(erode)) == seen(P.erode(T.unpack(packed), 20))
    monkeypatch.setattr(P, "gather", lambda *a: T.gather(*a, side=side))
    for size in ((7, 9), (40, 70), (28, 36), (1, 1)):
        got = seen(T.unpack(P.resize_area(packed, *size)))
        want = sorted((i, y, x, c, int(v)) for i, a in frames.items() for (y, x, c), v in np.ndenumerate(K.resize_area(a, *size)))
        assert got == want


def test_packed_aggregates(packed):
    px = T.unpack(packed)
    assert seen(P.histogram(packed), ("img_id", "c", "bin", "n")) == seen(P.histogram(px), ("img_id", "c", "bin", "n"))
    assert seen(P.integral(packed), ("img_id", "y", "x", "s")) == seen(P.integral(px), ("img_id", "y", "x", "s"))


def test_packed_frames_and_files(packed, frames):
    for r in from_pixels(packed).collect():
        a = frames[r["img_id"]]
        assert (r["height"], r["width"], r["channels"]) == a.shape and bytes(r["data"]) == a.tobytes()
    assert seen(to_pixels(from_pixels(packed))) == seen(T.unpack(packed))
    for r in png_files(packed, rows=5).collect():
        assert (read_png(bytes(r["content"])) == frames[r["img_id"]]).all()


def test_large_frames_are_dealt_to_tasks(spark):
    """The small table of events must not leave all pixels to one task, nor broadcast them."""
    px = Q.large(spark, SF)
    assert T.is_packed(px) and px.rdd.getNumPartitions() == T.tasks(px)
    assert sum(len(p) > 0 for p in px.select("y").rdd.glom().collect()) == T.tasks(px)
    assert "SinglePartition" not in px._jdf.queryExecution().executedPlan().toString().split("Union")[0]


def test_shuffles_carry_runs(spark):
    """Equalizing, normalizing and area resizing exchange runs of bytes, not one row a pixel."""
    for f in (P.equalize, P.normalize, lambda p: P.resize_area(p, 43, 43)):
        df = f(Q.large(spark, SF))
        assert T.is_packed(df)
        assert "Generate explode(sequence(0, 323" not in df._jdf.queryExecution().executedPlan().toString()


def test_distances_meet_as_frames(spark):
    """No row a pixel in the join, and no side of a guessed size is broadcast."""
    from imgspark import catalogue_more as M
    from imgspark.frame import distances

    for name, f in (("shrink", Q.FILE_QUERIES["s_jpeg_shrink_px"]), ("tol", M.MORE["s_jpeg_tol"]), ("baseline", M.MORE["s_jpeg_baseline_tol"])):
        text = f(spark, SF)._jdf.queryExecution().executedPlan().toString()
        join = next(line for line in text.splitlines() if "Join" in line)
        assert "SortMergeJoin [img_id#" in join and "BroadcastHashJoin" not in text, name
    rng = np.random.default_rng(1)
    a = {i: rng.integers(0, 256, (3, 4, 3), dtype=np.uint8) for i in range(3)}
    b = {0: a[0], 1: (a[1].astype(int) // 2).astype(np.uint8).reshape(4, 3, 3), 2: np.minimum(a[2], 200)}
    one, two = (spark.createDataFrame(from_arrays([(i, "a", x) for i, x in d.items()]).to_pylist(), SCHEMA) for d in (a, b))
    got = {r["img_id"]: (r["n"], r["worst"]) for r in distances(one, two).collect()}
    assert got == {0: (36, 0), 1: (36, 999), 2: (36, max(0, int(a[2].max()) - 200))}


def test_pictures_are_dealt_to_tasks(spark):
    """The small table of suppliers must not leave all decoding to one task; each picture is decoded once."""
    text = Q.FILE_QUERIES["s_jpeg_files"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in text and text.count("Scan parquet") == 1 and "Join" not in text


def test_few_tasks_for_many_partitions(spark, packed):
    """A small image must not start a Python task for each of hundreds of shuffle partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        most = T.A_CORE * spark.sparkContext.defaultParallelism
        assert T.tasks(packed) == most < 200
        assert T.by_tile(T.runs(packed, 1)).rdd.getNumPartitions() == from_pixels(packed).rdd.getNumPartitions() == most
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("side", [8, 512])
def test_sums_by_runs(packed, monkeypatch, side):
    """Runs of sums hold what one row a pixel does; their carries are made once, for one exchange."""
    sums = T.integral
    monkeypatch.setattr(P, "prefix_sums", lambda px, **how: sums(px, side, **how))
    got = [(r["img_id"], r["y"], r["x"] + i, s) for r in P.integral(packed, by_runs=True).collect() for i, s in enumerate(r["s"])]
    assert sorted(got) == seen(P.integral(packed), ("img_id", "y", "x", "s"))
    rows = {(r["img_id"], r["y"]): (r["n"], r["s"], r["sx"]) for r in Q._row_sums(P.integral(packed, by_runs=True)).collect()}
    for (i, y), row in rows.items():
        mine = [(x, s) for k, at, x, s in got if (k, at) == (i, y)]
        assert row == (len(mine), sum(s for _, s in mine), sum(x * s for x, s in mine))


def test_counts_take_one_python_step(spark, packed):
    """A task of these queries starts one Python process, and writes no file for each of hundreds of shuffle partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "197")
    try:
        for name in ("b_convolve_px", "b_erode_px", "b_gaussian_px", "b_dilate_px", "b_threshold"):
            text = Q.FILE_QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
            assert text.count("MapInArrow") == 1 and ", 197)" not in text, name
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("held", [1, 256])
def test_value_counts_by_hand(spark, packed, frames, monkeypatch, held):
    monkeypatch.setattr(T, "HELD", held)
    want = {}
    for i, a in frames.items():
        for (y, x, c), v in np.ndenumerate(a):
            t = want.setdefault((i, c, int(v)), [0, 0, 0])
            t[0], t[1], t[2] = t[0] + 1, t[1] + y, t[2] + x
    # runs that start anywhere
    cut = T.runs(packed, 0, 7).select(*T.NAMES)
    for px in (packed, cut, to_runs(from_pixels(packed))):
        assert {(r["img_id"], r["c"], r["v"]): [r["n"], r["sy"], r["sx"]] for r in T.value_counts(px).collect()} == want
    got = {r["v"]: r["n"] for r in T.value_counts(packed, ["v"]).collect()}
    assert got == {v: sum(t[0] for k, t in want.items() if k[2] == v) for v in {k[2] for k in want}}


def test_steps_join_only_where_nothing_is_between(spark, packed):
    fr = from_pixels(packed)
    one = to_runs(map_frames(fr, K.invert))
    # the plan of the cached source is printed below it
    assert one._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0].count("MapInArrow") == 1
    kept = map_frames(fr, K.invert).cache()
    two = to_runs(kept)
    assert "InMemoryTableScan" in two._jdf.queryExecution().executedPlan().toString()
    some = to_runs(map_frames(fr, K.invert).where("img_id < 2"))
    assert seen(one) == seen(two) and seen(some) == [r for r in seen(one) if r[0] < 2] and len(seen(some))
    kept.unpersist()


def test_several_events_of_a_cell(spark, tmp_path):
    """The largest value of an id is drawn; ids below 0 and without value are not, and cells without event are 0."""
    rows = [(0, 7.5), (0, 200.9), (2, None), (5, -30.2), (-1, 9.0), (None, 9.0), (Q.ACROSS**2 + Q.ACROSS, 300.0)]
    spark.createDataFrame(rows, "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["img_id"]: np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"]) for r in from_pixels(Q.large(spark, str(tmp_path))).collect()}
    for i, cells in ((0, {(0, 0): 200, (0, 5): 30}), (1, {(1, 0): 44})):
        want = np.zeros((Q.ACROSS, Q.SIDE, Q.ACROSS, Q.SIDE), np.uint8)
        for (y, x), v in cells.items():
            want[y, Q.MARGIN : -Q.MARGIN, x, Q.MARGIN : -Q.MARGIN] = v
        assert (got[i] == want.reshape(Q.ACROSS * Q.SIDE, -1)).all()
    assert set(got) == {0, 1}
