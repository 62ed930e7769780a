"""Tiles against whole frames: sides that do not divide the image, halos wider than a tile, several planes."""

import numpy as np
import pytest

from imgspark.operators import kernels as K
from imgspark.operators import pixels as P
from imgspark.operators import tiles as T

#: (kernel, halo)
CASES = {
    "convolve": (lambda a: K.convolve(a, list(range(-7, 8)), 5, 3), 2),
    "box": (lambda a: K.box_blur(a, 9), 9),
    "gauss": (lambda a: K.gaussian_blur_taps(a, 3), 3),
    "gauss3": (lambda a: K.gaussian_blur(a, 1), 1),
    "sobel": (K.sobel, 1),
    "erode": (lambda a: K.erode(a, 20), 20),
    "open": (lambda a: K.open_(a, 6), 12),
    "black_hat": (lambda a: K.black_hat(a, 2), 4),
    "adaptive": (lambda a: K.adaptive_threshold(a, 7, 3), 4),
    "adaptive_gauss": (lambda a: K.adaptive_threshold(a, 9, 2, True, "gaussian"), 5),
    "binomial": (K.binomial_edges, 2),
}
SHAPES = [(37, 29, 3), (1, 40, 1), (19, 1, 1), (16, 16, 1), (2, 2, 1)]


@pytest.fixture(scope="module")
def frames():
    rng = np.random.default_rng(5)
    return {i: rng.integers(0, 256, s, dtype=np.uint8) for i, s in enumerate(SHAPES)}


@pytest.fixture(scope="module")
def px(spark, frames):
    rows = [(i, int(y), int(x), int(c), int(a[y, x, c])) for i, a in frames.items() for y, x, c in np.ndindex(a.shape)]
    order = np.random.default_rng(1).permutation(len(rows))
    return spark.createDataFrame([rows[i] for i in order], "img_id long, y int, x int, c int, v int").repartition(3).cache()


def arrays(df, frames, name="v", dtype=np.int64, grow=0):
    out = {i: np.full((a.shape[0] + grow, a.shape[1] + grow, a.shape[2]), -1, dtype) for i, a in frames.items()}
    n = 0
    for r in df.collect():
        out[r["img_id"]][r["y"], r["x"], r["c"]] = r[name]
        n += 1
    assert n == sum(a.size for a in out.values())
    return out


@pytest.mark.parametrize("side", [8, 64])
@pytest.mark.parametrize("name", sorted(CASES))
def test_tiles_equal_whole_frames(px, frames, name, side):
    kernel, halo = CASES[name]
    got = arrays(T.neighbourhood(px, kernel, halo, side), frames)
    for i, a in frames.items():
        want = np.dstack([kernel(a[..., c : c + 1]).reshape(a.shape[:2]) for c in range(a.shape[2])])
        assert (got[i] == want).all(), (name, i)


def test_float_values(px, frames):
    got = arrays(T.neighbourhood(px, K.canny_maxima, 3, 8, "float", "m"), frames, "m", np.float32)
    for i, a in frames.items():
        for c in range(a.shape[2]):
            assert (got[i][..., c] == K.canny_maxima(a[..., c : c + 1])).all()


@pytest.mark.parametrize("side", [4, 16, 64])
def test_integral_by_tiles(px, frames, side):
    got = arrays(T.integral(px, side), frames, "s")
    for i, a in frames.items():
        assert (got[i] == a.astype(np.int64).cumsum(0).cumsum(1)).all()


def test_aggregates_per_plane(px, frames):
    equal, normal = arrays(P.equalize(px), frames), arrays(P.normalize(px), frames)
    for i, a in frames.items():
        for c in range(a.shape[2]):
            assert (equal[i][..., c : c + 1] == K.equalize(a[..., c : c + 1])).all()
            assert (normal[i][..., c : c + 1] == K.normalize(a[..., c : c + 1])).all()


SIZES = [(9, 5), (40, 70), (1, 1), (29, 3)]


@pytest.mark.parametrize("side", [8, 512])
@pytest.mark.parametrize("width, height", SIZES)
@pytest.mark.parametrize("name", ["resize_nearest", "resize_bilinear", "resize_q15"])
def test_resizing_by_tiles(px, frames, monkeypatch, side, width, height, name):
    monkeypatch.setattr(P, "gather", lambda *a: T.gather(*a, side=side))
    want = {i: getattr(K, name)(a, width, height) for i, a in frames.items()}
    got = arrays(getattr(P, name)(px, width, height), want)
    assert all((got[i] == want[i]).all() for i in want)


MATRICES = [K.rotation_matrix(30, 12, 9, 1.3), (1, 0, 3, 0, 1, -2), (0.1, 0, 2, 0, 0.2, 1), (7.5, 0, -20, 0, 9, -3), (0, 0, 4.5, 0, 0, 2.25), (1, 1, 0, 1, 1, 0), (1, 0, 500, 0, 1, 500)]


@pytest.mark.parametrize("side", [8, 512])
@pytest.mark.parametrize("matrix", MATRICES)
def test_warps_by_tiles(px, frames, monkeypatch, side, matrix):
    """Shrinking, growing, singular and far-off maps alike."""
    monkeypatch.setattr(P, "gather", lambda *a: T.gather(*a, side=side))
    want = {i: K.warp_affine(a, matrix, 21, 33, 7) for i, a in frames.items()}
    got = arrays(P.warp_affine(px, matrix, 21, 33, 7), want)
    assert all((got[i] == want[i]).all() for i in want)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, px):
    """One exchange, by tile; no window over pixels."""
    cols = px.select("*")
    for f in (lambda p: P.convolve(p, [1] * 9, 3, 3), lambda p: P.erode(p, 40), lambda p: P.gaussian_taps(p, 2), lambda p: P.adaptive_threshold(p), P.canny_maxima, P.close, P.sharpen, P.binomial_edges):
        text = plan(f(cols))
        assert "Window" not in text and text.count("Exchange hashpartitioning(img_id") == 1 and "ty" in text
    # windows of prefix sums are over carries of tiles, those of equalize over the counts of a plane
    assert "way" in plan(P.integral(cols)) and "Window" not in plan(P.normalize(cols))


def test_empty(spark):
    none = spark.createDataFrame([], "img_id long, y int, x int, c int, v int")
    assert P.erode(none, 3).count() == 0 and P.integral(none).count() == 0 and P.equalize(none).count() == 0


# ---- one PNG by bands


@pytest.mark.parametrize("shape, rows", [((300, 90, 3), 16), ((300, 90, 3), 500), ((5, 40_000, 1), 1), ((130, 7, 4), 64)])
def test_png_by_bands(spark, shape, rows):
    """The same pixels as one stream, about its size; a band refers back to the rows before it."""
    import zlib

    from imgspark.frame import from_arrays, SCHEMA, to_pixels
    from imgspark.sources import bands, raster

    rng = np.random.default_rng(3)
    a = (np.indices(shape).sum(0) // 3 % 256).astype(np.uint8) ^ rng.integers(0, 4, shape, dtype=np.uint8)
    fr = spark.createDataFrame([(7, "a", shape[1], shape[0], shape[2], bytearray(a.tobytes()))], SCHEMA)
    files = bands.png_files(to_pixels(fr), 6, rows).collect()
    assert len(files) == 1 and files[0]["path"] == "7.png"
    data = bytes(files[0]["content"])
    assert (raster.read_png(data) == a).all()
    one = raster.write_png(a, 6)
    assert len(data) <= 1.01 * len(one) + 40 * -(-shape[0] // rows)
    assert bands.adler_combined(zlib.adler32(one[:50]), zlib.adler32(one[50:]), len(one) - 50) == zlib.adler32(one)


# ---- rules of plans


def test_plan_rules():
    from imgspark.plans.pipeline import Plan, chained, rewrite

    rng = np.random.default_rng(4)
    rgb, gray = rng.integers(0, 256, (23, 31, 3), dtype=np.uint8), rng.integers(0, 256, (23, 31, 1), dtype=np.uint8)
    cases = [
        (Plan().grayscale().threshold(128), rgb, "gray_threshold(128,)"),
        (Plan().grayscale().threshold(100).erode(2), rgb, "gray_threshold_erode(100, 2)"),
        (Plan().blur(1).edges(), gray, "binomial_edges"),
        (Plan().grayscale().blur(1).edges(), rgb, "gray_binomial_edges"),
        (Plan().blur(2).edges(), gray, "blur_edges(2, None)"),
        (Plan().brightness_contrast(12.5, 1.4).gamma(2.2).invert(), rgb, "point_table"),
        (Plan().gamma(0.5).threshold(99), gray, "point_table"),
        (Plan().gaussian_blur_taps(3).erode(2).crop(2, 9, 12, 11), gray, "crop_around(2, 9, 12, 11, 5) -> gaussian_blur_taps(3,) -> erode(2,) -> crop(2, 5, 12, 11)"),
        (Plan().invert().crop(2, 9, 12, 11), rgb, "crop_around(2, 9, 12, 11, 0) -> invert"),
        (Plan().sharpen(1.0).invert().extract_channel(2), rgb, "extract_channel(2,) -> sharpen(1.0,) -> invert"),
        (Plan().flip_h().crop(1, 1, 4, 4), rgb, "flip_h -> crop(1, 1, 4, 4)"),
    ]
    for plan_, frame, text in cases:
        assert plan_.explain() == text
        if "binomial" not in text:  # which is another filter by design
            assert (chained(rewrite(plan_.steps))(frame) == chained(plan_.steps)(frame)).all(), text
    with pytest.raises(ValueError):
        chained(rewrite(Plan().invert().crop(30, 1, 4, 4).steps))(rgb)


# ---- components over many tiles


def spiral(n):
    """A path of one pixel that winds inwards, two apart."""
    a = np.zeros((n, n), bool)
    y, x, dy, dx = 0, 0, 0, 1
    a[0, 0] = True
    turns = 0
    while turns < 4:
        ny, nx, fy, fx = y + dy, x + dx, y + 2 * dy, x + 2 * dx
        if not (0 <= ny < n and 0 <= nx < n) or a[ny, nx] or (0 <= fy < n and 0 <= fx < n and a[fy, fx]):
            dy, dx, turns = dx, -dy, turns + 1
            continue
        y, x, turns = ny, nx, 0
        a[y, x] = True
    return a


@pytest.mark.parametrize("fan, levels", [(16, 0), (4, 1), (3, 2)])
def test_a_spiral_over_many_tiles(spark, monkeypatch, fan, levels):
    """One component through 30 x 30 tiles, and a second image of noise, at any number of levels."""
    from imgspark.operators import components as C

    joined = C._joined
    monkeypatch.setattr(C, "_joined", lambda pieces, connectivity, tile: joined(pieces, connectivity, tile, fan, levels))
    images = {1: spiral(120), 2: np.random.default_rng(0).random((50, 70)) < 0.5}
    rows = [(i, int(y), int(x), 0, 255) for i, a in images.items() for y, x in zip(*np.nonzero(a))]
    px = spark.createDataFrame(rows, "img_id long, y int, x int, c int, v int")
    got = C.components_pixels(px, connectivity=4, tile=4).orderBy("img_id", "id").collect()
    assert sum(r["img_id"] == 1 for r in got) == 1 and got[0]["area"] == images[1].sum()
    want = list(K.components(images[2].astype(np.uint8)[..., None] * 255, connectivity=4))
    assert [(r["id"], r["x"], r["y"], r["width"], r["height"], r["area"]) for r in got if r["img_id"] == 2] == [tuple(c[:6]) for c in want]
