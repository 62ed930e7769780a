"""Frame kernels against slow statements of the rules, against the pixel form, and against themselves."""

import math

import numpy as np
import pytest

from imgspark.frame import from_arrays, to_array
from imgspark.operators import kernels as K
from imgspark.operators import pixels as P

SIZES = [(1, 1), (1, 5), (5, 1), (2, 2), (3, 3), (7, 5), (9, 7)]


def frames(channels, seed=0):
    rng = np.random.default_rng(seed)
    for h, w in SIZES:
        yield rng.integers(0, 256, (h, w, channels), dtype=np.uint8)


def clamp(i, n):
    return min(n - 1, max(0, i))


def test_validation():
    for bad in ((0, 1, 1, b""), (1, 1, 2, b"ab"), (2, 1, 1, b"a")):
        with pytest.raises(ValueError):
            to_array(*bad)
    with pytest.raises(ValueError):
        K.grayscale(np.zeros((2, 2, 1), np.uint8))
    with pytest.raises(ValueError):
        K.sobel(np.zeros((2, 2, 3), np.uint8))
    with pytest.raises(ValueError):
        K.convolve(np.zeros((2, 2, 1), np.uint8), [1, 1], 2, 1)
    with pytest.raises(ValueError):
        K.resize(np.zeros((2, 2, 1), np.uint8), 2, 2, "cubic")
    with pytest.raises(ValueError):
        K.crop(np.zeros((2, 2, 1), np.uint8), 1, 1, 2, 1)


def test_convolve_and_morphology_by_hand():
    k = [1, 0, -1, 2, 1, -2, 1, 1, -1]
    for f in frames(1):
        h, w, _ = f.shape
        con, low, high = np.zeros_like(f), np.zeros_like(f), np.zeros_like(f)
        for y in range(h):
            for x in range(w):
                s = sum(int(f[clamp(y + j - 1, h), clamp(x + i - 1, w), 0]) * k[j * 3 + i] for j in range(3) for i in range(3))
                con[y, x] = min(255, max(0, s))
                near = [int(f[clamp(y + j, h), clamp(x + i, w), 0]) for j in range(-2, 3) for i in range(-2, 3)]
                low[y, x], high[y, x] = min(near), max(near)
        assert (K.convolve(f, k, 3, 3) == con).all()
        assert (K.erode(f, 2) == low).all() and (K.dilate(f, 2) == high).all()


def test_fixed_answers():
    assert K.gamma(np.full((1, 1, 1), 128, np.uint8), 2.0)[0, 0, 0] == 180
    assert K.gamma(np.full((1, 1, 1), 128, np.uint8), 0.5)[0, 0, 0] == 64
    flat = np.full((1, 5, 1), 60, np.uint8)
    assert K.box_blur(flat, 1, "compat")[0, :, 0].tolist() == [90, 80, 80, 80, 120]
    assert K.box_blur(flat, 1)[0, :, 0].tolist() == [60] * 5
    assert not K.equalize(np.full((3, 3, 1), 9, np.uint8)).any()
    step = np.zeros((6, 8, 1), np.uint8)
    step[:, 4:] = 40
    assert K.binomial_edges(step)[3, :, 0].tolist() == [0, 0, 40, 120, 120, 40, 0, 0]
    assert K.blur_edges(step)[3, :, 0].tolist() == [0, 0, 40, 116, 120, 44, 0, 0]
    assert K.resolve_size(8, 4, width=4) == (4, 2)
    assert K.resolve_size(8, 4, 4, 4, "contain") == (4, 2) and K.resolve_size(8, 4, 4, 4, "cover") == (8, 4)
    assert K.brushed([(5, 5)], 2) == K.brushed([(5, 5)], 3)
    assert K.colour_values(3, {"r": 300, "g": -56, "b": 128}) == [44, 200, 128]


def test_metamorphic():
    for f in frames(3, 1):
        assert (K.invert(K.invert(f)) == f).all()
        assert (K.flip_h(K.flip_h(f)) == f).all() and (K.flip_v(K.flip_v(f)) == f).all()
        assert (K.rotate90(K.rotate270(f)) == f).all()
        assert (K.rotate90(K.rotate90(f)) == K.rotate180(f)).all()
        assert K.histogram(f).sum() == f.size
        assert (K.resize_bilinear(f, f.shape[1], f.shape[0]) == f).all()
    for g in frames(1, 2):
        assert (K.open_(g) <= g).all() and (K.close(g) >= g).all()
        assert (K.erode(K.invert(g)) == K.invert(K.dilate(g))).all()
        assert K.sum_rect(K.integral(g), 0, 0, g.shape[1], g.shape[0]) == g.sum(dtype=int)
        assert K.gaussian_blur(g, 1).shape == g.shape


def test_hsv_round_trip_of_hues():
    hue = np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 255, 255], [0, 0, 0]]], np.uint8)
    hsv = K.rgb_to_hsv(hue)
    assert hsv[0, :, 0].tolist() == [0, 60, 119, 0, 0]
    assert np.abs(K.hsv_to_rgb(hsv).astype(int) - hue).max() <= 3


def flood(on, connectivity):
    seen, out = set(), []
    near = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0) and (connectivity == 8 or abs(i) + abs(j) == 1)]
    for y in range(on.shape[0]):
        for x in range(on.shape[1]):
            if on[y, x] and (y, x) not in seen:
                stack, part = [(y, x)], []
                seen.add((y, x))
                while stack:
                    p = stack.pop()
                    part.append(p)
                    for i, j in near:
                        q = (p[0] + i, p[1] + j)
                        if 0 <= q[0] < on.shape[0] and 0 <= q[1] < on.shape[1] and on[q] and q not in seen:
                            seen.add(q)
                            stack.append(q)
                ys, xs = zip(*part)
                out.append((len(out), min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(part), sum(xs) / len(part), sum(ys) / len(part)))
    return out


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components(connectivity):
    rng = np.random.default_rng(3)
    for _ in range(60):
        on = rng.random(rng.integers(1, 14, 2)) < rng.choice([0.3, 0.5, 0.7])
        got = K.components((on * 255).astype(np.uint8)[..., None], connectivity=connectivity)
        assert got == flood(on, connectivity)
    spiral = np.zeros((9, 9), bool)
    spiral[0], spiral[:, 8], spiral[8], spiral[2:, 0], spiral[2, :7], spiral[2:7, 6], spiral[6, 2:7] = (True,) * 7
    assert len(K.components((spiral * 255).astype(np.uint8)[..., None], connectivity=4)) == len(flood(spiral, 4))


def test_pixel_form_agrees(spark):
    """Odd sizes and several channels through both forms."""
    rng = np.random.default_rng(4)
    gray = [rng.integers(0, 256, (h, w, 1), dtype=np.uint8) for h, w in SIZES]
    px = spark.createDataFrame([(i, y, x, 0, int(f[y, x, 0])) for i, f in enumerate(gray) for y in range(f.shape[0]) for x in range(f.shape[1])], "img_id long, y int, x int, c int, v int").cache()
    cases = {
        "sobel": (K.sobel, P.sobel),
        "erode": (lambda f: K.erode(f, 2), lambda p: P.erode(p, 2)),
        "close": (K.close, P.close),
        "gradient": (K.morph_gradient, P.morph_gradient),
        "black_hat": (K.black_hat, P.black_hat),
        "gaussian3": (K.gaussian_blur, P.gaussian3),
        "gaussian_taps": (lambda f: K.gaussian_blur_taps(f, 3), lambda p: P.gaussian_taps(p, 3)),
        "box": (lambda f: K.box_blur(f, 2), lambda p: P.box_blur(p, 2)),
        "box_compat": (lambda f: K.box_blur(f, 2, "compat"), lambda p: P.box_blur(p, 2, "compat")),
        "convolve": (lambda f: K.convolve(f, [1, -2, 1, 0, 3, -1, 2, 0, -1], 3, 3), lambda p: P.convolve(p, [1, -2, 1, 0, 3, -1, 2, 0, -1], 3, 3)),
        "equalize": (K.equalize, P.equalize),
        "normalize": (K.normalize, P.normalize),
        "adaptive": (lambda f: K.adaptive_threshold(f, 4, 3), lambda p: P.adaptive_threshold(p, 4, 3)),
        "adaptive_gaussian": (lambda f: K.adaptive_threshold(f, 5, 3, True, "gaussian"), lambda p: P.adaptive_threshold(p, 5, 3, True, "gaussian")),
        "rotate90": (K.rotate90, P.rotate90),
        "nearest": (lambda f: K.resize_nearest(f, 4, 6), lambda p: P.resize_nearest(p, 4, 6)),
        "bilinear": (lambda f: K.resize_bilinear(f, 4, 6), lambda p: P.resize_bilinear(p, 4, 6)),
        "q15": (lambda f: K.resize_q15(f, 4, 6), lambda p: P.resize_q15(p, 4, 6)),
        "warp": (lambda f: K.warp_affine(f, K.rotation_matrix(20, 2, 2), 6, 4, 7), lambda p: P.warp_affine(p, K.rotation_matrix(20, 2, 2), 6, 4, 7)),
        "filled_rect": (lambda f: K.draw_filled_rect(f, 1, 1, 3, 2, {"gray": 9}), lambda p: P.draw_filled_rect(p, 1, 1, 1, 3, 2, {"gray": 9})),
        "rect": (lambda f: K.draw_rect(f, 0, 1, 5, 4, None, 2), lambda p: P.draw_rect(p, 1, 0, 1, 5, 4, None, 2)),
        "circle": (lambda f: K.draw_filled_circle(f, 2, 2, 2), lambda p: P.draw_filled_circle(p, 1, 2, 2, 2)),
    }
    for name, (f, p) in cases.items():
        want = sorted((i, y, x, int(a[y, x, 0])) for i, a in enumerate(map(f, gray)) for y in range(a.shape[0]) for x in range(a.shape[1]))
        got = sorted((r.img_id, r.y, r.x, r.v) for r in p(px).collect())
        assert got == want, name


def test_canny_hysteresis_of_a_chain():
    f = np.zeros((9, 30, 1), np.uint8)
    f[4:, :] = np.linspace(40, 250, 30).astype(np.uint8)[None, :, None]
    out = K.canny(f, 20, 300)
    thin = K.canny_maxima(f)
    assert ((out == 255)[..., 0] <= (thin >= 20)).all() and out.any()


def test_affine_composition():
    a, b = K.rotation_matrix(30, 1, 2), K.translation_matrix(3, 4)
    m = K.compose_affine(a, b)
    x, y = 2.0, 5.0
    ax, ay = a[0] * x + a[1] * y + a[2], a[3] * x + a[4] * y + a[5]
    assert math.isclose(m[0] * x + m[1] * y + m[2], ax - 3) and math.isclose(m[3] * x + m[4] * y + m[5], ay - 4)


def test_batches():
    b = from_arrays([(1, "a", np.zeros((2, 3, 1), np.uint8))])
    assert b.to_pylist() == [{"img_id": 1, "origin": "a", "width": 3, "height": 2, "channels": 1, "data": bytes(6)}]


def masks():
    rng = np.random.default_rng(3)
    yield (rng.random((60, 50)) < 0.55)
    yield (rng.random((40, 70)) < 0.3)
    y, x = np.mgrid[:50, :50]
    yield (np.maximum(abs(y - 25), abs(x - 25)) % 2 == 0) | ((x == 25) & (y < 25))  # rings on a spoke
    snake = np.zeros((33, 47), bool)  # one path that crosses tiles many times
    snake[::2] = True
    snake[1::4, -1] = snake[3::4, 0] = True
    yield snake
    yield np.zeros((9, 9), bool)
    yield np.ones((17, 17), bool)


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components_over_tiles(spark, connectivity):
    """Tiles of 8 x 8 that are joined give what a whole frame gives."""
    from imgspark.frame import SCHEMA, to_pixels
    from imgspark.operators import components as C

    all_ = list(masks())
    fr = spark.createDataFrame([(i, "m", m.shape[1], m.shape[0], 1, bytearray((m * 255).astype(np.uint8).tobytes())) for i, m in enumerate(all_)], SCHEMA)
    got = sorted(tuple(r) for r in C.components_pixels(to_pixels(fr), connectivity=connectivity, tile=8).collect())
    want = sorted((i, *c) for i, m in enumerate(all_) for c in K.components((m * 255).astype(np.uint8)[..., None], connectivity=connectivity))
    assert [g[:7] for g in got] == [w[:7] for w in want] and np.allclose([g[7:] for g in got], [w[7:] for w in want])


def test_canny_over_tiles(spark):
    from imgspark.frame import SCHEMA, from_pixels, to_pixels
    from imgspark.operators import components as C

    y, x = np.mgrid[:45, :61]
    im = ((np.sin(x / 5.0) + np.cos(y / 7.0) + 2) * 50 + (x > 30) * 40).astype(np.uint8)[..., None]
    fr = spark.createDataFrame([(1, "m", 61, 45, 1, bytearray(im.tobytes()))], SCHEMA)
    for low, high in ((20, 90), (5, 60), (90, 20)):
        got = from_pixels(C.canny_pixels(to_pixels(fr), low, high, tile=8)).first()
        assert bytes(got.data) == K.canny(im, low, high).tobytes()


@pytest.mark.parametrize(("w", "h"), [(5, 3), (13, 11), (24, 30), (1, 1)])
def test_resizing_pixels_of_any_ratio(spark, w, h):
    from imgspark.frame import SCHEMA, from_pixels, to_pixels

    rng = np.random.default_rng(w)
    ims = [rng.integers(0, 256, (b, a, 3), dtype=np.uint8) for a, b in ((13, 11), (7, 9), (1, 4), (2, 2))]
    fr = spark.createDataFrame([(i, "m", m.shape[1], m.shape[0], 3, bytearray(m.tobytes())) for i, m in enumerate(ims)], SCHEMA)
    px = to_pixels(fr).cache()
    for f, g in ((P.resize_nearest, "nearest"), (P.resize_bilinear, "bilinear"), (P.resize_area, "area")):
        got = {r.img_id: bytes(r.data) for r in from_pixels(f(px, w, h)).collect()}
        assert got == {i: K.resize(m, w, h, g).tobytes() for i, m in enumerate(ims)}, g


@pytest.mark.parametrize("matrix", [(1, 0, 0, 0, 1, 0), (0.4, 0.3, 1.5, -0.2, 0.7, 2.0), (2.5, 0, -3, 0, 1.5, 4), (0, -1, 12, 1, 0, 0.25), (1, 2, 0, 2, 4, 1), (1, 1, 0, 1, 1.001, 0), (-1, 0, 9.5, 0, -1, 7.5)])
def test_warping_pixels(spark, matrix):
    """Turned, scaled, sheared, and singular maps; targets beyond the image have the border."""
    from imgspark.frame import SCHEMA, from_pixels, to_pixels

    rng = np.random.default_rng(1)
    ims = [rng.integers(0, 256, (b, a, 3), dtype=np.uint8) for a, b in ((13, 11), (4, 9), (1, 1))]
    fr = spark.createDataFrame([(i, "m", m.shape[1], m.shape[0], 3, bytearray(m.tobytes())) for i, m in enumerate(ims)], SCHEMA)
    got = {r.img_id: bytes(r.data) for r in from_pixels(P.warp_affine(to_pixels(fr), matrix, 15, 12, 9)).collect()}
    assert got == {i: K.warp_affine(m, matrix, 15, 12, 9).tobytes() for i, m in enumerate(ims)}
