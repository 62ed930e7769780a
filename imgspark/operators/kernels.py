"""Frame kernels in numpy: arrays of height x width x channels, unsigned bytes.

Each takes and returns whole frames, so they run inside Arrow batches without a shuffle.
"""

from __future__ import annotations

import math

import numpy as np

from imgspark.functions.semantics import GRAY, gamma_table, gaussian3_weights, gaussian_weights, half_up, np_half_up, np_trunc

I32 = np.int32


def need(frame: np.ndarray, *channels: int) -> None:
    if frame.shape[2] not in channels:
        raise ValueError(f"expected {' or '.join(map(str, channels))} channels, got {frame.shape[2]}")


# ---- points


def grayscale(f):
    need(f, 3, 4)
    r, g, b = (f[..., i].astype(I32) for i in range(3))
    return ((GRAY[0] * r + GRAY[1] * g + GRAY[2] * b) >> 8).astype(np.uint8)[..., None]


def threshold(f, value=128):
    need(f, 1)
    return np.where(f >= value, 255, 0).astype(np.uint8)


def point_table(f, table, gray_only=False):
    """Bytes looked up in a table of 256."""
    if gray_only:
        need(f, 1)
    return np.frombuffer(table, np.uint8)[f]


def gray_to_rgb(f):
    need(f, 1)
    return np.repeat(f, 3, 2)


def to_rgb(f):
    if f.shape[2] == 3:
        return f
    return gray_to_rgb(f)


def invert(f):
    return 255 - f


def brightness_contrast(f, brightness=0.0, contrast=1.0):
    i = np.arange(256, dtype=np.float64)
    return np_trunc((i - 128) * contrast + 128 + brightness)[f]


def gamma(f, value):
    return np.array(gamma_table(value), np.uint8)[f]


def extract_channel(f, c):
    if not 0 <= c < f.shape[2]:
        raise ValueError("no such channel")
    return f[..., c : c + 1]


def rgb_to_hsv(f):
    need(f, 3, 4)
    r, g, b = (f[..., i] / 255.0 for i in range(3))
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    d = top - low
    safe = np.where(d == 0, 1.0, d)
    h = np.where(top == r, np.fmod((g - b) / safe, 6.0), np.where(top == g, (b - r) / safe + 2, (r - g) / safe + 4)) * 60
    h = np.where(d == 0, 0.0, np.where(h < 0, h + 360, h))
    s = np.where(top == 0, 0.0, d / np.where(top == 0, 1.0, top))
    return np.stack([np_half_up(h * 179 / 360), np_half_up(s * 255), np_half_up(top * 255)], 2)


def hsv_to_rgb(f):
    need(f, 3)
    h, s, v = f[..., 0].astype(np.float64) * 360 / 179, f[..., 1] / 255.0, f[..., 2] / 255.0
    c = v * s
    x = c * (1 - np.abs(np.fmod(h / 60, 2.0) - 1))
    m, z = v - c, np.zeros_like(c)
    pick = np.minimum(np.floor(h / 60), 5).astype(int)
    r = np.choose(pick, [c, x, z, z, x, c])
    g = np.choose(pick, [x, c, c, x, z, z])
    b = np.choose(pick, [z, z, x, c, c, x])
    return np.stack([np_half_up((q + m) * 255) for q in (r, g, b)], 2)


def _mask(ok):
    return np.where(ok, 255, 0).astype(np.uint8)[..., None]


def in_range_gray(f, low, high):
    need(f, 1)
    return _mask((f[..., 0] >= low) & (f[..., 0] <= high))


def in_range_rgb(f, r=None, g=None, b=None):
    need(f, 3, 4)
    ok = np.ones(f.shape[:2], bool)
    for i, lim in enumerate((r, g, b)):
        if lim is not None:
            ok &= (f[..., i] >= lim[0]) & (f[..., i] <= lim[1])
    return _mask(ok)


def in_range_hsv(f, h=None, s=None, v=None):
    need(f, 3)
    ok = np.ones(f.shape[:2], bool)
    for i, lim in enumerate((h, s, v)):
        if lim is None:
            continue
        above, below = f[..., i] >= lim[0], f[..., i] <= lim[1]
        ok &= (above | below) if i == 0 and lim[0] > lim[1] else (above & below)
    return _mask(ok)


# ---- geometry


def crop(f, x, y, width, height):
    if x < 0 or y < 0 or width <= 0 or height <= 0 or x + width > f.shape[1] or y + height > f.shape[0]:
        raise ValueError("crop out of bounds")
    return f[y : y + height, x : x + width]


def crop_around(f, x, y, width, height, halo):
    """The crop with a border of up to halo, as far as the frame goes."""
    crop(f, x, y, width, height)  # the same errors
    return f[max(0, y - halo) : y + height + halo, max(0, x - halo) : x + width + halo]


def flip_h(f):
    return f[:, ::-1]


def flip_v(f):
    return f[::-1]


def rotate90(f):
    return np.rot90(f, -1)


def rotate180(f):
    return f[::-1, ::-1]


def rotate270(f):
    return np.rot90(f, 1)


def _size(f, width, height):
    if width <= 0 or height <= 0:
        raise ValueError("size must be positive")
    return f.shape[1], f.shape[0]


def nearest_axis(n, target):
    return np.minimum(n - 1, np.arange(target) * n // target)


def resize_nearest(f, width, height):
    w, h = _size(f, width, height)
    return f[nearest_axis(h, height)][:, nearest_axis(w, width)]


def bilinear_axis(n, target):
    """(first tap, second tap, weight of the second) along one side; weights may leave 0..1 at the border."""
    at = (np.arange(target) + 0.5) * n / target - 0.5
    first = np.maximum(0, np.floor(at)).astype(int)
    return first, np.minimum(n - 1, first + 1), at - first


def bilinear_taps(f, rows, columns):
    """rows, columns: places of f and weights, as of bilinear_axis."""
    (y0, y1, wy), (x0, x1, wx) = rows, columns
    wx, wy = wx[None, :, None], wy[:, None, None]
    d = f.astype(np.float64)
    top, low = d[y0], d[y1]
    return np_trunc(top[:, x0] * ((1 - wx) * (1 - wy)) + top[:, x1] * (wx * (1 - wy)) + low[:, x0] * ((1 - wx) * wy) + low[:, x1] * (wx * wy))


def resize_bilinear(f, width, height):
    w, h = _size(f, width, height)
    return bilinear_taps(f, bilinear_axis(h, height), bilinear_axis(w, width))


def overlap(n, target):
    """(target, n) lengths that cell t shares with pixel s."""
    return overlap_part(n, target, 0, target, 0, n)


def overlap_part(n, target, start, stop, origin, size):
    """The same of the cells from start to stop, and of size pixels from origin on."""
    t, s, step = np.arange(start, stop)[:, None], np.arange(origin, origin + size)[None, :], n / target
    return np.maximum(0.0, np.minimum((t + 1) * step, s + 1) - np.maximum(t * step, s))


def resize_area(f, width, height):
    w, h = _size(f, width, height)
    if width >= w or height >= h:
        return resize_bilinear(f, width, height)
    ox, oy = overlap(w, width), overlap(h, height)
    total = np.einsum("ys,tx,sxc->ytc", oy, ox, f.astype(np.float64), optimize=True)
    return np_half_up(total / (oy.sum(1)[:, None, None] * ox.sum(1)[None, :, None]))


def area_part(f, y0, x0, h, w, at, width, height):
    """Of an h x w frame resized by area, the targets of the box at, from the part f of it that starts at (y0, x0)."""
    top, left, bottom, right = at
    oy, ox = overlap_part(h, height, top, bottom, y0, f.shape[0]), overlap_part(w, width, left, right, x0, f.shape[1])
    total = np.einsum("ys,tx,sxc->ytc", oy, ox, f.astype(np.float64), optimize=True)
    return np_half_up(total / (oy.sum(1)[:, None, None] * ox.sum(1)[None, :, None]))


METHODS = {"nearest": resize_nearest, "bilinear": resize_bilinear, "area": resize_area}


def resize(f, width, height, method="bilinear"):
    if method not in METHODS:
        raise ValueError(f"unknown resize method {method}")
    return METHODS[method](f, width, height)


def resolve_size(w, h, width=None, height=None, fit="exact"):
    """Target size: one side keeps the aspect; contain and cover scale by the least or largest ratio."""
    if width is None and height is None:
        raise ValueError("width or height is needed")
    if fit == "exact":
        if width is None:
            width = max(1, half_up(w * (height / h)))
        elif height is None:
            height = max(1, half_up(h * (width / w)))
        return width, height
    if width is None or height is None:
        raise ValueError("contain and cover need both sides")
    scale = (min if fit == "contain" else max)(width / w, height / h)
    return max(1, half_up(w * scale)), max(1, half_up(h * scale))


def resize_fit(f, width=None, height=None, fit="exact", method="bilinear"):
    return resize(f, *resolve_size(f.shape[1], f.shape[0], width, height, fit), method)


def scale(f, factor, method="bilinear"):
    return resize(f, max(1, half_up(f.shape[1] * factor)), max(1, half_up(f.shape[0] * factor)), method)


def q15_axis(n, target):
    first, second, weight = bilinear_axis(n, target)
    return first, second, np.trunc(weight * 32768 + 0.5).astype(np.int64)


def q15_taps(f, rows, columns):
    (y0, y1, qy), (x0, x1, qx) = rows, columns
    qx, qy, d = qx[None, :, None], qy[:, None, None], f.astype(np.int64)
    top = (d[y0][:, x0] * (32768 - qx) + d[y0][:, x1] * qx + 16384) >> 15
    low = (d[y1][:, x0] * (32768 - qx) + d[y1][:, x1] * qx + 16384) >> 15
    return np.clip((top * (32768 - qy) + low * qy + 16384) >> 15, 0, 255).astype(np.uint8)


def resize_q15(f, width, height):
    """Bilinear in fixed point: weights and each of the two passes rounded at 15 bits."""
    w, h = _size(f, width, height)
    return q15_taps(f, q15_axis(h, height), q15_axis(w, width))


def resize_auto(f, width, height):
    """Area where both sides shrink below a half, else fixed-point bilinear."""
    if width / f.shape[1] < 0.5 and height / f.shape[0] < 0.5:
        return resize_area(f, width, height)
    return resize_q15(f, width, height)


def rotation_matrix(degrees, cx, cy, factor=1.0):
    """Inverse map of a rotation; a factor over 1 shrinks, as it scales the inverse map."""
    a = math.radians(degrees)
    c, s = math.cos(a) * factor, math.sin(a) * factor
    return (c, s, cx * (1 - c) - cy * s, -s, c, cy * (1 - c) + cx * s)


def translation_matrix(tx, ty):
    return (1.0, 0.0, -float(tx), 0.0, 1.0, -float(ty))


def scale_matrix(sx, sy, cx=0.0, cy=0.0):
    return (1 / sx, 0.0, cx * (1 - 1 / sx), 0.0, 1 / sy, cy * (1 - 1 / sy))


def compose_affine(a, b):
    """The map that applies a, then b, to target coordinates."""
    return (
        b[0] * a[0] + b[1] * a[3], b[0] * a[1] + b[1] * a[4], b[0] * a[2] + b[1] * a[5] + b[2],
        b[3] * a[0] + b[4] * a[3], b[3] * a[1] + b[4] * a[4], b[3] * a[2] + b[4] * a[5] + b[5],
    )


def warp_affine(f, matrix, width=None, height=None, border=0):
    h, w = f.shape[:2]
    return warp_part(f, 0, 0, h, w, (0, 0, height or h, width or w), matrix, border)


def warp_part(f, y0, x0, h, w, box, matrix, border=0):
    """The targets of box (top, left, bottom, right) of a warp of an h x w image; f is the part of it at (y0, x0) that holds
    all of their taps."""
    top, left, bottom, right = box
    a, b, c, d, e, g = matrix
    x, y = np.meshgrid(np.arange(left, right, dtype=np.float64), np.arange(top, bottom, dtype=np.float64))
    sx, sy = a * x + b * y + c, d * x + e * y + g
    fx, fy = np.floor(sx).astype(np.int64), np.floor(sy).astype(np.int64)
    wx, wy = (sx - fx)[..., None], (sy - fy)[..., None]

    def tap(px, py):
        ok = (px >= 0) & (px < w) & (py >= 0) & (py < h)
        return np.where(ok[..., None], f[np.clip(py - y0, 0, f.shape[0] - 1), np.clip(px - x0, 0, f.shape[1] - 1)], border).astype(np.float64)

    return np_trunc(tap(fx, fy) * (1 - wx) * (1 - wy) + tap(fx + 1, fy) * wx * (1 - wy) + tap(fx, fy + 1) * (1 - wx) * wy + tap(fx + 1, fy + 1) * wx * wy)


# ---- neighbourhoods


def shifted(a, k, axis):
    """a at i + k with the border repeated."""
    n = a.shape[axis]
    return np.take(a, np.clip(np.arange(n) + k, 0, n - 1), axis)


def convolve(f, kernel, kw, kh):
    """Correlation with a repeated border."""
    if kw % 2 == 0 or kh % 2 == 0 or len(kernel) != kw * kh:
        raise ValueError("the kernel needs odd sides and kw * kh values")
    d = np.pad(f, ((kh // 2,) * 2, (kw // 2,) * 2, (0, 0)), "edge").astype(np.float64)
    out, part = np.zeros(f.shape), np.empty(f.shape)
    for i, k in enumerate(kernel):
        if k:  # a tap of 0 adds nothing
            out += np.multiply(d[i // kw : i // kw + f.shape[0], i % kw : i % kw + f.shape[1]], k, out=part)
    return np_trunc(out)


def sharpen(f, strength=1.0):
    s = strength
    return convolve(f, [0, -s, 0, -s, 1 + 4 * s, -s, 0, -s, 0], 3, 3)


def _window_sum(a, r, axis):
    """(sum, count) over the window cut at the border."""
    n = a.shape[axis]
    i = np.arange(n)
    lo, hi = np.maximum(0, i - r), np.minimum(n, i + r + 1)
    c = np.cumsum(a, axis)
    c = np.concatenate([np.zeros_like(np.take(c, [0], axis)), c], axis)
    count = (hi - lo).reshape([-1 if k == axis else 1 for k in range(a.ndim)])
    return np.take(c, hi, axis) - np.take(c, lo, axis), count


def box_blur(f, radius=1, mode="mean"):
    """mode="mean" averages the window cut at the border, rows then columns; "compat" keeps r copies
    of each row's first pixel and repeats its last in the row pass, and wraps at 256."""
    if radius < 1:
        return f.copy()
    s, n = _window_sum(f.astype(np.int64), radius, 1)
    if mode == "compat":
        w = f.shape[1]
        x = np.arange(w)
        over = np.minimum(x, np.maximum(0, x + radius - (w - 1)))[None, :, None]
        s = s + radius * f[:, :1].astype(np.int64) + over * f[:, -1:].astype(np.int64)
    first = np.floor(s / n + 0.5).astype(np.int64) % 256
    s, n = _window_sum(first, radius, 0)
    return (np.floor(s / n + 0.5).astype(np.int64) % 256).astype(np.uint8)


def _taps(a, weights, axis):
    r, out = len(weights) // 2, np.zeros(a.shape)
    for i, w in enumerate(weights):
        out = out + shifted(a, i - r, axis) * w
    return out


def _blur3(a, sigma, axis):
    centre, side = gaussian3_weights(sigma)
    n = a.shape[axis]
    if n == 1:
        return np_trunc(a * (centre + side) + a * side)
    left, right = shifted(a, -1, axis), shifted(a, 1, axis)
    inner = left * side + a * centre + right * side
    at = lambda x, i: np.take(x, [i], axis)
    first = at(a, 0) * (centre + side) + at(a, 1) * side
    last = at(a, n - 2) * side + at(a, n - 1) * (centre + side)
    return np_trunc(np.concatenate([first, np.take(inner, np.arange(1, n - 1), axis), last], axis))


def gaussian_blur(f, radius=1, sigma=None):
    """Gray at radius 1 has a filter of its own; all else the sampled weights. Bytes after each pass."""
    if radius <= 0:
        return f.copy()
    if f.shape[2] == 1 and radius == 1:
        return _blur3(_blur3(f.astype(np.float64), sigma, 1).astype(np.float64), sigma, 0)
    return gaussian_blur_taps(f, radius, sigma)


def gaussian_blur_taps(f, radius=1, sigma=None):
    if radius <= 0:
        return f.copy()
    w = gaussian_weights(radius, sigma)
    return np_trunc(_taps(np_trunc(_taps(f.astype(np.float64), w, 1)).astype(np.float64), w, 0))


def _gradients(a):
    """(gx, gy) of the inner pixels."""
    a = a.astype(I32)
    tl, tc, tr, ml, mr, bl, bc, br = a[:-2, :-2], a[:-2, 1:-1], a[:-2, 2:], a[1:-1, :-2], a[1:-1, 2:], a[2:, :-2], a[2:, 1:-1], a[2:, 2:]
    return tr - tl + 2 * (mr - ml) + br - bl, bl - tl + 2 * (bc - tc) + br - tr


def sobel(f):
    need(f, 1)
    out = np.zeros_like(f)
    if min(f.shape[:2]) >= 3:
        gx, gy = _gradients(f[..., 0])
        out[1:-1, 1:-1, 0] = np.minimum(255, np.abs(gx) + np.abs(gy))
    return out


def _extreme(a, r, axis, least):
    """Sliding minimum or maximum in about log2(r) steps: windows of doubling length."""
    pick, n = (np.minimum if least else np.maximum), 2 * r + 1
    pad = np.take(a, np.clip(np.arange(-r, a.shape[axis] + r), 0, a.shape[axis] - 1), axis)
    span, size = pad, 1
    while size * 2 <= n:
        m = span.shape[axis]
        span, size = pick(np.take(span, np.arange(m - size), axis), np.take(span, np.arange(size, m), axis)), size * 2
    m = a.shape[axis]
    return pick(np.take(span, np.arange(m), axis), np.take(span, np.arange(n - size, n - size + m), axis))


def erode(f, radius=1):
    need(f, 1)
    return f.copy() if radius < 1 else _extreme(_extreme(f, radius, 1, True), radius, 0, True)


def dilate(f, radius=1):
    need(f, 1)
    return f.copy() if radius < 1 else _extreme(_extreme(f, radius, 1, False), radius, 0, False)


def open_(f, radius=1):
    return dilate(erode(f, radius), radius)


def close(f, radius=1):
    return erode(dilate(f, radius), radius)


def morph_gradient(f, radius=1):
    return dilate(f, radius) - erode(f, radius)


def top_hat(f, radius=1):
    return np.maximum(0, f.astype(I32) - open_(f, radius)).astype(np.uint8)


def black_hat(f, radius=1):
    return np.maximum(0, close(f, radius).astype(I32) - f).astype(np.uint8)


def adaptive_threshold(f, block_size=15, c=5, invert=False, method="mean"):
    need(f, 1)
    size = max(3, block_size)
    r = (size + 1 - size % 2) // 2
    if method == "mean":
        rows, nx = _window_sum(f.astype(np.int64), r, 1)
        s, ny = _window_sum(rows, r, 0)
        mean = s / (nx * ny)
    else:
        w = gaussian_weights(r, r / 3)
        mean = _taps(_taps(f.astype(np.float64), w, 1), w, 0)
    return np.where((f > mean - c) != invert, 255, 0).astype(np.uint8)


def canny_maxima(f, radius=1, sigma=None):
    """Gradient magnitude (float32) where it is not below both neighbours along its direction, else 0."""
    need(f, 1)
    h, w = f.shape[:2]
    mag, way = np.zeros((h, w), np.float32), np.zeros((h, w), np.int8)
    if min(h, w) >= 3:
        gx, gy = _gradients(gaussian_blur(f, radius, sigma)[..., 0])
        mag[1:-1, 1:-1] = np.sqrt((gx * gx + gy * gy).astype(np.float64))
        angle = np.arctan2(np.abs(gy), np.abs(gx)) * 180 / np.pi
        way[1:-1, 1:-1] = np.where(angle < 22.5, 0, np.where(angle < 67.5, 1, 2))
    out = np.zeros_like(mag)
    m = mag[1:-1, 1:-1]
    ahead = np.choose(way[1:-1, 1:-1], [mag[1:-1, 2:], mag[:-2, 2:], mag[:-2, 1:-1]]) if m.size else m
    behind = np.choose(way[1:-1, 1:-1], [mag[1:-1, :-2], mag[2:, :-2], mag[2:, 1:-1]]) if m.size else m
    out[1:-1, 1:-1] = np.where((m >= ahead) & (m >= behind), m, 0)
    return out


def canny(f, low=50, high=150, radius=1, sigma=None):
    thin = canny_maxima(f, radius, sigma)
    hot = thin >= high
    found = labels(hot | (thin >= low))
    lit = np.zeros(found.max(initial=-1) + 2, bool)  # the last one stands for -1, outside
    lit[found[hot]] = True
    return np.where(lit[found], 255, 0).astype(np.uint8)[..., None]


# ---- aggregates


def histogram(f):
    return np.stack([np.bincount(f[..., c].ravel(), minlength=256) for c in range(f.shape[2])])


def equalize(f):
    need(f, 1)
    cdf = histogram(f)[0].cumsum()
    least, n = int(cdf[cdf > 0][0]), f.size
    if n == least:
        return np.zeros_like(f)
    return np_trunc(np.floor((cdf - least) / (n - least) * 255 + 0.5))[f]


def normalize(f):
    lo, hi = f.min((0, 1)).astype(np.float64), f.max((0, 1)).astype(np.float64)
    return np_trunc((f - lo) / np.where(hi == lo, 1.0, hi - lo) * 255)


def integral(f):
    need(f, 1)
    out = np.zeros((f.shape[0] + 1, f.shape[1] + 1))
    out[1:, 1:] = f[..., 0].cumsum(0, dtype=np.float64).cumsum(1)
    return out


def sum_rect(table, x, y, width, height):
    return table[y + height, x + width] - table[y, x + width] - table[y + height, x] + table[y, x]


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of all that 0..n-1 are connected with by edges (a, b): larger roots hook onto smaller
    ones, then all point to their roots; each round joins what is left."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        left = ra != rb
        if not left.any():
            return root
        a, b, ra, rb = a[left], b[left], ra[left], rb[left]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root != root[root]).any():
            root = root[root]


def run_labels(on: np.ndarray, connectivity: int = 8):
    """(y, first, last + 1, component) of every run of set pixels in a row; components are numbered in
    raster order of their first pixels."""
    h, w = on.shape
    framed = np.zeros((h, w + 2), np.int8)
    framed[:, 1:-1] = on
    step = np.diff(framed, axis=1)
    (y, a), (_, b) = np.nonzero(step == 1), np.nonzero(step == -1)
    reach = 1 if connectivity == 8 else 0
    below = (y + 1) * (w + 2)
    # runs of the next row that touch: those that end after this one begins and begin before it ends
    lo = np.searchsorted(y * (w + 2) + b, below + a - reach, "right")
    hi = np.searchsorted(y * (w + 2) + a, below + b + reach, "left")
    n = np.maximum(hi - lo, 0)
    upper = np.repeat(np.arange(len(a)), n)
    lower = np.repeat(lo, n) + np.arange(len(upper)) - np.repeat(np.cumsum(n) - n, n)
    return y, a, b, np.unique(joined(len(a), upper, lower), return_inverse=True)[1]


def labels(on: np.ndarray, connectivity: int = 8) -> np.ndarray:
    """The component of every set pixel, -1 elsewhere."""
    _, a, b, which = run_labels(on, connectivity)
    out = np.full(on.shape, -1)
    out[on] = np.repeat(which, b - a)
    return out


def components(f, min_area=1, max_area=None, connectivity=8):
    """(id, x, y, width, height, area, centroid_x, centroid_y) of each component, ids in raster order
    of first pixels and given before the area filter."""
    need(f, 1)
    y, a, b, which = run_labels(f[..., 0] > 0, connectivity)
    m = which.max(initial=-1) + 1
    size = b - a

    def total(v):
        out = np.zeros(m, np.int64)
        np.add.at(out, which, v)
        return out

    def extreme(f, v, start):
        out = np.full(m, start)
        f.at(out, which, v)
        return out

    far = max(on_side for on_side in f.shape)
    x0, y0 = extreme(np.minimum, a, far), extreme(np.minimum, y, far)
    x1, y1 = extreme(np.maximum, b, 0), extreme(np.maximum, y + 1, 0)
    area, sx, sy = total(size), total((a + b - 1) * size // 2), total(y * size)
    rows = zip(range(m), x0.tolist(), y0.tolist(), (x1 - x0).tolist(), (y1 - y0).tolist(), area.tolist(), (sx / np.maximum(area, 1)).tolist(), (sy / np.maximum(area, 1)).tolist())
    return [r for r in rows if r[5] >= min_area and (max_area is None or r[5] <= max_area)]


# ---- drawing


def colour_values(channels, colour):
    """Values by channel, modulo 256: gray, then r, then 255 for one channel; r 255, g 0, b 0, a 255 else."""
    c = colour or {}
    if channels == 1:
        return [int(c.get("gray", c.get("r", 255))) % 256]
    return [int(c.get(k, d)) % 256 for k, d in (("r", 255), ("g", 0), ("b", 0), ("a", 255))][:channels]


def line_points(x0, y0, x1, y1):
    x0, y0, x1, y1 = (half_up(v) for v in (x0, y0, x1, y1))
    dx, dy, sx, sy = abs(x1 - x0), abs(y1 - y0), 1 if x0 < x1 else -1, 1 if y0 < y1 else -1
    err = dx - dy
    while True:
        yield x0, y0
        if (x0, y0) == (x1, y1):
            return
        twice = 2 * err
        if twice > -dy:
            err, x0 = err - dy, x0 + sx
        if twice < dx:
            err, y0 = err + dx, y0 + sy


def circle_points(cx, cy, radius):
    cx, cy, x, y, err = half_up(cx), half_up(cy), max(0, half_up(radius)), 0, 0
    while x >= y:
        for a, b in ((x, y), (y, x)):
            for i in (1, -1):
                for j in (1, -1):
                    yield cx + i * a, cy + j * b
        y += 1
        if err <= 0:
            err += 2 * y + 1
        if err > 0:
            x -= 1
            err -= 2 * x + 1


def rect_points(x, y, width, height):
    x0, y0, x1, y1 = half_up(x), half_up(y), half_up(x + width - 1), half_up(y + height - 1)
    for a in ((x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0)):
        yield from line_points(*a)


def brushed(points, thickness=1):
    """Every point with a square of floor(thickness / 2) around it."""
    r = int(thickness) // 2
    return {(x + i, y + j) for x, y in points for i in range(-r, r + 1) for j in range(-r, r + 1)}


def paint(f, points, colour=None):
    out, c = f.copy(), colour_values(f.shape[2], colour)
    for x, y in points:
        if 0 <= x < f.shape[1] and 0 <= y < f.shape[0]:
            out[y, x] = c
    return out


def draw_point(f, x, y, colour=None, thickness=1):
    return paint(f, brushed([(half_up(x), half_up(y))], thickness), colour)


def draw_line(f, x0, y0, x1, y1, colour=None, thickness=1):
    return paint(f, brushed(line_points(x0, y0, x1, y1), thickness), colour)


def draw_rect(f, x, y, width, height, colour=None, thickness=2):
    return paint(f, brushed(rect_points(x, y, width, height), thickness), colour)


def draw_filled_rect(f, x, y, width, height, colour=None):
    out = f.copy()
    ends = max(0, half_up(y + height - 1) + 1), max(0, half_up(x + width - 1) + 1)
    out[max(0, half_up(y)) : ends[0], max(0, half_up(x)) : ends[1]] = colour_values(f.shape[2], colour)
    return out


def draw_circle(f, cx, cy, radius, colour=None, thickness=1):
    return paint(f, brushed(circle_points(cx, cy, radius), thickness), colour)


def draw_filled_circle(f, cx, cy, radius, colour=None):
    y, x = np.ogrid[: f.shape[0], : f.shape[1]]
    out = f.copy()
    out[(x - half_up(cx)) ** 2 + (y - half_up(cy)) ** 2 <= max(0, half_up(radius)) ** 2] = colour_values(f.shape[2], colour)
    return out


def draw_boxes(f, boxes, colour=None, thickness=2):
    for x, y, width, height in boxes:
        f = draw_rect(f, x, y, width, height, colour, thickness)
    return f


# ---- fused steps


def binomial_edges(f):
    """3x3 binomial blur in whole numbers, >> 4, then edges; zeros for frames under 3 pixels."""
    need(f, 1)
    if min(f.shape[:2]) < 3:
        return np.zeros_like(f)
    a = f.astype(I32)
    row = shifted(a, -1, 1) + 2 * a + shifted(a, 1, 1)
    return sobel(((shifted(row, -1, 0) + 2 * row + shifted(row, 1, 0)) >> 4).astype(np.uint8))


def gray_binomial_edges(f):
    return binomial_edges(grayscale(f))


def gray_threshold(f, value=128):
    return threshold(grayscale(f), value)


def gray_threshold_erode(f, value=128, radius=1):
    return erode(gray_threshold(f, value), radius)


def blur_edges(f, radius=1, sigma=None):
    need(f, 1)
    return sobel(gaussian_blur(f, radius, sigma))
