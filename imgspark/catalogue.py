"""All queries of the image engine over the derived frames, with their SQL for DuckDB.

The SQL states each operator in its own way (joins on clamped coordinates where the engine uses
tiles), so that the two sides check each other.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from imgspark import fixtures as X
from imgspark.catalogue_files import FILE_QUERIES, file_sql
from imgspark.catalogue_more import MORE, more_sql
from imgspark.frame import from_pixels, map_frames, to_pixels
from imgspark.functions.semantics import gamma_table, gaussian3_weights, gaussian_weights
from imgspark.operators import kernels as K
from imgspark.operators import pixels as P
from imgspark.plans.pipeline import Plan

SHARP = [0, -1, 0, -1, 5, -1, 0, -1, 0]
EDGE5 = [1, 0, -1, 0, 1, 2, 1, 0, -1, -2, 3, 2, 1, -2, -3, -1, 0, 1, 2, -2, 1, 1, -1, 0, 0]
ROT = K.rotation_matrix(30, 3.5, 3.5, 1.25)
RED, TEAL = {"r": 255, "g": 0, "b": 0}, {"r": 300, "g": -56, "b": 128}


def _gray(f, name="gray8"):
    return lambda spark, d: f(getattr(X, name)(spark, d))


def _wide(f, name="rgb8"):
    return lambda spark, d: f(getattr(X, name)(spark, d))


def _long(f):
    return lambda spark, d: f(X.long3(X.rgb8(spark, d)))


def _to_rgb(spark, d):
    """Frames of one and of three channels together."""
    gray = from_pixels(X.gray8(spark, d)).withColumn("img_id", -1 - F.col("img_id"))
    return to_pixels(map_frames(gray.unionByName(from_pixels(X.long3(X.rgb8(spark, d)))), K.to_rgb))


def _planned(plan, name):
    """A plan over frames, fused as it is run."""
    return lambda spark, d: to_pixels(plan.run(from_pixels(X.long3(X.rgb8(spark, d)) if name == "rgb8" else getattr(X, name)(spark, d))))


#: Plans of the fused steps; what they fuse to is in tests/test_kernels.py.
PLANS = {
    "l_gt": (Plan().grayscale().threshold(128), "rgb8"),
    "l_gte": (Plan().grayscale().threshold(128).erode(1), "rgb8"),
    "l_be": (Plan().blur(1).edges(), "gray8"),
    "l_gbe": (Plan().grayscale().blur(1).edges(), "rgb8"),
    "l_bte": (Plan().blur(2).edges(), "ev16"),
    "l_point_table": (Plan().brightness_contrast(12.5, 1.4).gamma(2.2).invert(), "rgb8"),
    "l_crop_first": (Plan().blur(2).edges().crop(1, 3, 9, 6), "ev16"),
    "l_channel_first": (Plan().sharpen(1.0).invert().extract_channel(1), "rgb8"),
}

QUERIES = {
    "p_grayscale": _wide(P.grayscale),
    "p_grayscale_rgba": _wide(P.grayscale, "rgba8"),
    "p_threshold": _gray(lambda p: P.threshold(p, 100)),
    "p_gray_to_rgb": _gray(P.gray_to_rgb),
    "p_to_rgb": _to_rgb,
    "p_invert": lambda s, d: P.invert(X.long3(X.rgba8(s, d), "rgba")),
    "p_brightness_contrast": _long(lambda p: P.brightness_contrast(p, 12.5, 1.4)),
    "p_gamma": _long(lambda p: P.gamma(p, 2.2)),
    "p_extract_channel": _long(lambda p: P.extract_channel(p, 1)),
    "p_rgb_to_hsv": _wide(P.rgb_to_hsv),
    "p_hsv_to_rgb": lambda s, d: P.hsv_to_rgb(P.wide(P.rgb_to_hsv(X.rgb8(s, d)))),
    "p_in_range_gray": _gray(lambda p: P.in_range_gray(p, 60, 180)),
    "p_in_range_rgb": _wide(lambda p: P.in_range_rgb(p, r=(40, 200), b=(0, 128))),
    "p_in_range_hsv": lambda s, d: P.in_range_hsv(P.wide(P.rgb_to_hsv(X.rgb8(s, d))), h=(20, 120), s=(50, 255)),
    "p_in_range_hsv_wrap": lambda s, d: P.in_range_hsv(P.wide(P.rgb_to_hsv(X.rgb8(s, d))), h=(150, 30), v=(60, 255)),
    "p_dims": lambda s, d: X.ev16(s, d).groupBy("img_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), (F.max("c") + 1).alias("channels")),
    "g_crop": _gray(lambda p: P.crop(p, 2, 1, 5, 4)),
    "g_flip_h": _gray(P.flip_h),
    "g_flip_v": _gray(P.flip_v),
    "g_rotate90": lambda s, d: P.rotate90(X.pairs(X.gray8(s, d))),
    "g_rotate180": lambda s, d: P.rotate180(X.pairs(X.gray8(s, d))),
    "g_rotate270": lambda s, d: P.rotate270(X.pairs(X.gray8(s, d))),
    "g_resize_nearest": _gray(lambda p: P.resize_nearest(p, 5, 11)),
    "g_resize_bilinear": _long(lambda p: P.resize_bilinear(p, 11, 5)),
    "g_resize_area": _gray(lambda p: P.resize_area(p, 4, 8), "ev16"),
    "g_resize_q15": _gray(lambda p: P.resize_q15(p, 11, 5)),
    "g_warp_affine": _gray(lambda p: P.warp_affine(p, ROT, 10, 7, 9)),
    "n_convolve": _gray(lambda p: P.convolve(p, EDGE5, 5, 5)),
    "n_sharpen": _long(lambda p: P.sharpen(p, 1.0)),
    "n_box_blur_mean": _gray(lambda p: P.box_blur(p, 2), "ev16"),
    "n_box_blur_compat": _gray(lambda p: P.box_blur(p, 2, "compat")),
    "n_gaussian_r1": _gray(P.gaussian3),
    "n_gaussian_r2": _gray(lambda p: P.gaussian_taps(p, 2), "ev16"),
    "n_gaussian_rgb": _long(lambda p: P.gaussian_taps(p, 1)),
    "n_gaussian_parallel": _gray(lambda p: P.gaussian_taps(p, 1, 1.5)),
    "n_sobel": _gray(P.sobel),
    "n_erode": _gray(lambda p: P.erode(p, 1)),
    "n_dilate": _gray(lambda p: P.dilate(p, 2), "ev16"),
    "n_open": _gray(P.open_),
    "n_close": _gray(P.close),
    "n_morph_gradient": _gray(P.morph_gradient),
    "n_top_hat": _gray(P.top_hat, "ev16"),
    "n_black_hat": _gray(P.black_hat),
    "n_adaptive_mean": _gray(lambda p: P.adaptive_threshold(p, 4, 5), "ev16"),
    "n_adaptive_mean_invert": _gray(lambda p: P.adaptive_threshold(p, 3, 2, True)),
    "n_adaptive_gaussian": _gray(lambda p: P.adaptive_threshold(p, 5, 5, method="gaussian"), "ev16"),
    "a_histogram": _long(P.histogram),
    "a_equalize": _gray(P.equalize, "ev16"),
    "a_normalize": _long(P.normalize),
    "a_integral": _gray(P.integral),
    "a_sum_rect": _gray(lambda p: P.sum_rect(P.integral(p), 1, 2, 5, 4)),
    "d_point": _gray(lambda p: P.draw_point(p, 1, 2.5, 3, {"gray": 300}, 3)),
    "d_line": _long(lambda p: P.draw_line(p, 3, -1, 1, 6, 4, TEAL, 1)),
    "d_rect": _long(lambda p: P.draw_rect(p, 3, 1, 1, 6, 5, RED, 2)),
    "d_filled_rect": _long(lambda p: P.draw_filled_rect(p, 3, 4, 5, 10, 10, TEAL)),
    "d_circle": _gray(lambda p: P.draw_circle(p, 1, 7, 7, 5, None, 1), "ev16"),
    "d_filled_circle": _long(lambda p: P.draw_filled_circle(p, 3, 3, 4, 3, RED)),
    **{name: _planned(*p) for name, p in PLANS.items()},
    "l_unfused_chain": _wide(lambda p: P.sobel(P.gaussian3(P.grayscale(p)))),
}


# ---- the same in SQL


def sql(body: str, used: str = "gray8", more: str = "") -> str:
    need = {"gray8": ["gray8"], "rgb8": ["gray8", "rgb8"], "rgba8": ["gray8", "rgba8"], "mask8": ["gray8", "mask8"], "ev16": ["ev16"], "rgbl": ["gray8", "rgb8", "rgbl"]}[used]
    ctes = ", ".join(f"{n} AS ({X.CTES[n]})" for n in need)
    return f"WITH {'RECURSIVE ' if 'recursive' in more else ''}{ctes}{', ' + more if more else ''} {body}"


def px(expr: str, src: str = "gray8", more: str = "", c: str = "c", used: str | None = None) -> str:
    return sql(f"SELECT img_id, y, x, {c} AS c, CAST({expr} AS INT) AS v FROM {src}", used or src, more)


def wide3(src: str, *exprs: str) -> str:
    case = " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(exprs))
    return f"SELECT img_id, y, x, c, CAST(CASE c {case} END AS INT) AS v FROM {src}, (SELECT unnest([{', '.join(map(str, range(len(exprs))))}])::INT AS c)"


def T8(e):
    return f"trunc(least(255.0::DOUBLE, greatest(0.0::DOUBLE, {e})))"


def R8(e):
    return f"least(255, greatest(0, floor(({e}) + 0.5::DOUBLE)))"


def D(v):
    return f"{float(v)!r}::DOUBLE"


GRAY = "(77 * r + 150 * g + 29 * b) >> 8"
GRAYW = f"gw AS (SELECT img_id, y, x, 0 AS c, CAST({GRAY} AS INT) AS v FROM rgb8)"
HSV = """hs AS (SELECT img_id, y, x, r / 255.0::DOUBLE AS fr, g / 255.0::DOUBLE AS fg, b / 255.0::DOUBLE AS fb FROM rgb8),
ht AS (SELECT *, greatest(fr, fg, fb) AS t, greatest(fr, fg, fb) - least(fr, fg, fb) AS d FROM hs),
hu AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN t = fr THEN (((fg - fb) / d) % 6.0::DOUBLE) * 60 WHEN t = fg THEN ((fb - fr) / d + 2) * 60 ELSE ((fr - fg) / d + 4) * 60 END AS h0 FROM ht),
hsv AS (SELECT img_id, y, x, CAST(floor((CASE WHEN h0 < 0 THEN h0 + 360 ELSE h0 END) * 179 / 360 + 0.5) AS INT) AS h, CAST(floor((CASE WHEN t = 0 THEN 0 ELSE d / t END) * 255 + 0.5) AS INT) AS s, CAST(floor(t * 255 + 0.5) AS INT) AS w FROM hu)"""
HSV_BACK = """hb AS (SELECT img_id, y, x, h * 360.0::DOUBLE / 179 AS h, w / 255.0::DOUBLE AS v, (w / 255.0::DOUBLE) * (s / 255.0::DOUBLE) AS cc FROM hsv),
hx AS (SELECT *, cc * (1 - abs(((h / 60) % 2.0::DOUBLE) - 1)) AS xx, v - cc AS m, least(5, floor(h / 60)) AS q FROM hb)"""


def back(i):
    pick = (("cc", "xx", "0", "0", "xx", "cc"), ("xx", "cc", "cc", "xx", "0", "0"), ("0", "0", "xx", "cc", "cc", "xx"))[i]
    return f"floor((CASE {' '.join(f'WHEN q = {k} THEN {p}' for k, p in enumerate(pick))} END + m) * 255 + 0.5)"


def near(v: str, k: int, axis: str) -> str:
    other = "y" if axis == "x" else "x"
    w = f"(PARTITION BY img_id, c, {other} ORDER BY {axis})"
    if not k:
        return v
    ends = f"(PARTITION BY img_id, c, {other} ORDER BY {axis} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"coalesce({'lead' if k > 0 else 'lag'}({v}, {abs(k)}) OVER {w}, {'last_value' if k > 0 else 'first_value'}({v}) OVER {ends})"


def tapped(weights, axis, v="v"):
    r = len(weights) // 2
    e = D(0)
    for i, w in enumerate(weights):
        e = f"({e} + {near(v, i - r, axis)} * {D(w)})"
    return e


def gauss(name, src, weights, exact=False):
    wrap = (lambda e: e) if exact else T8
    keep = ", v AS v0" if exact else ""
    return f"{name}h AS (SELECT img_id, y, x, c{keep}, {wrap(tapped(weights, 'x'))} AS v FROM {src}), {name} AS (SELECT img_id, y, x, c{', v0' if exact else ''}, {wrap(tapped(weights, 'y'))} AS v FROM {name}h)"


def gauss3(name, src):
    centre, side = gaussian3_weights()
    c, s, b = D(centre), D(side), D(centre + side)

    def one(axis):
        other = "y" if axis == "x" else "x"
        w = f"OVER (PARTITION BY img_id, c, {other} ORDER BY {axis})"
        left, right = f"lag(v) {w}", f"lead(v) {w}"
        return T8(f"CASE WHEN {left} IS NULL AND {right} IS NULL THEN v * {b} + v * {s} WHEN {left} IS NULL THEN v * {b} + {right} * {s} WHEN {right} IS NULL THEN {left} * {s} + v * {b} ELSE {left} * {s} + v * {c} + {right} * {s} END")

    return f"{name}h AS (SELECT img_id, y, x, c, {one('x')} AS v FROM {src}), {name} AS (SELECT img_id, y, x, c, {one('y')} AS v FROM {name}h)"


def stencil(name, src, taps, n, value):
    """taps: (dy, dx, {column: weight}); coordinates clamped to 0..n-1."""
    cols = list(taps[0][2])
    rows = ", ".join("(" + ", ".join(map(str, (dy, dx, *[t[c] for c in cols]))) + ")" for dy, dx, t in taps)
    sums = ", ".join(f"sum(b.v * k.{c}) AS {c}" for c in cols)
    return f"""{name}s AS (SELECT a.img_id, a.y, a.x, a.c, {sums} FROM {src} a CROSS JOIN (VALUES {rows}) k(dy, dx, {', '.join(cols)})
      JOIN {src} b ON b.img_id = a.img_id AND b.c = a.c AND b.y = greatest(0, least({n - 1}, a.y + k.dy)) AND b.x = greatest(0, least({n - 1}, a.x + k.dx)) GROUP BY ALL),
      {name} AS (SELECT img_id, y, x, c, CAST({value} AS INT) AS v FROM {name}s)"""


SOBEL = [(-1, -1, {"gx": -1, "gy": -1}), (-1, 0, {"gx": 0, "gy": -2}), (-1, 1, {"gx": 1, "gy": -1}), (0, -1, {"gx": -2, "gy": 0}), (0, 1, {"gx": 2, "gy": 0}), (1, -1, {"gx": -1, "gy": 1}), (1, 0, {"gx": 0, "gy": 2}), (1, 1, {"gx": 1, "gy": 1})]
BINOMIAL = [(dy, dx, {"k": (2 - abs(dy)) * (2 - abs(dx))}) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def sobel(name, src, n=8):
    return stencil(name, src, SOBEL, n, f"CASE WHEN x IN (0, {n - 1}) OR y IN (0, {n - 1}) THEN 0 ELSE least(255, abs(gx) + abs(gy)) END")


def kernel(k, kw, kh):
    return [(i // kw - kh // 2, i % kw - kw // 2, {"k": v}) for i, v in enumerate(k)]


def ext(name, src, r, f):
    return f"{name} AS (SELECT a.img_id, a.y, a.x, a.c, {f}(b.v) AS v FROM {src} a JOIN {src} b ON b.img_id = a.img_id AND b.c = a.c AND abs(b.y - a.y) <= {r} AND abs(b.x - a.x) <= {r} GROUP BY ALL)"


def both(name, src, expr, last):
    return f"SELECT s.img_id, s.y, s.x, s.c, CAST({expr} AS INT) AS v FROM {src} s JOIN {last} m USING (img_id, y, x, c)"


def target(src, w, h, W, H):
    return f"grid AS (SELECT DISTINCT img_id, c, ty::INT AS ty, tx::INT AS tx FROM {src}, range({H}) a(ty), range({W}) b(tx)), src AS (SELECT * FROM {src})"


def axis(t, n, N):
    return f"({t} + 0.5::DOUBLE) * {n} / {N} - 0.5::DOUBLE"


def corners(src, n, W, H, final):
    """v00, v10, v01, v11 with wx, wy; the final select."""
    return f"""{target(src, n, n, W, H)},
      pnt AS (SELECT *, {axis('tx', n, W)} AS fx, {axis('ty', n, H)} AS fy FROM grid),
      pos AS (SELECT *, greatest(0, floor(fx))::INT AS x0, greatest(0, floor(fy))::INT AS y0 FROM pnt),
      got AS (SELECT p.*, fx - x0 AS wx, fy - y0 AS wy, a.v AS v00, b.v AS v10, c2.v AS v01, d.v AS v11 FROM pos p
        JOIN src a ON (a.img_id, a.c, a.y, a.x) = (p.img_id, p.c, p.y0, p.x0) JOIN src b ON (b.img_id, b.c, b.y, b.x) = (p.img_id, p.c, p.y0, least({n - 1}, p.x0 + 1))
        JOIN src c2 ON (c2.img_id, c2.c, c2.y, c2.x) = (p.img_id, p.c, least({n - 1}, p.y0 + 1), p.x0) JOIN src d ON (d.img_id, d.c, d.y, d.x) = (p.img_id, p.c, least({n - 1}, p.y0 + 1), least({n - 1}, p.x0 + 1)))""", f"SELECT img_id, ty AS y, tx AS x, c, CAST({final} AS INT) AS v FROM got"


def points(pts, src, colour, channels):
    values = K.colour_values(channels, colour)
    listed = ", ".join(map(str, sorted(pts)))
    case = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE WHEN (x, y) IN ({listed}) THEN CASE c {case} END ELSE v END"


def coloured(cond, colour, channels):
    case = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(K.colour_values(channels, colour)))
    return f"CASE WHEN {cond} THEN CASE c {case} END ELSE v END"


def _flip(y, x, src="gray8", where=""):
    return sql(f"SELECT img_id, CAST({y} AS INT) AS y, CAST({x} AS INT) AS x, c, v FROM {src} {where}", "gray8")


def _box(compat, src, n, r):
    lo, hi = f"greatest(0, a.x - {r})", f"least({n - 1}, a.x + {r})"
    s = "sum(b.v)" + (f" + {r} * max(f.v) + least(a.x, greatest(0, a.x + {r} - {n - 1})) * max(l.v)" if compat else "")
    edges = f"JOIN {src} f ON f.img_id = a.img_id AND f.y = a.y AND f.x = 0 JOIN {src} l ON l.img_id = a.img_id AND l.y = a.y AND l.x = {n - 1}" if compat else ""
    row = f"bh AS (SELECT a.img_id, a.y, a.x, a.c, floor(({s}) / count(b.v)::DOUBLE + 0.5)::INT % 256 AS v FROM {src} a JOIN {src} b ON b.img_id = a.img_id AND b.y = a.y AND b.x BETWEEN {lo} AND {hi} {edges} GROUP BY a.img_id, a.y, a.x, a.c)"
    return sql(f"SELECT a.img_id, a.y, a.x, a.c, floor(sum(b.v) / count(b.v)::DOUBLE + 0.5)::INT % 256 AS v FROM bh a JOIN bh b ON b.img_id = a.img_id AND b.x = a.x AND abs(b.y - a.y) <= {r} GROUP BY a.img_id, a.y, a.x, a.c", src, row)


def _adaptive(src, r, c, invert):
    yes, no = (0, 255) if invert else (255, 0)
    return sql(f"SELECT a.img_id, a.y, a.x, a.c, CASE WHEN a.v > sum(b.v) / count(b.v)::DOUBLE - {c} THEN {yes} ELSE {no} END AS v FROM {src} a JOIN {src} b ON b.img_id = a.img_id AND abs(b.y - a.y) <= {r} AND abs(b.x - a.x) <= {r} GROUP BY a.img_id, a.y, a.x, a.c, a.v", src)


def _bilinear():
    ctes, body = corners("rgbl", 8, 11, 5, T8("v00 * ((1 - wx) * (1 - wy)) + v10 * (wx * (1 - wy)) + v01 * ((1 - wx) * wy) + v11 * (wx * wy)"))
    return sql(body, "rgbl", ctes)


def _q15():
    q = lambda w: f"trunc({w} * 32768 + 0.5::DOUBLE)::BIGINT"
    row = lambda a, b: f"(({a} * (32768 - {q('wx')}) + {b} * {q('wx')} + 16384) >> 15)"
    ctes, body = corners("gray8", 8, 11, 5, f"least(255, greatest(0, ({row('v00', 'v10')} * (32768 - {q('wy')}) + {row('v01', 'v11')} * {q('wy')} + 16384) >> 15))")
    return sql(body, "gray8", ctes)


def _warp(matrix=ROT, width=10, height=7, border=9):
    a, b, c, d, e, f = (D(m) for m in matrix)
    ctes = f"""{target('gray8', 8, 8, width, height)},
      pnt AS (SELECT *, {a} * tx + {b} * ty + {c} AS sx, {d} * tx + {e} * ty + {f} AS sy FROM grid),
      pos AS (SELECT *, floor(sx)::INT AS x0, floor(sy)::INT AS y0, sx - floor(sx) AS wx, sy - floor(sy) AS wy FROM pnt)"""
    tap = lambda dy, dx: f"coalesce((SELECT v FROM src s WHERE s.img_id = p.img_id AND s.y = p.y0 + {dy} AND s.x = p.x0 + {dx}), {border})"
    e = f"{tap(0, 0)} * (1 - wx) * (1 - wy) + {tap(0, 1)} * wx * (1 - wy) + {tap(1, 0)} * (1 - wx) * wy + {tap(1, 1)} * wx * wy"
    return sql(f"SELECT img_id, ty AS y, tx AS x, c, CAST({T8(e)} AS INT) AS v FROM pos p", "gray8", ctes)


ORACLE = {
    "p_grayscale": px(GRAY, "rgb8", c="0"),
    "p_grayscale_rgba": px(GRAY, "rgba8", c="0"),
    "p_threshold": px("CASE WHEN v >= 100 THEN 255 ELSE 0 END"),
    "p_gray_to_rgb": sql("SELECT img_id, y, x, c2::INT AS c, v FROM gray8, (SELECT unnest([0, 1, 2]) AS c2)"),
    "p_to_rgb": sql("SELECT -1 - img_id AS img_id, y, x, c2::INT AS c, v FROM gray8, (SELECT unnest([0, 1, 2]) AS c2) UNION ALL SELECT img_id, y, x, c::INT AS c, CAST(v AS INT) AS v FROM rgbl", "rgbl"),
    "p_invert": sql(wide3("rgba8", *[f"255 - {n}" for n in "rgba"]), "rgba8"),
    "p_brightness_contrast": px(T8("(v - 128) * 1.4::DOUBLE + 128 + 12.5::DOUBLE"), "rgbl"),
    "p_gamma": px(f"([{', '.join(map(str, gamma_table(2.2)))}])[v + 1]", "rgbl"),
    "p_extract_channel": px("g", "rgb8", c="0"),
    "p_rgb_to_hsv": sql(wide3("hsv", "h", "s", "w"), "rgb8", HSV),
    "p_hsv_to_rgb": sql(wide3("hx", back(0), back(1), back(2)), "rgb8", f"{HSV}, {HSV_BACK}"),
    "p_in_range_gray": px("CASE WHEN v BETWEEN 60 AND 180 THEN 255 ELSE 0 END"),
    "p_in_range_rgb": px("CASE WHEN r BETWEEN 40 AND 200 AND b BETWEEN 0 AND 128 THEN 255 ELSE 0 END", "rgb8", c="0"),
    "p_in_range_hsv": px("CASE WHEN h BETWEEN 20 AND 120 AND s >= 50 THEN 255 ELSE 0 END", "hsv", HSV, c="0", used="rgb8"),
    "p_in_range_hsv_wrap": px("CASE WHEN (h >= 150 OR h <= 30) AND w >= 60 THEN 255 ELSE 0 END", "hsv", HSV, c="0", used="rgb8"),
    "p_dims": sql("SELECT img_id, max(x) + 1 AS width, max(y) + 1 AS height, 1 AS channels FROM ev16 GROUP BY img_id", "ev16"),
    "g_crop": _flip("y - 1", "x - 2", where="WHERE x BETWEEN 2 AND 6 AND y BETWEEN 1 AND 4"),
    "g_flip_h": _flip("y", "7 - x"),
    "g_flip_v": _flip("7 - y", "x"),
    "g_rotate90": _flip("x", "7 - y", src=X.PAIRS),
    "g_rotate180": _flip("7 - y", "15 - x", src=X.PAIRS),
    "g_rotate270": _flip("15 - x", "y", src=X.PAIRS),
    "g_resize_nearest": sql("SELECT g.img_id, ty AS y, tx AS x, g.c, v FROM grid g JOIN src s ON s.img_id = g.img_id AND s.y = least(7, ty * 8 // 11) AND s.x = least(7, tx * 8 // 5)", "gray8", target("gray8", 8, 8, 5, 11)),
    "g_resize_bilinear": _bilinear(),
    "g_resize_area": sql("SELECT img_id, y // 2 AS y, x // 4 AS x, c, CAST(floor(sum(v) / 8.0::DOUBLE + 0.5) AS INT) AS v FROM ev16 GROUP BY img_id, y // 2, x // 4, c", "ev16"),
    "g_resize_q15": _q15(),
    "g_warp_affine": _warp(),
    "n_convolve": sql("SELECT * FROM o", "gray8", stencil("o", "gray8", kernel(EDGE5, 5, 5), 8, "least(255, greatest(0, k))")),
    "n_sharpen": sql("SELECT * FROM o", "rgbl", stencil("o", "rgbl", kernel(SHARP, 3, 3), 8, "least(255, greatest(0, k))")),
    "n_box_blur_mean": _box(False, "ev16", 16, 2),
    "n_box_blur_compat": _box(True, "gray8", 8, 2),
    "n_gaussian_r1": px("v", "o", gauss3("o", "gray8"), used="gray8"),
    "n_gaussian_r2": px("v", "o", gauss("o", "ev16", gaussian_weights(2)), used="ev16"),
    "n_gaussian_rgb": px("v", "o", gauss("o", "rgbl", gaussian_weights(1)), used="rgbl"),
    "n_gaussian_parallel": px("v", "o", gauss("o", "gray8", gaussian_weights(1, 1.5)), used="gray8"),
    "n_sobel": sql("SELECT * FROM o", "gray8", sobel("o", "gray8")),
    "n_erode": sql("SELECT * FROM o", "gray8", ext("o", "gray8", 1, "min")),
    "n_dilate": sql("SELECT * FROM o", "ev16", ext("o", "ev16", 2, "max")),
    "n_open": sql("SELECT * FROM o", "gray8", ext("e", "gray8", 1, "min") + ", " + ext("o", "e", 1, "max")),
    "n_close": sql("SELECT * FROM o", "gray8", ext("e", "gray8", 1, "max") + ", " + ext("o", "e", 1, "min")),
    "n_morph_gradient": sql("SELECT a.img_id, a.y, a.x, a.c, a.v - b.v AS v FROM d a JOIN e b USING (img_id, y, x, c)", "gray8", ext("d", "gray8", 1, "max") + ", " + ext("e", "gray8", 1, "min")),
    "n_top_hat": sql(both("o", "ev16", "greatest(0, s.v - m.v)", "o"), "ev16", ext("e", "ev16", 1, "min") + ", " + ext("o", "e", 1, "max")),
    "n_black_hat": sql(both("o", "gray8", "greatest(0, m.v - s.v)", "o"), "gray8", ext("e", "gray8", 1, "max") + ", " + ext("o", "e", 1, "min")),
    "n_adaptive_mean": _adaptive("ev16", 2, 5, False),
    "n_adaptive_mean_invert": _adaptive("gray8", 1, 2, True),
    "n_adaptive_gaussian": px("CASE WHEN v0 > v - 5 THEN 255 ELSE 0 END", "o", gauss("o", "ev16", gaussian_weights(2, 2 / 3), exact=True), used="ev16"),
    "a_histogram": sql("SELECT p.img_id, p.c, b.bin::INT AS bin, count(r.v) AS n FROM (SELECT DISTINCT img_id, c FROM rgbl) p CROSS JOIN range(256) b(bin) LEFT JOIN rgbl r ON r.img_id = p.img_id AND r.c = p.c AND r.v = b.bin GROUP BY ALL", "rgbl"),
    "a_equalize": sql(f"SELECT img_id, y, x, c, CAST(CASE WHEN least_ = n THEN 0 ELSE {R8('(cdf - least_) / nullif(n - least_, 0)::DOUBLE * 255')} END AS INT) AS v FROM f", "ev16", "e AS (SELECT *, count(*) OVER (PARTITION BY img_id ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cdf, count(*) OVER (PARTITION BY img_id) AS n FROM ev16), f AS (SELECT *, min(cdf) OVER (PARTITION BY img_id) AS least_ FROM e)"),
    "a_normalize": sql(f"SELECT img_id, y, x, c, CAST({T8('(v - lo) / (CASE WHEN hi = lo THEN 1 ELSE hi - lo END)::DOUBLE * 255')} AS INT) AS v FROM n", "rgbl", "n AS (SELECT *, min(v) OVER (PARTITION BY img_id, c) AS lo, max(v) OVER (PARTITION BY img_id, c) AS hi FROM rgbl)"),
    "a_integral": sql("SELECT i.img_id, yy::INT AS y, xx::INT AS x, CAST(coalesce(sum(v), 0) AS BIGINT) AS s FROM (SELECT DISTINCT img_id FROM gray8) i CROSS JOIN range(9) a(yy) CROSS JOIN range(9) b(xx) LEFT JOIN gray8 g ON g.img_id = i.img_id AND g.y < yy AND g.x < xx GROUP BY ALL"),
    "a_sum_rect": sql("SELECT img_id, CAST(sum(v) AS BIGINT) AS s FROM gray8 WHERE x BETWEEN 1 AND 5 AND y BETWEEN 2 AND 5 GROUP BY img_id"),
    "d_point": px("CASE WHEN abs(x - 3) <= 1 AND abs(y - 3) <= 1 THEN 44 ELSE v END"),
    "d_line": px(points(K.brushed(K.line_points(-1, 1, 6, 4)), "rgbl", TEAL, 3), "rgbl"),
    "d_rect": px(coloured("x <= 7 AND y <= 6 AND (abs(x - 1) <= 1 OR abs(x - 6) <= 1 OR abs(y - 1) <= 1 OR abs(y - 5) <= 1)", RED, 3), "rgbl"),
    "d_filled_rect": px(coloured("x >= 4 AND y >= 5", TEAL, 3), "rgbl"),
    "d_circle": px(points(K.brushed(K.circle_points(7, 7, 5)), "ev16", None, 1), "ev16"),
    "d_filled_circle": px(coloured("(x - 3) * (x - 3) + (y - 4) * (y - 4) <= 9", RED, 3), "rgbl"),
    "l_gt": px(f"CASE WHEN {GRAY} >= 128 THEN 255 ELSE 0 END", "rgb8", c="0"),
    "l_gte": sql("SELECT * FROM o", "rgb8", f"t AS (SELECT img_id, y, x, 0 AS c, CASE WHEN {GRAY} >= 128 THEN 255 ELSE 0 END AS v FROM rgb8), " + ext("o", "t", 1, "min")),
    "l_be": sql("SELECT * FROM o", "gray8", stencil("bn", "gray8", BINOMIAL, 8, "k::INT >> 4") + ", " + sobel("o", "bn")),
    "l_gbe": sql("SELECT * FROM o", "rgb8", GRAYW + ", " + stencil("bn", "gw", BINOMIAL, 8, "k::INT >> 4") + ", " + sobel("o", "bn")),
    "l_bte": sql("SELECT * FROM o", "ev16", gauss("gs", "ev16", gaussian_weights(2)) + ", " + sobel("o", "gs", 16)),
    "l_point_table": px(f"255 - ([{', '.join(map(str, gamma_table(2.2)))}])[{T8('(v - 128) * 1.4::DOUBLE + 128 + 12.5::DOUBLE')}::INT + 1]", "rgbl"),
    "l_crop_first": sql("SELECT img_id, y - 3 AS y, x - 1 AS x, c, v FROM o WHERE x BETWEEN 1 AND 9 AND y BETWEEN 3 AND 8", "ev16", gauss("gs", "ev16", gaussian_weights(2)) + ", " + sobel("o", "gs", 16)),
    "l_channel_first": sql("SELECT img_id, y, x, 0 AS c, 255 - v AS v FROM o WHERE c = 1", "rgbl", stencil("o", "rgbl", kernel(SHARP, 3, 3), 8, "least(255, greatest(0, k))")),
    "l_unfused_chain": sql("SELECT * FROM o", "rgb8", GRAYW + ", " + gauss3("gs", "gw") + ", " + sobel("o", "gs")),
}


def queries():
    return QUERIES | MORE | FILE_QUERIES


def oracle_sql():
    return ORACLE | more_sql() | file_sql()
