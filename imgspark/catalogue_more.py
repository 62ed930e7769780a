"""Queries of frame kernels, codecs, components, plans and functions, with SQL where it can say them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from imgspark import fixtures as X
from imgspark.frame import distances, from_pixels, map_frames, to_pixels
from imgspark.functions import registry as R
from imgspark.operators import components as C
from imgspark.operators import kernels as K
from imgspark.operators import pixels as P
from imgspark.plans.pipeline import Plan
from imgspark.sources import codecs


def fr(spark, d, name="gray8"):
    px = getattr(X, name)(spark, d)
    return from_pixels(X.long3(px, {"rgb8": "rgb", "rgba8": "rgba"}[name]) if name in ("rgb8", "rgba8") else px, name)


def _frame(f, name="gray8"):
    return lambda spark, d: to_pixels(map_frames(fr(spark, d, name), f))


def _trip(fmt, name, **how):
    """Encode, write down nothing, decode again: the pixels that come back."""
    return lambda spark, d: to_pixels(codecs.decode_frames(codecs.encode_frames(fr(spark, d, name), fmt, **how)))


def _jpeg(name, bound, **how):
    def run(spark, d):
        src = fr(spark, d, name)
        worst = distances(src, codecs.decode_frames(codecs.encode_frames(src, "jpg", **how)))
        return worst.select("img_id", (F.col("worst") <= bound).alias("within"))

    return run


def _shrink(spark, d):
    big = map_frames(fr(spark, d, "ev16"), K.gray_to_rgb)
    half = codecs.decode_frames(codecs.encode_frames(big, "jpg", quality=95), resize={"width": 8, "height": 8}, shrink_on_load=True)
    return half.select("img_id", "width", "height", "channels")


def _header(spark, d):
    return codecs.header_dims(codecs.encode_frames(fr(spark, d, "rgb8"), "png"))


def _plan(spark, d):
    plan = Plan().grayscale().blur(1).edges().threshold(60).dilate(1)
    return to_pixels(plan.run(fr(spark, d, "rgb8")))


#: Inverse maps of the affine helpers; turns by 30 and 90 degrees, a move, and a scaling about a point after it.
MATRICES = {
    "rotation": K.rotation_matrix(90, 3.5, 3.5),
    "translation": K.translation_matrix(3, -2),
    "scale": K.scale_matrix(2, 4, 8, 8),
    "composed": K.compose_affine(K.translation_matrix(1, -2), K.scale_matrix(2, 0.5, 3, 3)),
}


def _matrices(spark, d):
    """Every frame through every matrix: warps of one image are told apart by their names."""
    px = X.gray8(spark, d)
    parts = [P.warp_affine(px, m, 8, 8, 5).select(F.lit(n).alias("name"), *P.KEYS, "v") for n, m in MATRICES.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _boxes(spark, d):
    comps = C.components(fr(spark, d, "mask8"), min_area=4)
    return P.draw_boxes(X.mask8(spark, d), 1, comps, {"gray": 77}, 2)


def _clamp(spark, d):
    from imgspark.functions.semantics import trunc_u8

    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", trunc_u8(F.col("l_extendedprice") / F.lit(200.0) - F.lit(20.0)).alias("v"))


def _udf(spark, d):
    R.register_functions(spark)
    fr(spark, d).createOrReplaceTempView("frames_u")
    return spark.sql("SELECT img_id, frame_mean(width, height, channels, data) AS mean FROM frames_u")


def _udtf(spark, d):
    R.register_functions(spark)
    fr(spark, d, "mask8").createOrReplaceTempView("frames_t")
    return spark.sql("SELECT f.img_id, t.id, t.x, t.y, t.width, t.height, t.area FROM frames_t f, LATERAL frame_components(f.width, f.height, f.channels, f.data) t")


def _arrow_udf(spark, d):
    R.register_functions(spark)
    fr(spark, d).createOrReplaceTempView("frames_h")
    got = spark.sql("SELECT img_id, posexplode(frame_histogram(width, height, channels, data)) AS (bin, n) FROM frames_h")
    return got.filter("n > 0")


def _arrow_udtf(spark, d):
    R.register_functions(spark)
    fr(spark, d, "mask8").createOrReplaceTempView("frames_a")
    return spark.sql("SELECT * FROM components_of_frames(TABLE(SELECT img_id, width, height, channels, data FROM frames_a))")


MORE = {
    "p_clamp_u8": _clamp,
    "g_resize_fit": _frame(lambda a: K.resize_fit(a, 5, 3, "cover", "nearest")),
    "g_scale": _frame(lambda a: K.scale(a, 1.5, "nearest")),
    "g_resize_auto": _frame(lambda a: K.resize_auto(a, 4, 4), "ev16"),
    "g_affine_matrices": _matrices,
    "f_grayscale": _frame(K.grayscale, "rgb8"),
    "f_gaussian_r1": _frame(K.gaussian_blur),
    "f_box_blur_compat": _frame(lambda a: K.box_blur(a, 2, "compat")),
    "f_sobel": _frame(K.sobel),
    "n_canny": _frame(lambda a: K.canny(a, 50, 150), "ev16"),
    "n_canny_px": lambda s, d: C.canny_pixels(X.ev16(s, d), 50, 150),
    "n_canny_nms": lambda s, d: P.canny_maxima(X.gray8(s, d)).withColumn("m", F.floor(F.col("m").cast("double") * 1000).cast("long")),
    "a_components": lambda s, d: C.components(fr(s, d, "mask8")),
    "a_components4": lambda s, d: C.components(fr(s, d, "mask8"), connectivity=4),
    "a_components_px": lambda s, d: C.components_pixels(X.mask8(s, d)),
    "a_filter_components": lambda s, d: P.filter_components(C.components(fr(s, d, "mask8")), 3, 20),
    "d_boxes": _boxes,
    "l_plan_fused": _plan,
    "s_ppm_rt": _trip("ppm", "rgb8"),
    "s_bmp_rt": _trip("bmp", "rgb8"),
    "s_png_rt": _trip("png", "rgba8"),
    "s_png_sub_rt": _trip("png", "gray8", filter="sub", level=6),
    "s_jpeg_tol": _jpeg("rgb8", 8, quality=100),
    "s_jpeg_baseline_tol": _jpeg("rgb8", 8, quality=100, progressive=False),
    "s_jpeg_shrink": _shrink,
    "s_header_dims": _header,
    "u_sql_udf": _udf,
    "u_arrow_udf": _arrow_udf,
    "u_arrow_udtf": _arrow_udtf,
    "u_udtf_components": _udtf,
}


def more_sql():
    from imgspark.catalogue import GRAY, GRAYW, SOBEL, T8, BINOMIAL, ext, gauss3, px, sobel, sql, stencil, _box, _warp

    def comps(connectivity):
        near = "abs(b.x - a.x) <= 1 AND abs(b.y - a.y) <= 1" if connectivity == 8 else "abs(b.x - a.x) + abs(b.y - a.y) = 1"
        return f"""g AS (SELECT img_id, y, x, y * 8 + x AS p FROM mask8 WHERE v > 0),
          edges AS (SELECT a.img_id, a.p AS p, b.p AS q, b.y, b.x FROM g a JOIN g b ON a.img_id = b.img_id AND {near}),
          recursive_reach AS (SELECT img_id, p, p AS q FROM g UNION SELECT r.img_id, r.p, e.q FROM recursive_reach r JOIN edges e ON e.img_id = r.img_id AND e.p = r.q),
          lab AS (SELECT img_id, p, min(q) AS root FROM recursive_reach GROUP BY ALL),
          comp AS (SELECT g.img_id, root, CAST(min(x) AS INT) AS x, CAST(min(y) AS INT) AS y, CAST(max(x) - min(x) + 1 AS INT) AS width, CAST(max(y) - min(y) + 1 AS INT) AS height, count(*) AS area, sum(x) / count(*)::DOUBLE AS centroid_x, sum(y) / count(*)::DOUBLE AS centroid_y FROM g JOIN lab USING (img_id, p) GROUP BY ALL),
          o AS (SELECT img_id, CAST(row_number() OVER (PARTITION BY img_id ORDER BY root) - 1 AS INT) AS id, * EXCLUDE (img_id, root) FROM comp)"""

    def inside(r):
        x1, y1 = "(o.x + o.width - 1)", "(o.y + o.height - 1)"
        return f"m.x BETWEEN o.x - {r} AND {x1} + {r} AND m.y BETWEEN o.y - {r} AND {y1} + {r} AND (abs(m.x - o.x) <= {r} OR abs(m.x - {x1}) <= {r} OR abs(m.y - o.y) <= {r} OR abs(m.y - {y1}) <= {r})"

    def nms(src, n):
        grad = stencil("gr", "gs", SOBEL, n, "0").rsplit("gr AS (", 1)[0]  # the sums alone
        edge = f"x IN (0, {n - 1}) OR y IN (0, {n - 1})"
        return f"""{gauss3('gs', src)}, {grad}
          mg AS (SELECT img_id, y, x, c, CASE WHEN {edge} THEN 0::FLOAT ELSE CAST(sqrt((gx * gx + gy * gy)::DOUBLE) AS FLOAT) END AS m, CASE WHEN {edge} THEN NULL ELSE atan2(abs(gy)::DOUBLE, abs(gx)::DOUBLE) * 180 / pi() END AS ang FROM grs),
          dr AS (SELECT *, CASE WHEN ang < 22.5 THEN 0 WHEN ang < 67.5 THEN -1 ELSE -1 END AS dy, CASE WHEN ang < 22.5 THEN 1 WHEN ang < 67.5 THEN 1 ELSE 0 END AS dx FROM mg),
          th AS (SELECT a.img_id, a.y, a.x, a.c, CASE WHEN a.ang IS NOT NULL AND a.m >= p.m AND a.m >= q.m THEN a.m ELSE 0::FLOAT END AS m FROM dr a
            LEFT JOIN mg p ON p.img_id = a.img_id AND p.y = a.y + a.dy AND p.x = a.x + a.dx LEFT JOIN mg q ON q.img_id = a.img_id AND q.y = a.y - a.dy AND q.x = a.x - a.dx)"""

    canny = sql(
        "SELECT t.img_id, t.y, t.x, t.c, CASE WHEN r.img_id IS NULL THEN 0 ELSE 255 END AS v FROM th t LEFT JOIN recursive_hot r ON r.img_id = t.img_id AND r.y = t.y AND r.x = t.x",
        "ev16",
        nms("ev16", 16) + ", recursive_hot AS (SELECT img_id, y, x FROM th WHERE m >= 150 UNION SELECT t.img_id, t.y, t.x FROM recursive_hot h JOIN th t ON t.img_id = h.img_id AND abs(t.y - h.y) <= 1 AND abs(t.x - h.x) <= 1 AND t.m >= 50)",
    )
    same = lambda src: px("v", src)
    dims = "SELECT img_id, 8 AS width, 8 AS height, 3 AS channels FROM (SELECT DISTINCT img_id FROM rgb8)"
    within = sql("SELECT DISTINCT img_id, true AS within FROM rgb8", "rgb8")
    comp_cols = "SELECT img_id, id, x, y, width, height, area, centroid_x, centroid_y FROM o"
    near = lambda w, h, W, H: sql(f"SELECT g.img_id, ty::INT AS y, tx::INT AS x, g.c, v FROM (SELECT DISTINCT img_id, c FROM gray8) g CROSS JOIN range({H}) a(ty) CROSS JOIN range({W}) b(tx) JOIN gray8 s ON s.img_id = g.img_id AND s.y = least({h - 1}, ty * {h} // {H}) AND s.x = least({w - 1}, tx * {w} // {W})")
    return {
        "p_clamp_u8": f"SELECT l_orderkey, l_linenumber, l_partkey, CAST({T8('l_extendedprice / 200.0::DOUBLE - 20.0::DOUBLE')} AS INT) AS v FROM lineitem",
        "g_resize_fit": near(8, 8, 5, 5),
        "g_scale": near(8, 8, 12, 12),
        "g_resize_auto": sql("SELECT img_id, (y // 4)::INT AS y, (x // 4)::INT AS x, c, CAST(floor(sum(v) / 16.0::DOUBLE + 0.5) AS INT) AS v FROM ev16 GROUP BY img_id, y // 4, x // 4, c", "ev16"),
        "g_affine_matrices": " UNION ALL ".join(f"SELECT '{n}' AS name, * FROM ({_warp(m, 8, 8, 5)})" for n, m in MATRICES.items()),
        "f_grayscale": px(GRAY, "rgb8", c="0"),
        "f_gaussian_r1": px("v", "o", gauss3("o", "gray8"), used="gray8"),
        "f_box_blur_compat": _box(True, "gray8", 8, 2),
        "f_sobel": sql("SELECT * FROM o", "gray8", sobel("o", "gray8")),
        "n_canny": canny,
        "n_canny_px": canny,
        "n_canny_nms": sql("SELECT img_id, y, x, c, CAST(floor(m::DOUBLE * 1000) AS BIGINT) AS m FROM th", "gray8", nms("gray8", 8)),
        "a_components": sql(comp_cols, "mask8", comps(8)),
        "a_components4": sql(comp_cols, "mask8", comps(4)),
        "a_components_px": sql(comp_cols, "mask8", comps(8)),
        "a_filter_components": sql(comp_cols + " WHERE area BETWEEN 3 AND 20", "mask8", comps(8)),
        "d_boxes": sql(f"SELECT m.img_id, m.y, m.x, m.c, CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.img_id = m.img_id AND o.area >= 4 AND {inside(1)}) THEN 77 ELSE m.v END AS v FROM mask8 m", "mask8", comps(8)),
        "l_plan_fused": sql("SELECT * FROM o", "rgb8", GRAYW + ", " + stencil("bn", "gw", BINOMIAL, 8, "k::INT >> 4") + ", " + sobel("ed", "bn") + ", tr AS (SELECT img_id, y, x, c, CASE WHEN v >= 60 THEN 255 ELSE 0 END AS v FROM ed), " + ext("o", "tr", 1, "max")),
        "s_ppm_rt": same("rgbl"),
        "s_bmp_rt": same("rgbl"),
        "s_png_rt": sql("SELECT img_id, y, x, c::INT AS c, CASE c WHEN 0 THEN r WHEN 1 THEN g WHEN 2 THEN b ELSE a END AS v FROM rgba8, (SELECT unnest([0, 1, 2, 3]) AS c)", "rgba8"),
        "s_png_sub_rt": same("gray8"),
        "s_jpeg_tol": within,
        "s_jpeg_baseline_tol": within,
        "s_jpeg_shrink": sql("SELECT DISTINCT img_id, 8 AS width, 8 AS height, 3 AS channels FROM ev16", "ev16"),
        "s_header_dims": sql(dims, "rgb8"),
        "u_sql_udf": sql("SELECT img_id, sum(v) / 64.0::DOUBLE AS mean FROM gray8 GROUP BY img_id"),
        "u_arrow_udf": sql("SELECT img_id, v AS bin, count(*) AS n FROM gray8 GROUP BY ALL"),
        "u_arrow_udtf": sql("SELECT img_id, id, x, y, width, height, area FROM o", "mask8", comps(8)),
        "u_udtf_components": sql("SELECT img_id, id, x, y, width, height, area FROM o", "mask8", comps(8)),
    }
