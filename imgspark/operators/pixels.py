"""The operators over pixels as a relation (img_id, y, x, c, v), in Catalyst expressions.

Neighbourhoods and prefix sums go by tiles (`operators/tiles.py`), so no task has to hold an image.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from imgspark.functions.semantics import GRAY, gamma_table, half_up, half_up_u8, trunc_u8, wrap_u8
from imgspark.operators import kernels as K
from imgspark.operators.tiles import gather, is_packed, looked_up, value_counts
from imgspark.operators.tiles import integral as prefix_sums
from imgspark.operators.tiles import neighbourhood

KEYS = ["img_id", "y", "x", "c"]

def row_window():
    """Windows are made on use: building one needs a running session."""
    return Window.partitionBy("img_id", "c", "y").orderBy("x")


def column_window():
    return Window.partitionBy("img_id", "c", "x").orderBy("y")


def width_of(px: DataFrame) -> Column:
    """An aggregate: the width, or that of a part of an image."""
    return F.max(F.col("x") + F.length("v")) if is_packed(px) else F.max("x") + 1


def value(px: DataFrame, v: Column) -> DataFrame:
    return px.select(*KEYS, v.cast("int").alias("v"))


def wide(px: DataFrame) -> DataFrame:
    """(img_id, y, x, r, g, b, a): one aggregate; missing channels are null."""
    return px.groupBy("img_id", "y", "x").agg(*[F.max(F.when(F.col("c") == i, F.col("v"))).alias(n) for i, n in enumerate("rgba")])


def long(px: DataFrame, *values: Column) -> DataFrame:
    """Columns of a wide relation back to one row a channel, without a shuffle."""
    return px.select("img_id", "y", "x", F.posexplode(F.array(*[v.cast("int") for v in values])).alias("c", "v"))


def sized(px: DataFrame) -> DataFrame:
    """px plus w and h of its image: an aggregate of a row an image joined back, so that no task has to
    hold an image, and pixels are not shuffled where that side is small enough to be broadcast."""
    size = px.groupBy("img_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    return px.join(size, "img_id")


def gray_of(r, g, b) -> Column:
    return F.shiftright(GRAY[0] * r + GRAY[1] * g + GRAY[2] * b, 8)


# ---- points


def grayscale(rgb: DataFrame) -> DataFrame:
    """rgb: wide. Everything below takes and gives the long form unless it says wide."""
    return rgb.select("img_id", "y", "x", F.lit(0).alias("c"), gray_of(F.col("r"), F.col("g"), F.col("b")).alias("v"))


def threshold(px, value_=128):
    return value(px, F.when(F.col("v") >= value_, 255).otherwise(0))


def gray_to_rgb(px):
    return px.select("img_id", "y", "x", F.explode(F.array(*map(F.lit, range(3)))).alias("c"), "v")


def invert(px):
    return value(px, 255 - F.col("v"))


def brightness_contrast(px, brightness=0.0, contrast=1.0):
    return value(px, trunc_u8((F.col("v") - 128) * F.lit(float(contrast)) + 128 + F.lit(float(brightness))))


def lookup(px, table: list[int]) -> DataFrame:
    """A 256-entry table as a literal, so the expression stays in one projection."""
    return value(px, F.element_at(F.array(*map(F.lit, table)), F.col("v") + 1))


def gamma(px, g):
    return lookup(px, gamma_table(g))


def extract_channel(px, c):
    return px.filter(F.col("c") == c).select("img_id", "y", "x", F.lit(0).alias("c"), "v")


def rgb_to_hsv(rgb):
    r, g, b = (F.col(n) / F.lit(255.0) for n in "rgb")
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    sext = F.when(top == r, ((g - b) / d) % F.lit(6.0)).when(top == g, (b - r) / d + 2).otherwise((r - g) / d + 4) * 60
    h = F.when(d == 0, F.lit(0.0)).otherwise(F.when(sext < 0, sext + 360).otherwise(sext))
    s = F.when(top == 0, F.lit(0.0)).otherwise(d / top)
    return long(rgb, half_up_u8(h * 179 / 360), half_up_u8(s * 255), half_up_u8(top * 255))


def hsv_to_rgb(hsv):
    """hsv: wide, as r, g, b."""
    h, s, v = F.col("r") * F.lit(360.0) / 179, F.col("g") / F.lit(255.0), F.col("b") / F.lit(255.0)
    c = v * s
    x = c * (1 - F.abs((h / 60) % F.lit(2.0) - 1))
    m, z = v - c, F.lit(0.0)

    def pick(*six):
        return reduce(lambda acc, p: F.when(h < p[0], p[1]).otherwise(acc), [(300, six[4]), (240, six[3]), (180, six[2]), (120, six[1]), (60, six[0])], six[5])

    parts = (pick(c, x, z, z, x, c), pick(x, c, c, x, z, z), pick(z, z, x, c, c, x))
    return long(hsv, *[half_up_u8((p + m) * 255) for p in parts])


def mask(px, ok: Column):
    return px.select("img_id", "y", "x", F.lit(0).alias("c"), F.when(ok, 255).otherwise(0).alias("v"))


def in_range_gray(px, low, high):
    return mask(px, F.col("v").between(low, high))


def in_range_rgb(rgb, r=None, g=None, b=None):
    return mask(rgb, reduce(lambda a, t: a & F.col(t[0]).between(*t[1]), [(n, lim) for n, lim in zip("rgb", (r, g, b)) if lim is not None], F.lit(True)))


def in_range_hsv(hsv, h=None, s=None, v=None):
    ok = F.lit(True)
    for n, lim in zip("rgb", (h, s, v)):
        if lim is not None:
            wraps = n == "r" and lim[0] > lim[1]
            ok = ok & ((F.col(n) >= lim[0]) | (F.col(n) <= lim[1]) if wraps else F.col(n).between(*lim))
    return mask(hsv, ok)


# ---- geometry


def crop(px, x, y, width, height):
    inside = F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1)
    return px.filter(inside).select("img_id", (F.col("y") - y).alias("y"), (F.col("x") - x).alias("x"), "c", "v")


def moved(px, y: Column, x: Column):
    return sized(px).select("img_id", y.cast("int").alias("y"), x.cast("int").alias("x"), "c", "v")


def flip_h(px):
    return moved(px, F.col("y"), F.col("w") - 1 - F.col("x"))


def flip_v(px):
    return moved(px, F.col("h") - 1 - F.col("y"), F.col("x"))


def rotate90(px):
    return moved(px, F.col("x"), F.col("h") - 1 - F.col("y"))


def rotate180(px):
    return moved(px, F.col("h") - 1 - F.col("y"), F.col("w") - 1 - F.col("x"))


def rotate270(px):
    return moved(px, F.col("w") - 1 - F.col("x"), F.col("y"))


def _resized(px, width, height, axis, taps) -> DataFrame:
    """Target tiles ask for the source tiles under them; axis and taps are a frame kernel's."""

    def part(of, places, start, stop, origin):
        got = axis(of, places)
        first = [g[start:stop] for g in (got if isinstance(got, tuple) else (got,))]
        return [g - origin if i < 2 else g for i, g in enumerate(first)]

    def sample(a, y0, x0, h, w, box):
        top, left, bottom, right = box
        return taps(a, part(h, height, top, bottom, y0), part(w, width, left, right, x0))

    def under(start, stop, n, target):
        return F.floor(start * n / target) - 2, F.ceil(stop * n / target) + 2

    def box(top, left, bottom, right, h, w):
        return *under(top, bottom, h, height), *under(left, right, w, width)

    return gather(px, width, height, lambda h, w: (h / height, w / width), box, sample)


def resize_nearest(px, width, height):
    return _resized(px, width, height, K.nearest_axis, lambda a, rows, columns: a[rows[0]][:, columns[0]])


def resize_bilinear(px, width, height):
    return _resized(px, width, height, K.bilinear_axis, K.bilinear_taps)


def resize_q15(px, width, height):
    return _resized(px, width, height, K.q15_axis, K.q15_taps)


def resize_area(px, width, height):
    """Every pixel goes to the cells that it overlaps: a range join as an explode, then a weighted sum.
    Images that don't shrink on both sides are resized bilinearly. Packed pixels go by tiles, at a byte a pixel."""
    if is_packed(px):
        return _area_tiles(px, width, height)
    both = sized(px)
    shrinks = (F.col("w") > width) & (F.col("h") > height)
    return _area(both.filter(shrinks), width, height).unionByName(resize_bilinear(both.filter(~shrinks), width, height))


def _area_tiles(px, width, height):
    def sample(a, y0, x0, h, w, at):
        top, left, bottom, right = at
        if w > width and h > height:
            return K.area_part(a, y0, x0, h, w, at, width, height)
        rows, columns = (
            [g[start:stop] - origin if i < 2 else g[start:stop] for i, g in enumerate(K.bilinear_axis(of, places))]
            for of, places, start, stop, origin in ((h, height, top, bottom, y0), (w, width, left, right, x0))
        )
        return K.bilinear_taps(a, rows, columns)

    def under(start, stop, n, target):
        return F.floor(start * n / target) - 2, F.ceil(stop * n / target) + 2

    def box(top, left, bottom, right, h, w):
        return *under(top, bottom, h, height), *under(left, right, w, width)

    return gather(px, width, height, lambda h, w: (h / height, w / width), box, sample)


def _area(d, width, height):
    sx, sy = F.col("w") / F.lit(float(width)), F.col("h") / F.lit(float(height))

    def cells(p, step, n):
        first = F.greatest(F.lit(0), F.floor(F.col(p) / step) - 1)
        last = F.least(F.lit(n - 1), F.ceil((F.col(p) + 1) / step))
        return F.explode(F.sequence(first, last))

    d = d.withColumn("ty", cells("y", sy, height)).withColumn("tx", cells("x", sx, width))

    def shared(p, t, step):
        return F.least((F.col(t) + 1) * step, F.col(p) + F.lit(1.0)) - F.greatest(F.col(t) * step, F.col(p).cast("double"))

    d = d.withColumn("ox", shared("x", "tx", sx)).withColumn("oy", shared("y", "ty", sy)).filter("ox > 0 and oy > 0")
    out = d.groupBy("img_id", "ty", "tx", "c").agg(half_up_u8(F.sum(F.col("v") * F.col("ox") * F.col("oy")) / F.sum(F.col("ox") * F.col("oy"))).alias("v"))
    return out.select("img_id", F.col("ty").cast("int").alias("y"), F.col("tx").cast("int").alias("x"), "c", "v")


def warp_affine(px, matrix, width, height, border=0):
    """Bilinear, through the inverse map, which may be singular: a target tile asks for the source tiles that the
    images of its corners span."""
    a, b, c, d, e, f = map(float, matrix)

    def span(k, m, n, top, left, bottom, right):
        ends = [F.lit(k) * x + F.lit(m) * y + F.lit(n) for x in (left, right - 1) for y in (top, bottom - 1)]
        return F.floor(F.least(*ends)) - 1, F.floor(F.greatest(*ends)) + 2

    def box(top, left, bottom, right, h, w):
        return *span(d, e, f, top, left, bottom, right), *span(a, b, c, top, left, bottom, right)

    def sample(part, y0, x0, h, w, at):
        return K.warp_part(part, y0, x0, h, w, at, (a, b, c, d, e, f), border)

    return gather(px, width, height, lambda h, w: (F.lit(abs(d) + abs(e)), F.lit(abs(a) + abs(b))), box, sample)


# ---- neighbourhoods: a numpy kernel on tiles with a halo, one exchange by tile


def convolve(px, kernel, kw, kh):
    if kw % 2 == 0 or kh % 2 == 0 or len(kernel) != kw * kh:
        raise ValueError("the kernel needs odd sides and kw * kh values")
    return neighbourhood(px, lambda a: K.convolve(a, kernel, kw, kh), max(kw, kh) // 2)


def sharpen(px, strength=1.0):
    return neighbourhood(px, lambda a: K.sharpen(a, strength), 1)


def box_blur(px, radius=1, mode="mean"):
    if mode != "compat":
        return neighbourhood(px, lambda a: K.box_blur(a, radius), radius)
    # here a row's first and last pixel have a part in all of its sums, so rows stay whole
    d = sized(px)
    row, col = row_window().rowsBetween(-radius, radius), column_window().rowsBetween(-radius, radius)
    ends = row_window().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    over = F.least(F.col("x"), F.greatest(F.lit(0), F.col("x") + radius - (F.col("w") - 1)))
    s = F.sum("v").over(row) + radius * F.first("v").over(ends) + over * F.last("v").over(ends)
    d = d.select(*KEYS, wrap_u8(F.floor(s / F.count("*").over(row) + F.lit(0.5))).alias("v"))
    return value(d, wrap_u8(F.floor(F.sum("v").over(col) / F.count("*").over(col) + F.lit(0.5))))


def gaussian_taps(px, radius=1, sigma=None):
    return neighbourhood(px, lambda a: K.gaussian_blur_taps(a, radius, sigma), radius)


def gaussian3(px, sigma=None):
    return neighbourhood(px, lambda a: K.gaussian_blur(a, 1, sigma), 1)


def sobel(px):
    return neighbourhood(px, K.sobel, 1)


def erode(px, radius=1):
    return neighbourhood(px, lambda a: K.erode(a, radius), radius)


def dilate(px, radius=1):
    return neighbourhood(px, lambda a: K.dilate(a, radius), radius)


def open_(px, radius=1):
    return neighbourhood(px, lambda a: K.open_(a, radius), 2 * radius)


def close(px, radius=1):
    return neighbourhood(px, lambda a: K.close(a, radius), 2 * radius)


def morph_gradient(px, radius=1):
    return neighbourhood(px, lambda a: K.morph_gradient(a, radius), radius)


def top_hat(px, radius=1):
    return neighbourhood(px, lambda a: K.top_hat(a, radius), 2 * radius)


def black_hat(px, radius=1):
    return neighbourhood(px, lambda a: K.black_hat(a, radius), 2 * radius)


def adaptive_threshold(px, block_size=15, c=5, invert_=False, method="mean"):
    reach = max(3, block_size) // 2 + 1
    return neighbourhood(px, lambda a: K.adaptive_threshold(a, block_size, c, invert_, method), reach)


def canny_maxima(px, radius=1, sigma=None):
    """(img_id, y, x, c, m): float magnitude where it is a maximum along its direction, else 0."""
    return neighbourhood(px, lambda a: K.canny_maxima(a, radius, sigma), radius + 2, kind="float", name="m")


# ---- aggregates


def histogram(px):
    """(img_id, c, bin, n): dense bins; counts are combined before the shuffle."""
    counts = value_counts(px).select("img_id", "c", "v", "n") if is_packed(px) else px.groupBy("img_id", "c", "v").agg(F.count("*").alias("n"))
    planes = counts.select("img_id", "c").distinct()
    bins = planes.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(255))))
    counts = counts.withColumnRenamed("v", "bin")
    return bins.join(counts, ["img_id", "c", "bin"], "left").select("img_id", "c", "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def equalize(px):
    """A plane's counts are at most 256 rows; their running sums are looked up by the pixels."""
    counts = value_counts(px).select("img_id", "c", "v", F.col("n").alias("k")) if is_packed(px) else px.groupBy("img_id", "c", "v").agg(F.count("*").alias("k"))
    plane = Window.partitionBy("img_id", "c")
    cdf = counts.withColumn("cdf", F.sum("k").over(plane.orderBy("v"))).withColumn("n", F.sum("k").over(plane))
    cdf = cdf.withColumn("least", F.min("cdf").over(plane))
    flat = F.col("n") == F.col("least")
    to = F.when(flat, 0).otherwise(half_up_u8((F.col("cdf") - F.col("least")) / F.when(flat, 1).otherwise(F.col("n") - F.col("least")) * 255))
    if is_packed(px):
        return looked_up(px, cdf.select("img_id", "c", "v", to.cast("int").alias("to")))
    return px.join(cdf.select("img_id", "c", "v", to.cast("int").alias("to")), ["img_id", "c", "v"]).select("img_id", "y", "x", "c", F.col("to").alias("v"))


def normalize(px):
    if is_packed(px):
        counts, plane = value_counts(px), Window.partitionBy("img_id", "c")
        d = counts.withColumn("lo", F.min("v").over(plane)).withColumn("hi", F.max("v").over(plane))
        span = F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.col("hi") - F.col("lo"))
        return looked_up(px, d.select("img_id", "c", "v", trunc_u8((F.col("v") - F.col("lo")) / span * 255).cast("int").alias("to")))
    d = px.join(px.groupBy("img_id", "c").agg(F.min("v").alias("lo"), F.max("v").alias("hi")), ["img_id", "c"])
    span = F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.col("hi") - F.col("lo"))
    return value(d, trunc_u8((F.col("v") - F.col("lo")) / span * 255))


def integral(px, by_runs=False):
    """(img_id, y, x, s): (w + 1) x (h + 1) sums, with a zero row and column. by_runs: s is an array, the sums from x on."""
    d = prefix_sums(px.filter("c = 0"), by_runs=by_runs).select("img_id", (F.col("y") + 1).alias("y"), (F.col("x") + 1).alias("x"), "s")
    size = px.groupBy("img_id").agg(width_of(px).alias("w"), (F.max("y") + 1).alias("h"))
    none = F.lit(0).cast("long")
    if by_runs:
        border = size.select("img_id", "w", F.explode(F.sequence(F.lit(0), F.col("h"))).alias("y"))
        zeros = F.array_repeat(none, F.when(F.col("y") == 0, F.col("w") + 1).otherwise(1))
        return d.unionByName(border.select("img_id", "y", F.lit(0).alias("x"), zeros.alias("s")))
    top = size.select("img_id", F.lit(0).alias("y"), F.explode(F.sequence(F.lit(0), F.col("w"))).alias("x"), none.alias("s"))
    side = size.select("img_id", F.explode(F.sequence(F.lit(1), F.col("h"))).alias("y"), F.lit(0).alias("x"), none.alias("s"))
    return d.unionByName(top).unionByName(side)


def sum_rect(table, x, y, width, height):
    """(img_id, s): the four corners in one conditional sum."""
    sign = F.when((F.col("x") == x + width) & (F.col("y") == y + height), 1).when((F.col("x") == x) & (F.col("y") == y), 1).when((F.col("x") == x + width) & (F.col("y") == y), -1).when((F.col("x") == x) & (F.col("y") == y + height), -1)
    return table.filter(F.col("x").isin(x, x + width) & F.col("y").isin(y, y + height)).groupBy("img_id").agg(F.sum(F.col("s") * sign).alias("s"))


def filter_components(comps, min_area=1, max_area=None):
    ok = F.col("area") >= min_area
    return comps.filter(ok if max_area is None else ok & (F.col("area") <= max_area))


# ---- drawing


def painted(px, inside: Column, channels: int, colour=None):
    return value(px, F.when(inside, F.element_at(F.array(*map(F.lit, K.colour_values(channels, colour))), F.col("c") + 1)).otherwise(F.col("v")))


def _square(x, y, r) -> Column:
    return (F.abs(F.col("x") - x) <= r) & (F.abs(F.col("y") - y) <= r)


def draw_point(px, channels, x, y, colour=None, thickness=1):
    return painted(px, _square(half_up(x), half_up(y), thickness // 2), channels, colour)


def draw_points(px, channels, points, colour=None):
    """Points listed by the driver (as many as the shape has), joined by broadcast."""
    spark = px.sparkSession
    hits = spark.createDataFrame(sorted(points), "x int, y int").withColumn("hit", F.lit(True))
    return painted(px.join(F.broadcast(hits), ["x", "y"], "left"), F.coalesce("hit", F.lit(False)), channels, colour)


def draw_line(px, channels, x0, y0, x1, y1, colour=None, thickness=1):
    return draw_points(px, channels, K.brushed(K.line_points(x0, y0, x1, y1), thickness), colour)


def draw_circle(px, channels, cx, cy, radius, colour=None, thickness=1):
    return draw_points(px, channels, K.brushed(K.circle_points(cx, cy, radius), thickness), colour)


def on_border(px_x, px_y, x0, y0, x1, y1, r) -> Column:
    """Within r (by the larger coordinate) of the outline of a box."""
    near_y = px_y.between(F.least(y0, y1) - r, F.greatest(y0, y1) + r)
    near_x = px_x.between(F.least(x0, x1) - r, F.greatest(x0, x1) + r)
    return near_x & near_y & ((F.abs(px_x - x0) <= r) | (F.abs(px_x - x1) <= r) | (F.abs(px_y - y0) <= r) | (F.abs(px_y - y1) <= r))


def draw_rect(px, channels, x, y, width, height, colour=None, thickness=2):
    x0, y0, x1, y1 = (F.lit(half_up(v)) for v in (x, y, x + width - 1, y + height - 1))
    return painted(px, on_border(F.col("x"), F.col("y"), x0, y0, x1, y1, thickness // 2), channels, colour)


def draw_filled_rect(px, channels, x, y, width, height, colour=None):
    inside = F.col("x").between(half_up(x), half_up(x + width - 1)) & F.col("y").between(half_up(y), half_up(y + height - 1))
    return painted(px, inside, channels, colour)


def draw_filled_circle(px, channels, cx, cy, radius, colour=None):
    dx, dy, r = F.col("x") - half_up(cx), F.col("y") - half_up(cy), max(0, half_up(radius))
    return painted(px, dx * dx + dy * dy <= r * r, channels, colour)


def draw_boxes(px, channels, boxes: DataFrame, colour=None, thickness=2):
    """boxes: (img_id, x, y, width, height). The boxes of an image are one array, so the pixels take part in
    one join on the image, in none where that table is small enough to be broadcast."""
    b = boxes.groupBy("img_id").agg(F.collect_list(F.struct("x", "y", "width", "height")).alias("boxes"))
    r = thickness // 2
    border = F.exists("boxes", lambda b: on_border(F.col("x"), F.col("y"), b["x"], b["y"], b["x"] + b["width"] - 1, b["y"] + b["height"] - 1, r))
    return painted(px.join(b, "img_id", "left"), F.coalesce(border, F.lit(False)), channels, colour)


# ---- fused steps


def binomial_edges(px):
    return neighbourhood(px, K.binomial_edges, 2)
