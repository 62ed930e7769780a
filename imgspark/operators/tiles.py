"""Neighbourhoods over pixels by tiles with a halo, so that one large image is the work of many tasks.

A plane is cut into tiles of SIDE x SIDE. Every pixel goes to the tile that it lies in and to those whose halo
holds it; a numpy kernel then sees a tile as if it were a frame, and what it says of the tile's own pixels is
kept. Pixels at an image's border have no halo beyond it, so the kernel's own rule for borders holds there and
nowhere else. Before the one exchange, pixels become runs of bytes: neighbours in a row travel together at a
byte each. A task holds one tile at a time.

Pixels may be packed from the start: (img_id, y, x, c, v) where v is a run of bytes along x, x its first place.
What takes packed pixels gives packed pixels, where values are bytes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from imgspark.frame import step

#: Side of a tile. Halos larger than it are allowed; pixels then go to more tiles.
SIDE = 512
#: Rows that small tiles are gathered to before they are handed on.
ROWS = 20_000

RUNS = "img_id long, c int, ty int, tx int, y int, x int, v binary"
TILE = ["img_id", "c", "ty", "tx"]


def spread(at: np.ndarray, halo: int, side: int):
    """(row numbers, tiles): the tiles along an axis whose halo holds each place."""
    low, high = np.maximum(0, (at - halo) // side), (at + halo) // side
    n = high - low + 1
    row = np.repeat(np.arange(len(at)), n)
    return row, np.repeat(low, n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


PACKED = "img_id long, y int, x int, c int, v binary"
NAMES = ["img_id", "y", "x", "c", "v"]


def is_packed(px: DataFrame) -> bool:
    return px.schema["v"].dataType.typeName() == "binary"


#: Tasks a core that runs are dealt to.
A_CORE = 4


def tasks(px: DataFrame) -> int:
    """Tasks to deal runs to. A fixed number: they are few bytes for much work, and adaptive execution would bring
    them together again. No more than A_CORE a core: starting a Python task takes longer than a small image, and a
    task holds one tile, one frame or one batch however many come to it."""
    spark = px.sparkSession
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), A_CORE * spark.sparkContext.defaultParallelism))


def run_batch(img, y, x, c, v):
    """A batch of runs; v: a list of bytes."""
    import pyarrow as pa

    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip((img, y, x, c, v), kinds)], NAMES)


def row_runs(a: np.ndarray) -> list[bytes]:
    """The rows of height x width bytes."""
    data, w = np.ascontiguousarray(a, np.uint8).tobytes(), a.shape[1]
    return [data[i * w : (i + 1) * w] for i in range(a.shape[0])]


def flat(batch):
    """(bytes one after the other, length of each run) of a batch of runs."""
    data = batch.column(batch.schema.get_field_index("v")).to_pylist()
    return np.frombuffer(b"".join(data), np.uint8), np.fromiter(map(len, data), np.int64, len(data))


def unpack(px: DataFrame) -> DataFrame:
    """One row a pixel, of packed ones."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                v, n = flat(part)
                img, y, x, c = (np.repeat(part.column(k).to_numpy(), n) for k in range(4))
                x = x + np.arange(len(v)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([pa.array(k.astype(t)) for k, t in zip((img, y, x, c, v), (np.int64, *[np.int32] * 4))], NAMES)

    return step(px, NAMES, run, "img_id long, y int, x int, c int, v int")


#: Planes whose counts a task holds.
HELD = 256


def value_counts(px: DataFrame, keys=("img_id", "c", "v")) -> DataFrame:
    """(img_id, c, v, n, sy, sx) of packed pixels: how often a plane has a value, and the sums of its places, counted by
    tasks before the shuffle. keys: fewer of them, for sums over planes or images. The sums go to tasks(px) partitions: a
    task that writes few rows opened a file for each shuffle partition, which took longer than to count."""

    def given(held):
        import pyarrow as pa

        img, c = (np.repeat(np.array(k, t), 256) for k, t in zip(zip(*held), (np.int64, np.int32)))
        n, sy, sx = np.concatenate(list(held.values()), 1)
        at = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(a[at]) for a in (img, c, np.tile(np.arange(256, dtype=np.int32), len(held)), n, sy, sx)], ["img_id", "c", "v", "n", "sy", "sx"])

    def run(batches):
        held = {}
        for whole in batches:
            for batch in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
                v, n = flat(batch)
                img, y, x, c = (batch.column(k).to_numpy().astype(np.int64) for k in range(4))
                of = np.repeat(np.arange(len(n)) * 256, n) + v
                along = np.arange(len(v)) - np.repeat(np.cumsum(n) - n, n)
                # sums of whole numbers below 2 ** 53 are exact
                k, sx = (np.bincount(of, w, 256 * len(n)).astype(np.int64).reshape(-1, 256) for w in (None, along))
                planes, which = np.unique(np.stack([img, c]), axis=1, return_inverse=True)
                for p, plane in enumerate(map(tuple, planes.T.tolist())):
                    at = np.flatnonzero(which.ravel() == p)
                    held[plane] = held.get(plane, 0) + np.stack([k[at].sum(0), y[at] @ k[at], sx[at].sum(0) + x[at] @ k[at]])
                if len(held) > HELD:
                    yield given(held)
                    held = {}
        if held:
            yield given(held)

    parts = step(px, NAMES, run, "img_id long, c int, v int, n long, sy long, sx long")
    return parts.repartition(tasks(px), *keys).groupBy(*keys).agg(*[F.sum(n).alias(n) for n in ("n", "sy", "sx")])


def looked_up(px: DataFrame, to: DataFrame, side: int = SIDE) -> DataFrame:
    """Packed pixels through a table of each plane, to: (img_id, c, v, to) for the values that it has. A plane's table is
    one row for each band of `side` rows, so that bands of one image are dealt to many tasks."""
    last = px.groupBy("img_id", "c").agg(F.expr(f"max(y) div {side}").cast("int").alias("last"))
    listed = to.groupBy("img_id", "c").agg(F.map_from_entries(F.collect_list(F.struct("v", "to"))).alias("m"))
    byte = lambda v: F.lpad(F.hex(F.coalesce(F.element_at("m", v), F.lit(0))), 2, "0")
    table = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(255)), byte), "")).alias("to")
    bands = listed.select("img_id", "c", table).join(last, ["img_id", "c"]).select("img_id", "c", "to", F.explode(F.sequence(F.lit(0), "last")).alias("band"))
    met = px.withColumn("band", F.expr(f"cast(y div {side} as int)")).join(bands.hint("shuffle_hash"), ["img_id", "c", "band"])

    def run(batches):
        for batch in batches:
            out = [v.translate(table) for v, table in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())]
            yield run_batch(*batch.columns[:4], out)

    return step(met, [*NAMES, "to"], run, PACKED)


def _split(px: DataFrame, halo: int, side: int) -> DataFrame:
    """Packed pixels, cut at the tiles that need them; in Catalyst, so that no Python process is started for it."""
    tiles = lambda first, last: F.explode(F.expr(f"sequence(greatest(0, ({first} - {halo}) div {side}), ({last} + {halo}) div {side})"))
    met = px.select(*NAMES).where("length(v) > 0").withColumn("ty", tiles("y", "y")).withColumn("tx", tiles("x", "x + length(v) - 1"))
    start, stop = F.expr(f"greatest(x, tx * {side} - {halo})"), F.expr(f"least(x + length(v), (tx + 1) * {side} + {halo})")
    at = {"img_id": F.col("img_id"), "c": F.col("c"), "ty": F.col("ty"), "tx": F.col("tx"), "y": F.col("y"), "x": start}
    kinds = [k.split() for k in RUNS.split(", ")]
    cut = F.substring("v", (start - F.col("x") + 1).cast("int"), (stop - start).cast("int"))
    return met.select(*[at[n].cast(k).alias(n) for n, k in kinds[:-1]], cut.alias("v"))


def runs(px: DataFrame, halo: int, side: int = SIDE) -> DataFrame:
    """Pixels as runs along x for each tile that needs them; narrow."""
    if is_packed(px):
        return _split(px, halo, side)

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            img, y, x, c, v = (batch.column(n).to_numpy() for n in ("img_id", "y", "x", "c", "v"))
            row, ty = spread(y.astype(np.int64), halo, side)
            again, tx = spread(x[row].astype(np.int64), halo, side)
            row, ty = row[again], ty[again]
            keys = [img[row], c[row], ty, tx, y[row]]
            order = np.lexsort((x[row], *keys[::-1]))
            keys, at, v = [k[order] for k in keys], x[row][order], v[row][order].astype(np.uint8)
            new = np.ones(len(at), bool)
            new[1:] = np.diff(at) != 1
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            first = np.flatnonzero(new)
            data = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.append(first, len(at)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(v))])
            cols = [pa.array(keys[0][first].astype(np.int64)), *[pa.array(k[first].astype(np.int32)) for k in (*keys[1:], at)], data]
            yield pa.RecordBatch.from_arrays(cols, ["img_id", "c", "ty", "tx", "y", "x", "v"])

    return px.select("img_id", "y", "x", "c", "v").mapInArrow(pack, RUNS)


def groups(batches):
    """((img_id, c, ty, tx), y0, x0, array) of every tile of rows that are sorted by tile, halo included."""
    held, key = [], None

    def built():
        y0, x0 = min(h[0] for h in held), min(h[1] for h in held)
        a = np.zeros((max(h[0] for h in held) - y0 + 1, max(h[1] + len(h[2]) for h in held) - x0), np.uint8)
        for y, x, v in held:
            a[y - y0, x - x0 : x - x0 + len(v)] = np.frombuffer(v, np.uint8)
        return key, y0, x0, a

    for batch in batches:
        cols = [batch.column(n).to_pylist() for n in ("img_id", "c", "ty", "tx", "y", "x", "v")]
        for i, c, ty, tx, y, x, v in zip(*cols):
            if (i, c, ty, tx) != key:
                if held:
                    yield built()
                held, key = [], (i, c, ty, tx)
            held.append((y, x, v))
    if held:
        yield built()


def by_tile(packed: DataFrame) -> DataFrame:
    """The exchange: runs of a tile together, one tile after the other."""
    return packed.repartition(tasks(packed), *TILE).sortWithinPartitions(*TILE)


class Rows:
    """Gathers rows of small tiles into batches of a useful size."""

    def __init__(self, names: list[str], kinds: list):
        self.names, self.kinds, self.parts, self.n = names, kinds, [], 0

    def add(self, *columns):
        self.parts.append(columns)
        self.n += len(columns[0])

    def taken(self, least: int = ROWS):
        import pyarrow as pa

        if self.n and self.n >= least:
            cols = [pa.array(np.concatenate(c).astype(k)) for c, k in zip(zip(*self.parts), self.kinds)]
            self.parts, self.n = [], 0
            yield pa.RecordBatch.from_arrays(cols, self.names)


def own_part(key, y0: int, x0: int, a: np.ndarray, side: int):
    """(y, x, cut): the tile's own pixels, where there are any."""
    _, _, ty, tx = key
    top, left = max(ty * side, y0), max(tx * side, x0)
    bottom, right = min((ty + 1) * side, y0 + a.shape[0]), min((tx + 1) * side, x0 + a.shape[1])
    if bottom <= top or right <= left:
        return None
    return top, left, a[top - y0 : bottom - y0, left - x0 : right - x0]


def neighbourhood(px: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], halo: int, side: int = SIDE, kind: str = "int", name: str = "v") -> DataFrame:
    """kernel on every plane of px (complete planes), tile by tile: it takes a height x width x 1 array of bytes,
    gives one value a pixel, and looks no further than halo. (img_id, y, x, c, <name>); packed pixels stay packed where
    values are whole numbers."""
    packed = is_packed(px) and kind == "int"

    def run(batches):
        rows = Rows(["img_id", "y", "x", "c", name], [np.int64, np.int32, np.int32, np.int32, np.float32 if kind == "float" else np.int32])
        for key, y0, x0, a in groups(batches):
            if own_part(key, y0, x0, a, side) is None:
                continue
            y, x, v = own_part(key, y0, x0, np.asarray(kernel(a[..., None])).reshape(a.shape), side)
            if packed:
                m = len(v)
                yield run_batch([key[0]] * m, np.arange(y, y + m), [x] * m, [key[1]] * m, row_runs(v))
                continue
            ys, xs = np.indices(v.shape, np.int32)
            rows.add(np.full(v.size, key[0]), (ys + y).ravel(), (xs + x).ravel(), np.full(v.size, key[1]), v.ravel())
            yield from rows.taken()
        yield from rows.taken(1)

    tiled = by_tile(runs(px, halo, side))
    return step(tiled, tiled.columns, run, f"img_id long, y int, x int, c int, {name} {'binary' if packed else kind}")


# ---- prefix sums in two levels


def integral(px: DataFrame, side: int = SIDE, by_runs: bool = False) -> DataFrame:
    """(img_id, c, y, x, s): sums of all pixels above and to the left, the pixel included, without a window over an
    image. Tiles sum inside; what a tile needs from outside is, for each of its columns, the sum of the tiles above,
    for each of its rows, that of the tiles to the left, and one number for the tiles before it both ways. These
    carries are 2 * side + 1 numbers a tile, added up along rows and columns of tiles. by_runs: s is an array, the
    sums of a tile's row from x on."""
    packed = by_tile(runs(px, 0, side))

    def ends(batches):
        rows = Rows(["img_id", "c", "ty", "tx", "way", "p", "s"], [np.int64, np.int32, np.int32, np.int32, np.int32, np.int32, np.int64])
        for key, y0, x0, a in groups(batches):
            down, right = a.sum(0, dtype=np.int64).cumsum(), a.sum(1, dtype=np.int64).cumsum()
            _, _, ty, tx = key
            tall, wide = a.shape[0] == side or ty > 0, a.shape[1] == side or tx > 0  # else it is the only one that way
            for way, s in ((0, down[: tall * side]), (1, right[: wide * side]), (2, down[-1:] if tall and wide else down[:0])):
                rows.add(*[np.full(len(s), k) for k in key], np.full(len(s), way), np.arange(len(s)), s)
            yield from rows.taken()
        yield from rows.taken(1)

    parts = packed.mapInArrow(ends, "img_id long, c int, ty int, tx int, way int, p int, s long")
    before = (Window.unboundedPreceding, -1)
    along = lambda *keys: Window.partitionBy("img_id", "c", "way", "p", keys[0]).orderBy(keys[1]).rowsBetween(*before)
    # of a column of tiles, and of a row of tiles: one place of their carries a group; one exchange for all
    across = F.col("way") == 1
    line, at = F.when(across, F.col("ty")).otherwise(F.col("tx")), F.when(across, F.col("tx")).otherwise(F.col("ty"))
    once = parts.withColumn("line", line).withColumn("at", at).withColumn("s", F.sum("s").over(along("line", "at")))
    both = once.filter("way = 2").withColumn("s", F.sum("s").over(along("ty", "tx")))
    carried = once.filter("way < 2").unionByName(both).filter("s IS NOT NULL")
    carries = carried.groupBy(*TILE).agg(F.array_sort(F.collect_list(F.struct("way", "p", "s"))).alias("carry")).select(*TILE, F.transform("carry", lambda t: F.struct(t["way"], t["s"])).alias("carry"))
    # the tile's runs as one row, to meet its carries
    whole = packed.groupBy(*TILE).agg(F.collect_list(F.struct("y", "x", "v")).alias("runs"))

    def run(batches):
        import pyarrow as pa

        rows = Rows(["img_id", "c", "y", "x", "s"], [np.int64, np.int32, np.int32, np.int32, np.int64])
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                y0, x0 = min(t["y"] for t in r["runs"]), min(t["x"] for t in r["runs"])
                a = np.zeros((max(t["y"] for t in r["runs"]) - y0 + 1, max(t["x"] + len(t["v"]) for t in r["runs"]) - x0), np.int64)
                for t in r["runs"]:
                    a[t["y"] - y0, t["x"] - x0 : t["x"] - x0 + len(t["v"])] = np.frombuffer(t["v"], np.uint8)
                s = a.cumsum(0).cumsum(1)
                carry = {0: [], 1: [], 2: []}
                for t in r["carry"] or []:
                    carry[t["way"]].append(t["s"])
                if carry[0]:
                    s += np.array(carry[0], np.int64)[None, : s.shape[1]]
                if carry[1]:
                    s += np.array(carry[1], np.int64)[: s.shape[0], None]
                s += sum(carry[2])
                if by_runs:
                    m, n = s.shape
                    sums = pa.ListArray.from_arrays(pa.array(np.arange(0, m * n + 1, n, dtype=np.int32)), pa.array(s.ravel()))
                    cols = [pa.array(k) for k in (np.full(m, r["img_id"], np.int64), np.full(m, r["c"], np.int32), np.arange(y0, y0 + m, dtype=np.int32), np.full(m, x0, np.int32))]
                    yield pa.RecordBatch.from_arrays([*cols, sums], rows.names)
                    continue
                ys, xs = np.indices(s.shape, np.int32)
                rows.add(np.full(s.size, r["img_id"]), np.full(s.size, r["c"]), (ys + y0).ravel(), (xs + x0).ravel(), s.ravel())
                yield from rows.taken()
        yield from rows.taken(1)

    return whole.join(carries, TILE, "left").mapInArrow(run, f"img_id long, c int, y int, x int, s {'array<long>' if by_runs else 'long'}")


# ---- resampling


def gather(px: DataFrame, width: int, height: int, scale, box, sample, side: int = SIDE) -> DataFrame:
    """width x height targets of every plane, tile by tile: a target tile asks for the source tiles that it needs, runs
    of these come to it in one exchange, and numpy resamples.

    scale(h, w): source places for each target place, (down, across), as columns; target tiles shrink by it, so
    that what a tile asks for stays about as large as a tile. box(top, left, bottom, right, h, w): columns for the
    first and last source row and column that a target tile may use. sample(part, y0, x0, h, w, box): its values."""
    packed = is_packed(px)
    end = F.max(F.col("x") + F.length("v")) if packed else F.max("x") + 1
    sizes = px.groupBy("img_id", "c").agg(end.alias("w"), (F.max("y") + 1).alias("h"))
    down, across = scale(F.col("h"), F.col("w"))
    stride = lambda s, n: F.greatest(F.lit(1), F.least(F.lit(n), F.floor(side / F.greatest(s, F.lit(1.0))))).cast("int")
    grid = sizes.withColumn("ys", stride(down, height)).withColumn("xs", stride(across, width))
    grid = grid.withColumn("ty", F.explode(F.sequence(F.lit(0), F.expr(f"cast(({height} - 1) div ys as int)")))).withColumn("tx", F.explode(F.sequence(F.lit(0), F.expr(f"cast(({width} - 1) div xs as int)"))))
    grid = grid.withColumn("top", F.col("ty") * F.col("ys")).withColumn("left", F.col("tx") * F.col("xs"))
    grid = grid.withColumn("bottom", F.least(F.lit(height), F.col("top") + F.col("ys"))).withColumn("right", F.least(F.lit(width), F.col("left") + F.col("xs")))
    about = [*TILE, "top", "left", "bottom", "right", "h", "w"]
    y0, y1, x0, x1 = box(*[F.col(n) for n in about[4:]])
    asked = grid.select(*about, F.greatest(F.lit(0), y0).cast("int").alias("y0"), F.least(F.col("h") - 1, y1).cast("int").alias("y1"), F.greatest(F.lit(0), x0).cast("int").alias("x0"), F.least(F.col("w") - 1, x1).cast("int").alias("x1")).filter("y0 <= y1 AND x0 <= x1")
    asked = asked.withColumn("sy", F.explode(F.expr(f"sequence(y0 div {side}, y1 div {side})"))).withColumn("sx", F.explode(F.expr(f"sequence(x0 div {side}, x1 div {side})")))
    source = runs(px, 0, side).select("img_id", "c", F.col("ty").cast("long").alias("sy"), F.col("tx").cast("long").alias("sx"), "y", "x", "v")
    hit = asked.join(source.hint("merge"), ["img_id", "c", "sy", "sx"]).filter("y BETWEEN y0 AND y1").select(*about, "y", "x", "v")
    # every target tile is there, also where it asks for nothing
    nothing = [F.lit(None).cast(k).alias(n) for n, k in (("y", "int"), ("x", "int"), ("v", "binary"))]
    rows = grid.select(*about, *nothing).unionByName(hit).repartition(tasks(px), *TILE).sortWithinPartitions(*TILE)

    def run(batches):
        out = Rows(["img_id", "y", "x", "c", "v"], [np.int64, np.int32, np.int32, np.int32, np.int32])
        held, key = [], None

        def made():
            img, c, _, _, top, left, bottom, right, h, w = key
            y, x = min((r[0] for r in held), default=0), min((r[1] for r in held), default=0)
            a = np.zeros((max((r[0] for r in held), default=0) - y + 1, max((r[1] + len(r[2]) for r in held), default=1) - x, 1), np.uint8)
            for at, start, v in held:
                a[at - y, start - x : start - x + len(v), 0] = np.frombuffer(v, np.uint8)
            v = np.asarray(sample(a, y, x, h, w, (top, left, bottom, right))).reshape(bottom - top, right - left)
            if packed:
                m = len(v)
                return [run_batch([img] * m, np.arange(top, bottom), [left] * m, [c] * m, row_runs(v))]
            ys, xs = np.indices(v.shape, np.int32)
            out.add(np.full(v.size, img), (ys + top).ravel(), (xs + left).ravel(), np.full(v.size, c), v.ravel())
            return out.taken()

        for batch in batches:
            cols = [batch.column(n).to_pylist() for n in (*about, "y", "x", "v")]
            for *this, y, x, v in zip(*cols):
                if tuple(this) != key:
                    if key is not None:
                        yield from made()
                    held, key = [], tuple(this)
                if v is not None:
                    held.append((y, x, v))
        if key is not None:
            yield from made()
        yield from out.taken(1)

    return step(rows, rows.columns, run, PACKED if packed else "img_id long, y int, x int, c int, v int")
