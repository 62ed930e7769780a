"""One JPEG read and written by many tasks, by its restart intervals.

Reading: where all scans of a file start an interval at the same row of blocks, the file can be cut. A band of rows becomes
a small JPEG of its own: the tables and headers of the whole, its own height, and of each scan the intervals of these rows.
Nothing is decoded for that; the bands are dealt to tasks as coded bytes, and any scans, progressive and refining ones too,
find in a band all that they refer to. Writing goes the other way: bands are coded by themselves with Huffman tables made for
the counts of the whole image, and strung together with restart markers.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imgspark.frame import SCHEMA
from imgspark.operators.kernels import gray_to_rgb
from imgspark.operators.tiles import tasks as to_tasks
from imgspark.sources import jpeg
from imgspark.sources.bands import pixel_rows
from imgspark.sources.codecs import BROKEN, path_id_column

#: Rows of pixels that a band has at least when read, and rows of blocks of an interval when written.
LEAST, ROWS = 64, 4


def cuts(im: jpeg.Image, least: int) -> list[int]:
    """Rows of units at which bands start, and the end; only [0, end] where the file can't be cut."""
    across, down = jpeg.measure(im)
    rows, fine = np.arange(down), np.ones(down, bool)
    for which, *_, restart, pieces in im.scans:
        per, all_ = _units(im, which)
        if restart and len(pieces) != -(-all_ // restart):
            return [0, down]  # intervals are missing, so their numbers say nothing
        fine &= rows * per % restart == 0 if restart else rows == 0
    starts, height = [0], 8 * im.vmax
    for r in np.flatnonzero(fine)[1:].tolist():
        if (r - starts[-1]) * height >= least:
            starts.append(r)
    return [*starts, down]


def _units(im: jpeg.Image, which) -> tuple[int, int]:
    """A scan's units in a row of the image's units, and in all."""
    c = which[0][0]
    if len(which) == 1:
        return c.v * c.across, c.across * c.down
    across, down = -(-im.width // (8 * im.hmax)), -(-im.height // (8 * im.vmax))
    return across, across * down


def split(data: bytes, least: int = LEAST):
    """(top, height of the whole, a complete JPEG of the rows from top on) of each band."""
    im = jpeg.parse(data)
    ends, unit = cuts(im, least), 8 * im.vmax
    # what applications noted is left out
    kept = [s for s in jpeg.segments(data) if not 0xE0 <= s[0] <= 0xEF and s[0] != 0xFE]
    for lo, hi in zip(ends, ends[1:]):
        out, scans = [b"\xff\xd8"], iter(im.scans)
        for mark, body, pieces in kept:
            if mark in (0xC0, 0xC1, 0xC2):
                body = body[:1] + struct.pack(">H", min(hi * unit, im.height) - lo * unit) + body[3:]
            out.append(jpeg.segment(mark, body))
            if pieces is not None:
                which, *_, restart, _ = next(scans)
                per, _ = _units(im, which)
                if restart and len(ends) > 2:
                    pieces = pieces[lo * per // restart : hi * per // restart if hi < ends[-1] else None]
                out.append(jpeg.restarted(pieces))
        yield lo * unit, im.height, b"".join([*out, b"\xff\xd9"])


BAND = "img_id long, origin string, top int, whole int, content binary"
BANDS = "img_id long, origin string, top int, whole int, width int, height int, channels int, data binary"


def jpeg_bands(files: DataFrame, least: int = LEAST, tasks: int | None = None, errors: str = "raise") -> DataFrame:
    """Bands of frames of (path, content), or (img_id, path, content): the columns of a frame, top (the first row) and
    whole (the image's height).

    A task cuts a file, by its markers alone; as coded bytes the bands are dealt to `tasks` (default:
    spark.sql.shuffle.partitions) by image and top, and decoded there. A file without restart intervals, or with too few,
    is one band. errors: "raise", or "drop" for all bands of a file that can't be cut and any band that can't be decoded."""
    if errors not in ("raise", "drop"):
        raise ValueError("errors: raise or drop")
    ids = F.col("img_id") if "img_id" in files.columns else path_id_column()

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(batch.num_rows):
                i, path, data = (c[0].as_py() for c in batch.slice(at, 1).columns)
                try:
                    for top, whole, part in split(data if data is not None else b"", least):
                        yield pa.RecordBatch.from_pydict({"img_id": pa.array([i], pa.int64()), "origin": pa.array([path], pa.string()), "top": pa.array([top], pa.int32()), "whole": pa.array([whole], pa.int32()), "content": pa.array([part], pa.binary())})
                except BROKEN as e:
                    if errors == "raise":
                        raise ValueError(f"{path}: {e}") from e

    def decode(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(batch.num_rows):
                part = batch.slice(at, 1)
                try:
                    a = jpeg.read_jpeg(part.column(4)[0].as_py())
                except BROKEN as e:
                    if errors == "raise":
                        raise ValueError(f"{part.column(1)[0]}: {e}") from e
                    continue
                shape = [pa.array([n], pa.int32()) for n in (a.shape[1], a.shape[0], a.shape[2])]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], *shape, pa.array([np.ascontiguousarray(a).tobytes()], pa.binary())], ["img_id", "origin", "top", "whole", "width", "height", "channels", "data"])

    spark = files.sparkSession
    parts = files.select(ids.cast("long").alias("img_id"), F.col("path").cast("string"), "content").mapInArrow(cut, BAND)
    # by a fixed number: coded bytes are few, and adaptive execution would bring them together again
    return parts.repartition(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")), "img_id", "top").mapInArrow(decode, BANDS)


def read_bands(spark: SparkSession, path: str, least: int = LEAST, recursive: bool = False, errors: str = "raise") -> DataFrame:
    """jpeg_bands of all JPEG files under a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,JPG,JPEG}").option("recursiveFileLookup", recursive).load(path)
    return jpeg_bands(files.select("path", "content"), least, errors=errors)


def join_bands(bands: DataFrame, count: str | None = None) -> DataFrame:
    """Whole frames; an image with a band missing is left out. count: a column for how many bands there were."""
    g = bands.repartition(to_tasks(bands), "img_id", "origin").groupBy("img_id", "origin").agg(F.array_sort(F.collect_list(F.struct("top", "height", "data"))).alias("b"), F.max("width").alias("width"), F.max("whole").alias("height"), F.max("channels").alias("channels"))
    full = g.where(F.aggregate("b", F.lit(0), lambda n, b: n + b["height"]) == F.col("height"))
    return full.select("img_id", "origin", "width", "height", "channels", F.unhex(F.array_join(F.transform("b", lambda s: F.hex(s["data"])), "")).alias("data"), *([F.size("b").alias(count)] if count else []))


def jpeg_files(px: DataFrame, quality: int = 85, progressive: bool = True, rows: int = ROWS, directory: str = "") -> DataFrame:
    """(img_id, path, content) of complete images in pixels of 1 or 3 channels, equal to write_jpeg with restart_rows=rows.

    A task transforms a band of `rows` rows of blocks. Its symbols are counted first, as an image has one set of Huffman tables;
    the counts, at most some hundred an image and scan, are added up and joined to the bands that code with them."""
    if not 1 <= rows <= 7:  # with 8, the widest image has more blocks in an interval than its header can say
        raise ValueError("rows: 1 to 7")
    scans = jpeg.SCANS[progressive]
    lines = pixel_rows(px).withColumn("band", F.expr(f"y div {8 * rows}"))
    # the join below asks for keys; asked for here too, both uses of the bands are one plan, whose exchange is made once
    lines = lines.where(F.col("img_id").isNotNull() & F.col("band").isNotNull())
    # to a fixed number of tasks here and below: bytes are few for the work on them, and adaptive execution would bring them together
    lines = lines.repartition(to_tasks(px), "img_id", "band")
    bands = lines.groupBy("img_id", "band").agg(F.array_sort(F.collect_list(F.struct("y", "b"))).alias("r"), F.max("w").cast("int").alias("w"), F.max("n").cast("int").alias("n"))

    def blocks(r):
        a = np.frombuffer(b"".join(line["b"] for line in r["r"]), np.uint8).reshape(len(r["r"]), r["w"], r["n"])
        return jpeg.quantised(gray_to_rgb(a) if r["n"] == 1 else a, quality)

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                comps = blocks(r)
                for s, scan in enumerate(scans):
                    seen = jpeg.symbol_counts(jpeg.scan_tokens(comps, *scan))
                    k = np.flatnonzero(seen)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), v), pa.int64()) for v in (r["img_id"], r["band"])] + [pa.array(np.full(len(k), s, np.int32)), pa.array(k.astype(np.int32)), pa.array(seen[k].astype(np.int64))], ["img_id", "band", "scan", "k", "seen"])

    def code(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                comps, heads, parts = blocks(r), [], []
                for s, scan in enumerate(scans):
                    seen = np.zeros(0x12 * 256, np.int64)
                    for c in r["counts"]:
                        if c["scan"] == s:
                            seen[c["k"]] = c["seen"]
                    head, codes = jpeg.scan_head(*scan, seen)
                    heads.append(head)
                    parts.append(jpeg.coded(jpeg.scan_tokens(comps, *scan), codes))
                yield pa.RecordBatch.from_pydict({"img_id": pa.array([r["img_id"]], pa.int64()), "band": pa.array([r["band"]], pa.int64()), "w": pa.array([r["w"]], pa.int32()), "h": pa.array([len(r["r"])], pa.int64()), "heads": pa.array([heads if r["band"] == 0 else None], pa.list_(pa.binary())), "parts": pa.array([parts], pa.list_(pa.binary()))})

    def join(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                step = rows * -(-r["w"] // 8)
                out = [jpeg.opening(r["w"], r["h"], quality, progressive, step)]
                for s in range(len(scans)):
                    out += [r["heads"][s], jpeg.restarted(p["parts"][s] for p in r["p"])]
                yield pa.RecordBatch.from_arrays([pa.array([r["img_id"]], pa.int64()), pa.array([f"{directory}{r['img_id']}.jpg"]), pa.array([b"".join([*out, b"\xff\xd9"])], pa.binary())], ["img_id", "path", "content"])

    counted = bands.mapInArrow(count, "img_id long, band long, scan int, k int, seen long")
    sums = counted.groupBy("img_id", "scan", "k").agg(F.sum("seen").alias("seen"), F.max("band").alias("last"))
    tables = sums.groupBy("img_id").agg(F.collect_list(F.struct("scan", "k", "seen")).alias("counts"), F.max("last").alias("last"))
    # one copy for each band, so that an image's bands stay dealt to many tasks
    dealt = tables.select("img_id", "counts", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("band"))
    parts = bands.join(dealt.hint("merge"), ["img_id", "band"]).mapInArrow(code, "img_id long, band long, w int, h long, heads array<binary>, parts array<binary>")
    whole = parts.repartition(to_tasks(px), "img_id").groupBy("img_id").agg(F.array_sort(F.collect_list(F.struct("band", "parts"))).alias("p"), F.max("w").alias("w"), F.sum("h").cast("int").alias("h"), F.max("heads").alias("heads"))
    return whole.mapInArrow(join, "img_id long, path string, content binary")
