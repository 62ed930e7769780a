"""One PNG deflated by many tasks: bands of rows as rows of a table.

A band is deflated by itself, but primed with the last 32 KB of the rows before it, so it may refer back to them and the
joined stream is about as small as one that was deflated at once. Each band is an IDAT chunk with its own CRC; what
is left for the image as a whole is to put them in order and to combine the Adler-32 sums of the bands.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgspark.frame import assembled, gathered

#: Rows of a band, and bytes that a deflated stream may refer back to.
ROWS, WINDOW = 64, 32768
ADLER = 65521
PNG_HEAD = b"\x89PNG\r\n\x1a\n"


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def deflate_band(data: bytes, before: bytes, level: int, first: bool) -> bytes:
    """A part of a zlib stream, flushed to a byte; the first one has the stream's header."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15, zdict=before[-WINDOW:]) if before else zlib.compressobj(level, zlib.DEFLATED, -15)
    return (b"\x78\x9c" if first else b"") + z.compress(data) + z.flush(zlib.Z_SYNC_FLUSH)


def adler_combined(one: int, two: int, size: int) -> int:
    """The Adler-32 sum of a text whose first part has the sum one and whose second, of size bytes, the sum two."""
    a, b = (one & 0xFFFF) + (two & 0xFFFF) - 1, (one >> 16) + (two >> 16) + size * ((one & 0xFFFF) - 1)
    return (b % ADLER) << 16 | a % ADLER


def pixel_rows(px: DataFrame) -> DataFrame:
    """(img_id, y, w, n, b): each row of an image as bytes, where its pixels are."""
    if px.schema["v"].dataType.typeName() == "binary":
        return _run_rows(px)
    rows = px.groupBy("img_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", "c", "v"))).alias("p"), (F.max("x") + 1).alias("w"), (F.max("c") + 1).alias("n"))
    data = F.encode(F.array_join(F.transform("p", lambda s: F.char(s["v"])), ""), "ISO-8859-1")
    return rows.select("img_id", "y", "w", "n", data.alias("b"))


def _run_rows(px: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for (img, y), held in gathered(batches, ["img_id", "row"]):
            a = assembled(held)
            cols = [[img], [y], [a.shape[1]], [a.shape[2]], [a.tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["img_id", "y", "w", "n", "b"])

    n = int(px.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = px.select("img_id", F.col("y").alias("row"), "y", "x", "c", "v").repartition(n, "img_id", "row").sortWithinPartitions("img_id", "row")
    return dealt.mapInArrow(run, "img_id long, y int, w int, n int, b binary")


def png_files(px: DataFrame, level: int = 6, rows: int = ROWS, directory: str = "") -> DataFrame:
    """(img_id, path, content) of complete images in pixels of 1, 3 or 4 channels."""
    lines = pixel_rows(px)
    own = F.expr(f"y div {rows}")
    # as many rows before a band as the window holds, the filter's byte included
    reach = F.ceil(F.lit(WINDOW) / (F.col("w") * F.col("n") + 1))
    to = F.sequence(own, F.floor((F.col("y") + reach) / rows))
    dealt = lines.select("img_id", "w", "n", "y", "b", F.explode(to).alias("band"), own.alias("own"))

    def deflate(batches):
        import pyarrow as pa

        key, held, before, shape = None, [], [], None

        def made():
            data, first = b"".join(b"\0" + b for b in held), key[1] == 0
            part = deflate_band(data, b"".join(b"\0" + b for b in before), level, first)
            cols = [[key[0]], [key[1]], [shape[0]], [shape[1]], [len(held)], [chunk(b"IDAT", part)], [zlib.adler32(data)], [len(data)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()))], ["img_id", "band", "w", "n", "rows", "part", "adler", "size"])

        for batch in batches:
            for r in batch.to_pylist():
                if (r["img_id"], r["band"]) != key:
                    if held:
                        yield made()
                    key, held, before = (r["img_id"], r["band"]), [], []
                shape = (r["w"], r["n"])
                (held if r["own"] == r["band"] else before).append(r["b"])
        if held:
            yield made()

    sorted_ = dealt.repartition(int(px.sparkSession.conf.get("spark.sql.shuffle.partitions")), "img_id", "band").sortWithinPartitions("img_id", "band", "y")
    parts = sorted_.mapInArrow(deflate, "img_id long, band long, w int, n int, rows int, part binary, adler long, size long")
    files = parts.groupBy("img_id").agg(F.array_sort(F.collect_list(F.struct("band", "part", "adler", "size"))).alias("parts"), F.max("w").alias("w"), F.max("n").alias("n"), F.sum("rows").cast("int").alias("h"))

    def join(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                total = 1
                for p in r["parts"]:
                    total = adler_combined(total, p["adler"], p["size"])
                head = struct.pack(">IIBBBBB", r["w"], r["h"], 8, {1: 0, 3: 2, 4: 6}[r["n"]], 0, 0, 0)
                # an empty last block ends the stream, so no band has to know that it is the last
                end = chunk(b"IDAT", b"\x03\x00" + struct.pack(">I", total)) + chunk(b"IEND", b"")
                data = PNG_HEAD + chunk(b"IHDR", head) + b"".join(p["part"] for p in r["parts"]) + end
                yield pa.RecordBatch.from_arrays([pa.array([r["img_id"]], pa.int64()), pa.array([f"{directory}{r['img_id']}.png"]), pa.array([data], pa.binary())], ["img_id", "path", "content"])

    return files.mapInArrow(join, "img_id long, path string, content binary")
