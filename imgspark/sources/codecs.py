"""Formats by extension or by first bytes; decoding and encoding columns of files."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from imgspark.frame import SCHEMA, frames, from_arrays, step
from imgspark.operators import kernels as K
from imgspark.sources import jpeg, raster

EXTENSIONS = {".jpg": "jpg", ".jpeg": "jpg", ".png": "png", ".ppm": "ppm", ".bmp": "bmp"}
MAGIC = [(b"\xff\xd8", "jpg"), (raster.PNG_HEAD, "png"), (b"P6", "ppm"), (b"BM", "bmp")]


def format_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1].lower()
    ext = name[name.rfind(".") :] if "." in name else ""
    if ext not in EXTENSIONS:
        raise ValueError(f"Unsupported image format: {ext or path}")
    return EXTENSIONS[ext]


def sniff(data: bytes) -> str:
    for magic, fmt in MAGIC:
        if data.startswith(magic):
            return fmt
    raise ValueError("Unsupported image format")


def decode_bytes(data: bytes, path: str | None = None, resize: dict | None = None, shrink_on_load: bool = False) -> np.ndarray:
    """resize: width, height, fit, method; applied after decoding, to every format."""
    fmt = format_of(path) if path else sniff(data)
    if fmt == "jpg":
        target = None
        if resize:
            im = jpeg.parse(data, header_only=True)
            target = K.resolve_size(im.width, im.height, resize.get("width"), resize.get("height"), resize.get("fit", "exact"))
        f = jpeg.read_jpeg(data, target, shrink_on_load)
        return K.resize(f, *target, resize.get("method", "bilinear")) if target else f
    f = {"png": raster.read_png, "ppm": raster.read_ppm, "bmp": raster.read_bmp}[fmt](data)
    return K.resize_fit(f, resize.get("width"), resize.get("height"), resize.get("fit", "exact"), resize.get("method", "bilinear")) if resize else f


def encode_bytes(f: np.ndarray, fmt: str, quality: int = 85, progressive: bool = True, level: int = 1, filter: str = "none", restart_rows: int = 0) -> bytes:
    """Gray becomes RGB where the format has no gray; RGBA goes to PNG only."""
    if fmt == "png":
        return raster.write_png(f, level, filter)
    f = K.gray_to_rgb(f) if f.shape[2] == 1 else f
    if fmt == "jpg":
        return jpeg.write_jpeg(f, quality, progressive, restart_rows)
    return {"ppm": raster.write_ppm, "bmp": raster.write_bmp}[fmt](f)


def dims(data: bytes) -> tuple[int, int, int]:
    """(width, height, channels) from the header alone."""
    fmt = sniff(data)
    if fmt == "jpg":
        im = jpeg.parse(data, header_only=True)
        return im.width, im.height, len(im.parts)
    if fmt == "png":
        w, h, _, colour = struct.unpack_from(">IIBB", data, 16)
        clear = colour == 3 and any(k == b"tRNS" for k, _ in raster.png_chunks(data))
        return w, h, {0: 1, 2: 3, 3: 4 if clear else 3, 4: 4, 6: 4}[colour]
    if fmt == "bmp":
        w, h = struct.unpack_from("<ii", data, 18)
        return w, abs(h), struct.unpack_from("<H", data, 28)[0] // 8
    m = raster.PPM_HEAD.match(data)
    if not m:
        raise ValueError("bad PPM header")
    return int(m[1]), int(m[2]), 3


FILES = T.StructType([T.StructField("img_id", T.LongType()), T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType())])


def encode_frames(fr: DataFrame, fmt: str, **how) -> DataFrame:
    """(img_id, path, content) of each frame."""
    if fmt not in EXTENSIONS.values():
        raise ValueError(f"Unsupported image format: {fmt}")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(batch.num_rows):
                rows = [(r["img_id"], f"{r['img_id']}.{fmt}", encode_bytes(a, fmt, **how)) for r, a in frames(batch.slice(at, 1))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.binary()))], FILES.names)

    return fr.select(*SCHEMA.names).mapInArrow(run, FILES)


WITH_ERROR = T.StructType([*SCHEMA.fields, T.StructField("error", T.StringType())])
#: What a broken or unknown file raises while it is decoded.
BROKEN = (ValueError, IndexError, KeyError, TypeError, struct.error, zlib.error)


def path_id(path: str) -> int:
    """The id of a file, the same for each way of reading it; path_id_column says it in Catalyst."""
    local = re.sub("^file:/+", "/", path)
    return int(np.uint64(xxhash.xxh64_intdigest(local.encode(), seed=42)).view(np.int64))


def path_id_column(path: str = "path"):
    return F.xxhash64(F.regexp_replace(path, "^file:/+", "/"))


def decode_frames(files: DataFrame, resize: dict | None = None, shrink_on_load: bool = False, errors: str = "raise") -> DataFrame:
    """Frames of (path, content); img_id is taken over, or made from the path's hash.

    errors: what becomes of a file that can't be decoded. "raise" ends the job, as for one file;
    "drop" leaves it out; "column" adds a column `error`, null for good frames, and keeps the file
    as a row with its id and path alone. A null content counts as such a file.
    """
    if errors not in ("raise", "drop", "column"):
        raise ValueError("errors: raise, drop or column")
    ids = F.col("img_id") if "img_id" in files.columns else path_id_column()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(batch.num_rows):
                i, path, data = (c[0].as_py() for c in batch.slice(at, 1).columns)
                try:
                    a = decode_bytes(data if data is not None else b"", path, resize, shrink_on_load)
                except BROKEN as e:
                    if errors == "raise":
                        raise ValueError(f"{path}: {e}") from e
                    if errors == "column":
                        none = [pa.nulls(1, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.binary())]
                        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([path], pa.string()), *none, pa.array([f"{type(e).__name__}: {e}"])], WITH_ERROR.names)
                    continue
                good = from_arrays([(i, path, a)])
                yield good if errors != "column" else pa.RecordBatch.from_arrays([*good.columns, pa.nulls(1, pa.string())], WITH_ERROR.names)

    named = files.select(ids.cast("long").alias("img_id"), "path", "content")
    return step(named, named.columns, run, WITH_ERROR if errors == "column" else SCHEMA)


def header_dims(files: DataFrame) -> DataFrame:
    """(img_id, width, height, channels) without decoding."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(i, *dims(d)) for i, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), *[pa.int32()] * 3))], ["img_id", "width", "height", "channels"])

    return files.select("img_id", "content").mapInArrow(run, "img_id long, width int, height int, channels int")
