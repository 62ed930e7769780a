"""Frames as rows: img_id, origin, width, height, channels, data; and the way to pixels and back."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("img_id", T.LongType()), T.StructField("origin", T.StringType())] + [T.StructField(n, T.IntegerType()) for n in ("width", "height", "channels")] + [T.StructField("data", T.BinaryType())]
)
PX_SCHEMA = "img_id long, y int, x int, c int, v int"
#: Frames handed to Arrow at a time, as rows are large.
SLICE = 64


def to_array(width: int, height: int, channels: int, data: bytes) -> np.ndarray:
    """A checked frame: positive sides, 1, 3 or 4 channels, exactly as many bytes."""
    if width <= 0 or height <= 0 or channels not in (1, 3, 4) or len(data) != width * height * channels:
        raise ValueError(f"bad frame {width}x{height}x{channels} with {len(data)} bytes")
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def frames(batch):
    """(row, array) of a batch of frames."""
    for r in batch.to_pylist():
        yield r, to_array(r["width"], r["height"], r["channels"], r["data"])


def from_arrays(rows):
    """A batch from (img_id, origin, array)."""
    import pyarrow as pa

    ids, origins, arrays = zip(*rows)
    shape = list(zip(*((a.shape[1], a.shape[0], a.shape[2]) for a in arrays)))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(origins, pa.string()), *[pa.array(s, pa.int32()) for s in shape], pa.array([np.ascontiguousarray(a, np.uint8).tobytes() for a in arrays], pa.binary())],
        ["img_id", "origin", "width", "height", "channels", "data"],
    )


def step(df: DataFrame, names, run: Callable, schema) -> DataFrame:
    """run on the Arrow batches of the named columns. Right after another such step it becomes part of it, so that a task
    starts one Python process for both and batches do not pass through the JVM in between."""
    last = df.__dict__.get("_step")
    if last is None or df.is_cached or df.columns != list(names):
        source, f = df.select(*names), run
    else:
        source, first = last
        f = lambda batches: run(first(batches))
    out = source.mapInArrow(f, schema)
    out._step = source, f
    return out


def map_frames(fr: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """f on every frame, without a shuffle; a slice of frames is in memory at a time."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                yield from_arrays([(r["img_id"], r["origin"], f(a)) for r, a in frames(batch.slice(at, SLICE))])

    return step(fr, SCHEMA.names, run, SCHEMA)


def to_pixels(fr: DataFrame) -> DataFrame:
    """One row a pixel and channel: (img_id, y, x, c, v). With a column top, frames are bands of an image that
    start at that row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(batch.num_rows):
                for r, a in frames(batch.slice(at, 1)):
                    y, x, c = np.indices(a.shape, dtype=np.int32)
                    cols = [np.full(a.size, r["img_id"], np.int64), y.ravel() + np.int32(r.get("top", 0)), x.ravel(), c.ravel(), a.ravel().astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in cols], ["img_id", "y", "x", "c", "v"])

    return step(fr, [*SCHEMA.names, *[c for c in ("top",) if c in fr.columns]], run, PX_SCHEMA)


def from_pixels(px: DataFrame, origin: str = "pixels") -> DataFrame:
    """Frames from complete pixel sets, in Catalyst. Each row of an image becomes bytes first, wherever
    its pixels are; only those, a byte a sample, are brought together for the image. Packed pixels are such bytes."""
    if px.schema["v"].dataType.typeName() == "binary":
        return from_runs(px, origin)
    from imgspark.operators.tiles import tasks

    order = F.array_sort(F.collect_list(F.struct("x", "c", "v")))
    rows = px.groupBy("img_id", "y").agg(order.alias("p"), (F.max("x") + 1).alias("w"), (F.max("c") + 1).alias("n"))
    # one character a sample, encoded as one byte
    data = F.encode(F.array_join(F.transform("p", lambda s: F.char(s["v"])), ""), "ISO-8859-1")
    rows = rows.select("img_id", "y", "w", "n", data.alias("b"))
    # to a fixed number of tasks, as frames are few bytes for what is then done with them
    g = rows.repartition(tasks(px), "img_id").groupBy("img_id").agg(F.array_sort(F.collect_list(F.struct("y", "b"))).alias("r"), F.max("w").cast("int").alias("width"), (F.max("y") + 1).cast("int").alias("height"), F.max("n").cast("int").alias("channels"))
    whole = F.unhex(F.array_join(F.transform("r", lambda s: F.hex(s["b"])), ""))
    return g.select("img_id", F.lit(origin).alias("origin"), "width", "height", "channels", whole.alias("data"))


def assembled(held) -> np.ndarray:
    """An array of runs (y, x, c, bytes) of rows that are complete; the first row is the least y."""
    top, n = min(r[0] for r in held), max(r[2] for r in held) + 1
    a = np.zeros((max(r[0] for r in held) - top + 1, max(r[1] + len(r[3]) for r in held), n), np.uint8)
    for y, x, c, v in held:
        a[y - top, x : x + len(v), c] = np.frombuffer(v, np.uint8)
    return a


def gathered(batches, keys: list[str]):
    """(key, runs) of rows of packed pixels that are sorted by key; one key's runs are in memory."""
    key, held = None, []
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in (*keys, "y", "x", "c", "v")]
        for row in zip(*cols):
            if row[: len(keys)] != key:
                if held:
                    yield key, held
                key, held = row[: len(keys)], []
            held.append(row[len(keys) :])
    if held:
        yield key, held


def from_runs(px: DataFrame, origin: str = "pixels") -> DataFrame:
    """Frames from complete packed pixels: one exchange of bytes by image."""
    from imgspark.operators.tiles import tasks

    def run(batches):
        for (img,), held in gathered(batches, ["img_id"]):
            yield from_arrays([(img, origin, assembled(held))])

    dealt = px.select("img_id", "y", "x", "c", "v").repartition(tasks(px), "img_id").sortWithinPartitions("img_id")
    return step(dealt, dealt.columns, run, SCHEMA)


def to_runs(fr: DataFrame) -> DataFrame:
    """Packed pixels of frames, a run for each row and channel; a column top as for to_pixels."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(batch.num_rows):
                for r, a in frames(batch.slice(at, 1)):
                    h, w, n = a.shape
                    planes, top = np.ascontiguousarray(a.transpose(2, 0, 1)).tobytes(), r.get("top", 0)
                    v = [planes[i * w : (i + 1) * w] for i in range(n * h)]
                    cols = [np.full(n * h, r["img_id"], np.int64), np.tile(np.arange(top, top + h, dtype=np.int32), n), np.zeros(n * h, np.int32), np.repeat(np.arange(n, dtype=np.int32), h)]
                    yield pa.RecordBatch.from_arrays([*[pa.array(k) for k in cols], pa.array(v, pa.binary())], ["img_id", "y", "x", "c", "v"])

    return step(fr, [*SCHEMA.names, *[c for c in ("top",) if c in fr.columns]], run, "img_id long, y int, x int, c int, v binary")


def distances(a: DataFrame, b: DataFrame) -> DataFrame:
    """(img_id, n, worst) of each frame of a: its samples, and the largest difference from the frame of b with its id, 999
    where there is none of that shape. Frames meet as bytes; neither side is broadcast, as its size is hard to guess."""
    sides = [F.struct("width", "height", "channels").alias("shape"), "data"]
    other = b.select("img_id", *sides).toDF("img_id", "other", "got")
    met = a.select("img_id", *sides).join(other.hint("merge"), "img_id", "left")
    same = F.when(F.col("shape") == F.col("other"), F.col("got"))
    return distances_of(met.select("img_id", F.col("data").alias("v"), same.alias("got")))


def distances_of(pairs: DataFrame) -> DataFrame:
    """(img_id, n, worst) of (img_id, v, got), two strings of bytes: how many, and the largest difference, 999 where they are not alike."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for i, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                same = b is not None and len(a) == len(b)
                rows.append((i, len(a), int(np.abs(np.frombuffer(a, np.uint8).astype(np.int16) - np.frombuffer(b, np.uint8)).max(initial=0)) if same else 999))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.int64(), pa.int64(), pa.int32()))], ["img_id", "n", "worst"])

    return pairs.mapInArrow(run, "img_id long, n long, worst int")


def place_values(fr: DataFrame) -> DataFrame:
    """(origin, y, x, c, n, least, largest) over all frames of an origin: of each of its places, how many samples there are
    and between which values, added up in batches before the shuffle."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = {}
            for at in range(batch.num_rows):
                for r, a in frames(batch.slice(at, 1)):
                    t = found.get((r["origin"], a.shape))
                    if t is None:
                        found[r["origin"], a.shape] = [1, a.copy(), a.copy()]
                    else:
                        t[0] += 1
                        np.minimum(t[1], a, out=t[1])
                        np.maximum(t[2], a, out=t[2])
            for (origin, shape), (n, least, largest) in found.items():
                places = [k.ravel() for k in np.indices(shape, np.int32)]
                cols = [pa.array([origin] * least.size), *map(pa.array, places), pa.array(np.full(least.size, n, np.int64)), *[pa.array(v.ravel().astype(np.int32)) for v in (least, largest)]]
                yield pa.RecordBatch.from_arrays(cols, ["origin", "y", "x", "c", "n", "least", "largest"])

    parts = fr.select(*SCHEMA.names).mapInArrow(run, "origin string, y int, x int, c int, n long, least int, largest int")
    return parts.groupBy("origin", "y", "x", "c").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("largest").alias("largest"))


def from_spark_image(df: DataFrame, column: str = "image") -> DataFrame:
    """Frames from Spark's own image source, whose bytes are BGR(A)."""
    im = F.col(column)
    fr = df.select(F.monotonically_increasing_id().alias("img_id"), im["origin"].alias("origin"), im["width"].alias("width"), im["height"].alias("height"), im["nChannels"].alias("channels"), im["data"].alias("data"))
    return map_frames(fr, lambda a: a if a.shape[2] == 1 else a[..., [2, 1, 0, *range(3, a.shape[2])]])
