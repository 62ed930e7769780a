"""Intermediate tables in the folder that all machines share, and Bloom filters of a bounded size."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from functools import wraps

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: log2 of the bits of a Bloom filter, least and most (64 MB), and bits for each key. A filter that
#: would have fewer than LEAST_BITS for each key is not built: everything then goes to the exact join.
BLOOM_LOG2 = (17, 29)
BITS, LEAST_BITS = 20, 4


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own where that is unset and all is on one machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = sc._jsc.sc().getCheckpointDir()
        named = current.get() if current.isDefined() else None
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        named = tempfile.mkdtemp(prefix="imgspark-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


#: Rows of an Arrow batch at most, as rows hold whole texts.
BATCH = 1000


def lean(run):
    """A function for mapInArrow whose memory goes back to the system at its end: Python workers
    stay for later tasks, and many of them share a machine."""

    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not a glibc system
        pass


class Scratch:
    """Cuts lineage by writing a table to the shared folder and reading it back.

    Written files survive lost executors. `drop` deletes a table that nothing lazy
    needs any more; the rest goes when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.top = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0
        path, fs = self._fs(self.top)
        fs.deleteOnExit(path)
        rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(rows)) <= BATCH:
            spark.conf.set(rows, BATCH)

    def _fs(self, where: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def cut(self, df: DataFrame) -> DataFrame:
        self.made += 1
        where = f"{self.top}/{self.made}"
        df.write.parquet(where)
        back = self.spark.read.schema(df.schema).parquet(where)
        back._scratch_path = where
        return back

    def release(self) -> None:
        """Lets Spark delete the shuffle files of plans that nobody holds any more, now rather than
        when the driver happens to collect its garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path, fs = self._fs(t._scratch_path)
            fs.delete(path, True)


def bloom_log2(n: int) -> int:
    """log2 of the bits for n keys."""
    return min(max((max(n, 1) * BITS - 1).bit_length(), BLOOM_LOG2[0]), BLOOM_LOG2[1])


def bloom_positions(key, log2: int):
    """Four bit positions for a long column."""
    a, b, mask = F.xxhash64(key, F.lit(1)), F.xxhash64(key, F.lit(2)), (1 << log2) - 1
    return F.array(*[F.shiftrightunsigned(x, n).bitwiseAND(F.lit(mask)) for x in (a, b) for n in (3, 35)])


def bloom_columns(words: np.ndarray, salt: int, log2: int):
    """Two of the same positions for an int64 array, in numpy: Spark's xxhash64 of (long, int)."""
    h = _xxh64_int(salt, _xxh64_long(words.view(np.uint64), np.uint64(42)))
    return [(h >> np.uint64(n)) & np.uint64((1 << log2) - 1) for n in (3, 35)]


P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x, r):
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _avalanche(h):
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def _xxh64_long(x, seed):
    with np.errstate(over="ignore"):
        h = seed + P5 + np.uint64(8)
        h = h ^ (_rotl(x * P2, 31) * P1)
        return _avalanche(_rotl(h, 27) * P1 + P4)


def _xxh64_int(x: int, seed):
    with np.errstate(over="ignore"):
        h = seed + P5 + np.uint64(4)
        h = h ^ (np.uint64(x) * P1)
        return _avalanche(_rotl(h, 23) * P2 + P3)


def build_bloom(keys: DataFrame, column: str) -> bytes | None:
    """The filter's bits for the keys of a written table, sized by their count; at most 64 MB reach the
    driver, however many keys. None, which stands for "any", if there are too many for a useful filter."""
    n = keys.count()
    log2 = bloom_log2(n)
    if n * LEAST_BITS > 1 << log2:
        return None
    rows = (
        keys.select(F.explode(bloom_positions(F.col(column), log2)).alias("p"))
        .groupBy(F.shiftright("p", 15).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(32767))).alias("bits"))
        .collect()
    )
    out = bytearray(1 << (log2 - 3))
    for bucket, bits in rows:
        out[bucket * 4096 : bucket * 4096 + len(bits)] = bits
    return bytes(out)


def broadcast_bloom(scratch: Scratch, keys: DataFrame, column: str):
    """The filter as a broadcast variable."""
    return scratch.spark.sparkContext.broadcast(build_bloom(keys, column))


def in_bloom(bits: bytes | None, values: np.ndarray) -> np.ndarray:
    """True where an int64 may be among the keys; never false for a key."""
    if bits is None:
        return np.ones(len(values), bool)
    bits, log2 = np.frombuffer(bits, np.uint8), len(bits).bit_length() + 2
    left = np.arange(len(values))
    for salt in (1, 2):  # the second pair of positions only for those that pass the first
        one, two = bloom_columns(np.ascontiguousarray(values[left]), salt, log2)
        left = left[_bit(bits, one) & _bit(bits, two)]
    hit = np.zeros(len(values), bool)
    hit[left] = True
    return hit


def _bit(bits: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


def split_by_keys(scratch: Scratch, df: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is surely not in keys, rows whose key may be): wide rows that
    need no join then need no shuffle either. A null key is surely not in keys. keys: a written table."""
    from pyspark.sql.functions import pandas_udf

    shared = broadcast_bloom(scratch, keys, key)

    @pandas_udf("boolean")
    def maybe(ids):
        import pandas as pd

        return pd.Series(in_bloom(shared.value, ids.to_numpy(np.int64)))

    # nulls are settled before, as a long column with nulls would reach pandas as doubles
    known = F.col(f"`{key}`").cast("long")
    mark = known.isNotNull() & maybe(F.coalesce(known, F.lit(0)))
    return df.filter(~mark), df.filter(mark)
