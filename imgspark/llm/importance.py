"""Importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

A document's log weight is the sum over its words and word pairs of log p_target - log p_raw in
hashed buckets. The raw model counts all documents; the target model counts documents labelled
good. Adding a Gumbel draw, seeded by the id, and taking the k largest samples without replacement
in proportion to the weights. The k-th largest is found exactly by counting digits of the keys.

The number of buckets grows with the square root of the number of documents, as the number of
distinct words does (Heaps' law), up to MOST_BUCKETS, so that the tables stay small enough to send.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgspark.llm.scratch import Scratch, lean
from imgspark.llm.shingles import U, WordHashes, in_slices, mix, word_hashes

#: Buckets at least (up to 16,384 documents) and at most (a table of 32 MB).
LEAST_BUCKETS, MOST_BUCKETS = 1 << 14, 1 << 22
#: Labelled rows that the target model is fitted on, at most: those with the smallest hash.
MOST_LABELLED = 20_000


def bucket_count(documents: int) -> int:
    """A power of two near 128 times the square root of the number of documents."""
    return min(max(1 << round(7 + np.log2(max(documents, 1)) / 2), LEAST_BUCKETS), MOST_BUCKETS)


def buckets(text: bytes | None, table: WordHashes, n: int) -> np.ndarray:
    """Buckets, out of n, of the words and word pairs of a text."""
    h = word_hashes(text, table)
    one = mix(h + U(1))
    two = mix(mix(h[:-1]) + h[1:]) if len(h) > 1 else h[:0]
    return (np.concatenate([one, two]) >> U(64 - (n.bit_length() - 1))).astype(np.int64)


def gumbel(doc_id: int) -> float:
    u = (xxhash.xxh3_64_intdigest(str(doc_id).encode()) >> 11) + 0.5
    return float(-np.log(-np.log(u / 2.0**53)))


def ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as longs in the same order."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)


def model_counts(docs: DataFrame, good: set[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(target, raw) counts of n buckets; each task sends one row a bucket at most."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(good))

    def run(batches):
        import pyarrow as pa

        table, target, raw = WordHashes(), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for batch in in_slices(batches):
            every, labelled = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                every.append(buckets(text, table, n))
                if doc in shared.value:
                    labelled.append(every[-1])
            raw += np.bincount(np.concatenate(every), minlength=n)
            if len(labelled) > 1:
                target += np.bincount(np.concatenate(labelled), minlength=n)
        used = raw.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(target[used]), pa.array(raw[used])], ["b", "t", "r"])

    # columns of numbers: one row a bucket reaches the driver, 100 MB at MOST_BUCKETS
    rows = docs.mapInArrow(lean(run), "b long, t long, r long").groupBy("b").agg(F.sum("t").alias("t"), F.sum("r").alias("r")).toArrow()
    out = np.zeros((2, n))
    out[:, rows.column("b").to_numpy()] = rows.column("t").to_numpy(), rows.column("r").to_numpy()
    return out[0], out[1]


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw, each smoothed by one count a bucket."""
    n = len(raw)
    return np.log((target + 1) / (target.sum() + n)) - np.log((raw + 1) / (raw.sum() + n))


def scored(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches):
        import pyarrow as pa

        table, n = WordHashes(), len(shared.value)
        for batch in in_slices(batches):
            ids = batch.column(0)
            w = np.array([shared.value[buckets(t, table, n)].sum() for t in batch.column(1).cast(pa.binary()).to_pylist()], float)
            key = w + np.array([gumbel(i if i is not None else -1) for i in ids.to_pylist()])
            yield pa.RecordBatch.from_arrays([ids, pa.array(w), pa.array(ordered(key))], ["doc_id", "log_weight", "k"])

    return docs.mapInArrow(lean(run), "doc_id long, log_weight double, k long")


def kth_largest(keys: DataFrame, column: str, k: int) -> int:
    """The k-th largest long, exactly: four rounds of 16 bits, each with at most 65536 counts."""
    low, left = -(2**63), k
    for shift in (48, 32, 16, 0):
        high = low + (1 << (shift + 16)) - 1 if shift < 48 else 2**63 - 1
        part = keys.filter(F.col(column).between(low, high)).groupBy(F.shiftright(F.col(column), shift).alias("d")).count().collect()
        for d, n in sorted(part, reverse=True):
            if left <= n:
                low = d << shift
                break
            left -= n
    return low


def importance_sample(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """(doc_id, log_weight, kept) of every document.

    share: of the documents to keep; by default the share of good ones among all labels. The target
    model is fitted on at most MOST_LABELLED good labels. All documents are scored on their whole
    texts; null, empty and blank texts have weight 0. Repeated ids share a draw; keys that tie at the
    threshold are all kept; null ids draw alike and are kept or not like others. Without labels the
    models are equal in form and all documents with a share of 1 are kept. An empty table gives an
    empty table.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "importance")
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    known = labels.filter("quality is not null and doc_id is not null")
    good = known.filter("quality = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)
    ids = {r[0] for r in good.collect()}
    if share is None:
        share = known.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
        share = 1.0 if share is None else share
    total = base.count()
    out = scratch.cut(scored(base, log_ratio(*model_counts(base, ids, bucket_count(total)))))
    k = min(total, int(np.ceil(share * total)))
    least = kth_largest(out, "k", k) if k else 2**63 - 1
    return out.select("doc_id", F.round("log_weight", 6).alias("log_weight"), ((F.col("k") >= F.lit(least)) & F.lit(k > 0)).alias("kept"))
