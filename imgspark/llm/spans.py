"""Substring dedup by sliding sentence spans.

Every run of several consecutive sentences is hashed (128 bits); runs are joined over all
documents, and the sentences under any run that is not the first of its kind are removed, where
such runs together cover a span of LEAST words.

A sentence ends with a line, or with a word that ends in a full stop, question or exclamation
mark (and marks after it). A long sentence is cut further where the hash of two neighbouring words
says so, away from its ends, and after MOST words at the latest. Every cut depends on words near
it only, so a passage that is set into the middle of other sentences is still cut alike inside.

A run closes at its second sentence or later, once it has RUN words. Runs are taken forward from
every sentence and backward from every sentence, so that they cover a passage to both its ends.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from imgspark.llm.partenum import PACKED, _repeated, bucket_log2, packed_names, short_names
from imgspark.llm.scratch import Scratch, broadcast_bloom, in_bloom, lean, split_by_keys
from imgspark.llm.shingles import U, in_slices, mix

#: Words of a run, of the shortest span that goes, and of the longest piece of a sentence. A passage that is set
#: into other sentences loses a piece at either end, so a span is shorter than what is to be found (51 words).
RUN, LEAST, MOST = 16, 39, 16
#: No cut inside a sentence within NEAR words of its ends; beyond, one place of ONE_IN is a cut.
NEAR, ONE_IN = 3, 3
ENDING = re.compile(r"[.!?][^\w]*$")
WORD = re.compile(r"\S+")


class Words(dict):
    """Lower-cased word -> hash whose lowest bit tells that a sentence ends; emptied at `most` words."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        ends = word[-1] in ".!?" or not word[-1].isalnum() and ENDING.search(word)
        self[word] = h = h | 1 if ends else h & ~1
        return h


class Pieces:
    """Sentences, or parts of long ones, of several texts: words h, piece i from starts[i] to ends[i],
    and the pieces of text t from first[t] to first[t + 1]."""

    def __init__(self, texts: list[str | None], table: Words):
        words: list[str] = []
        lines, texts_end = [0], []
        for text in texts:
            if text:
                for line in text.lower().split("\n"):
                    words += line.split()
                    lines.append(len(words))
            texts_end.append(len(words))
        n = len(words)
        self.h = h = np.fromiter(map(table.__getitem__, words), U, n)
        whole = np.append((h & U(1)).astype(bool), False)
        whole[np.array(lines) - 1] = True
        ends = np.flatnonzero(whole[:n]) + 1
        # words of the same sentence before and after each place
        size = np.diff(ends, prepend=0)
        after = np.repeat(ends, size) - np.arange(1, n + 1)
        before = np.repeat(size, size) - after
        cut = np.zeros(n, bool)
        cut[1:] = mix(h[1:] + h[:-1] * U(3)) % U(ONE_IN) == 0
        cut &= (before > NEAR) & (after > NEAR)
        ends = np.flatnonzero(whole[:n] | cut) + 1
        size = np.diff(ends, prepend=0)
        more = (size - 1) // MOST
        if more.any():
            begin = np.repeat(ends - size, more)
            nth = np.arange(len(begin)) - np.repeat(np.cumsum(more) - more, more) + 1
            ends = np.sort(np.concatenate([ends, begin + nth * MOST]))
        self.ends = ends
        self.starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)]
        self.first = np.concatenate([[0], np.searchsorted(ends, np.array(texts_end, np.int64), "right")])

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first, last + 1, keys) of each run, as numbers of pieces; keys has two columns."""
        n, starts, ends = len(self.ends), self.starts, self.ends
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        low, high = self.first[text], self.first[text + 1]
        i = np.arange(n)
        to = np.maximum(i + 2, np.searchsorted(ends, starts + RUN) + 1)
        since = np.minimum(i - 1, np.searchsorted(starts, ends - RUN, "right") - 1)
        ahead = to <= high
        # a run that closes backward, unless it is one that closes forward too
        back = since >= low
        back[back] = to[since[back]] != i[back] + 1
        a, b = np.concatenate([i[ahead], since[back]]), np.concatenate([to[ahead], i[back] + 1])
        lo, hi = starts[a], ends[b - 1]
        keys = np.empty((len(a), 2), U)
        # the words of a run as digits: a difference of prefix sums, moved to the first place
        for c, (base, inverse) in enumerate(FACTORS):
            sums = np.zeros(len(self.h) + 1, U)
            np.cumsum(self.h * powers(base, len(self.h)), out=sums[1:])
            keys[:, c] = mix((sums[hi] - sums[lo]) * powers(inverse, len(self.h))[lo] + (hi - lo).astype(U))
        return text[a], a, b, keys.view(np.int64)


def powers(base: int, n: int, made: dict = {}) -> np.ndarray:  # noqa: B006
    """base^0 .. base^(n - 1) modulo 2^64, kept for later calls."""
    if base not in made or len(made[base]) < n:
        a = np.full(max(n, 4096), base, U)
        a[0] = 1
        made[base] = np.cumprod(a)
    return made[base][:n]


#: Odd factors of the two hashes and their inverses modulo 2^64.
FACTORS = tuple((b, pow(b, -1, 2**64)) for b in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))


def within(text: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """One number for a key in a text."""
    return mix(mix(keys[:, 0].view(U) + text.astype(U) * U(0x9E3779B97F4A7C15)) + keys[:, 1].view(U))


def grouped(texts: list, most: int = 400_000):
    """Ranges of texts of a bounded number of characters together, one text at least."""
    at = n = 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n > most:
            yield at, i + 1
            at, n = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _names(log2: int):
    """(bucket, part): the short names of all runs, four bytes for each; partenum's _repeated finds those that occur twice."""

    def run(batches):
        table, held, n = Words(), [], 0
        for batch in in_slices(batches):
            batch = batch.filter(batch.column(0).is_valid())
            texts = batch.column(1).to_pylist()
            for i, j in grouped(texts):
                keys = Pieces(texts[i:j], table).runs()[3]
                if len(keys):
                    held.append(keys[:, 0].view(U))
                    n += len(keys)
                if n >= PACKED:
                    yield packed_names(held, log2)
                    held, n = [], 0
        if held:
            yield packed_names(held, log2)

    return lean(run)


def _runs(bloom, log2: int):
    """(k1, k2, doc_id, own) of the runs whose short name a Bloom filter holds, once for a text; own: a row,
    under a key of its own, for each document that repeats a run itself."""

    def run(batches):
        import pyarrow as pa

        table = Words()
        for batch in in_slices(batches):
            batch = batch.filter(batch.column(0).is_valid())
            docs, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for i, j in grouped(texts):
                text, _, _, keys = Pieces(texts[i:j], table).runs()
                if not len(keys):
                    continue
                order = np.argsort(one := within(text, keys))
                again = order[1:][one[order[1:]] == one[order[:-1]]]
                own = docs[i:j][np.unique(text[again])]
                mark = mix(own.view(U)).view(np.int64)
                hit = in_bloom(bloom.value, short_names(keys[:, 0].view(U), log2).view(np.int64))
                hit[again] = False
                cols = [np.concatenate([keys[hit, 0], mark]), np.concatenate([keys[hit, 1], mark]), np.concatenate([docs[i:j][text[hit]], own]), np.arange(hit.sum() + len(own)) >= hit.sum()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["k1", "k2", "doc_id", "own"])

    return lean(run)


def merged(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Runs that overlap or touch as one: (first, last + 1), in order."""
    out: list[tuple[int, int]] = []
    for a, b in zip(first.tolist(), last.tolist()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def clean(texts: list[str | None], which: np.ndarray, later: np.ndarray, table: Words) -> list[tuple[str | None, int, list[tuple[int, int]]]]:
    """(kept text, pieces removed, removed spans as places of characters) of each text.

    later: keys of runs that an earlier document has, in two columns, for the texts numbered `which`. A
    run that the text repeats itself goes from its second place on. White space after a removed
    piece goes with it.
    """
    p = Pieces(texts, table)
    text, a, b, keys = p.runs()
    order = np.lexsort((b, a))
    text, a, b, keys = text[order], a[order], b[order], keys[order]
    one = within(text, keys)
    gone = np.isin(one, within(which, later)) if len(later) else np.zeros(len(one), bool)
    again = np.ones(len(one), bool)
    again[np.unique(one, return_index=True)[1]] = False
    gone |= again
    out: list = [(t, 0, []) for t in texts]
    cuts = np.searchsorted(text[gone], np.arange(len(texts) + 1))
    a, b = a[gone], b[gone]
    for t in np.flatnonzero(np.diff(cuts)).tolist():
        spans = [(x, y) for x, y in merged(a[cuts[t] : cuts[t + 1]], b[cuts[t] : cuts[t + 1]]) if p.ends[y - 1] - p.starts[x] >= LEAST]
        if spans:
            whole, zero = texts[t], p.starts[p.first[t]]
            at = [m.start() for m in WORD.finditer(whole)] + [len(whole)]
            chars = [(at[p.starts[x] - zero], at[p.ends[y - 1] - zero]) for x, y in spans]
            kept = [whole[i:j] for i, j in zip([0, *(y for _, y in chars)], [*(x for x, _ in chars), len(whole)])]
            out[t] = ("".join(kept), sum(y - x for x, y in spans), chars)
    return out


def _clean(schema: T.StructType, at: int, joined: bool):
    """Rows (keys, columns...) -> columns, _s_text, _s_removed, _s_spans; without keys if not joined."""

    def run(batches):
        import pyarrow as pa

        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, table = to_arrow_schema(schema), Words()
        for part in in_slices(batches):
            texts = part.columns[at + joined].to_pylist()
            for i, j in grouped(texts):
                rows = part.slice(i, j - i)
                which, later = np.empty(0, np.int64), np.empty((0, 2), np.int64)
                if joined:
                    lists = rows.column(0).fill_null([])
                    which = np.repeat(np.arange(j - i), lists.value_lengths().to_numpy())
                    later = np.column_stack([c.to_numpy() for c in lists.flatten().flatten()])
                got = clean(texts[i:j], which, later, table)
                new = [pa.array([x[0] for x in got], arrow.field("_s_text").type), pa.array([x[1] for x in got], pa.int32()), pa.array([[{"start": a, "end": b} for a, b in x[2]] for x in got], arrow.field("_s_spans").type)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*rows.columns[joined:], *new], arrow)], schema=arrow)

    return lean(run)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs plus _s_text (cleaned), _s_removed (sentences removed) and _s_spans (places of their characters).

    A run's first occurrence is the one in the smallest id, and there the first place; it stays.
    Comparison ignores case and the amount of white space. Null and empty texts stay as they are.
    A row with a null id takes no part in the join; only what it repeats itself is removed. Rows
    with an equal id count as one document. All columns stay; a column of docs that starts with _s_
    is an error. An empty table gives an empty table. The run table is aggregated before it is joined
    back, so a run that many documents share makes one row per document and partition, never a group
    in memory; the texts of documents without any repeated run are neither shuffled nor read again.
    """
    if clash := [c for c in docs.columns if c.startswith("_s_")]:
        raise ValueError(f"columns that dedup_spans makes itself: {clash}")
    scratch = Scratch(docs.sparkSession, "spans")
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # of all runs only short names are shuffled, four bytes each; then those that may be repeated, as they are
    log2 = bucket_log2((base.agg(F.sum(F.length("text"))).first()[0] or 0) // RUN)
    names = base.mapInArrow(_names(log2), "bucket int, part binary").repartition("bucket").sortWithinPartitions("bucket")
    twice = scratch.cut(names.mapInArrow(lean(_repeated), "sig long"))
    del names
    scratch.release()
    bloom = broadcast_bloom(scratch, twice, "sig")
    scratch.drop(twice)
    maybe = scratch.cut(base.mapInArrow(_runs(bloom, log2), "k1 long, k2 long, doc_id long, own boolean"))
    first = maybe.filter("not own").groupBy("k1", "k2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo <> hi").select("k1", "k2", "lo")
    first = scratch.cut(first)
    # no aggregate by key follows, so that a key with very many rows can be split over tasks
    later = maybe.join(first, ["k1", "k2"], "left").filter("own or doc_id > lo").select("doc_id", F.when(~F.col("own"), F.struct("k1", "k2")).alias("k"))
    later = scratch.cut(later)
    scratch.drop(maybe, first)
    scratch.release()
    bloom.unpersist()
    by_doc = later.groupBy(F.col("doc_id").alias("_s_doc")).agg(F.collect_list("k").alias("_s_keys"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    own = docs.withColumn("_s_doc", F.col(f"`{id_col}`").cast("long"))
    known = own.filter("_s_doc is not null")
    untouched, touched = split_by_keys(scratch, known, "_s_doc", later.select(F.col("doc_id").alias("_s_doc")))
    touched = touched.join(by_doc, "_s_doc", "left").select("_s_keys", *columns)
    out = T.StructType([*docs.schema.fields, T.StructField("_s_text", T.StringType()), T.StructField("_s_removed", T.IntegerType()), T.StructField("_s_spans", SPANS)])
    at = docs.columns.index(text_col)
    a = untouched.select(*columns, F.col(f"`{text_col}`").cast("string").alias("_s_text"), F.lit(0).alias("_s_removed"), F.array().cast(SPANS).alias("_s_spans"))
    b = touched.mapInArrow(_clean(out, at, True), out)
    c = own.filter("_s_doc is null").select(*columns).mapInArrow(_clean(out, at, False), out)
    return a.union(b).union(c)


def span_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_removed, kept_chars, kept_sha256, removed) of every document."""
    out = dedup_spans(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("_s_removed").cast("long").alias("n_removed"), F.coalesce(F.length("_s_text"), F.lit(0)).cast("long").alias("kept_chars"), F.sha2(F.coalesce("_s_text", F.lit("")), 256).alias("kept_sha256"), F.col("_s_spans").alias("removed"))


def without_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the cleaned text; documents of which nothing is left go. Lengths in n_chars follow.
    Nulls, repeated rows and ids: as in dedup_spans; a text that was blank before stays."""
    out = dedup_spans(docs, text_col=text_col).filter("_s_removed = 0 or trim(_s_text) <> ''")
    cols = [F.col("_s_text").alias(c) if c == text_col else F.length("_s_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*cols)
