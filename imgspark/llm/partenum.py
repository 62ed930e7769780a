"""N-gram Jaccard join by PartEnum signatures.

Two sets of similarity >= g differ in few elements: their symmetric difference is at most
k = floor((|A| + |B|)(1 - g) / (1 + g)). Sets are put into size bands whose upper end is the
lower end over g, so partners lie in one band or in neighbouring ones; each set signs for its
own band and the next. Within a band the hash domain is cut into n1 * n2 partitions, n1 groups
of n2; with n1 * (k2 + 1) > k some group has at most k2 partitions that differ, so one of the
subsets of n2 - k2 partitions of that group agrees, and its hash is a shared signature.

Partners share several signatures, not one: of the f partitions of a band's pairs at least f - k
agree. Signatures of few sets (SMALL) give their pairs with counts, and a pair is a candidate if
what it shares there, with all larger buckets that both are in, reaches that number. If it can only
be reached in larger buckets, a set needs that many of them, and may leave the clusters where it has
least of them, fewer than half of that number together: a partner remains in one of the others.

Candidates are verified exactly. A larger bucket never emits all its pairs: its members are compared
with one pivot. Partners of a pivot's cluster that are not both linked to the pivot must share
an element of their difference from the pivot, so what stays unlinked is grouped by the rarest
elements of that difference (an overlap prefix filter) and the same step is applied again, to
the end. Components then come from the links alone. Every link lies inside a component, so the
number of links of each document is counted exactly over all pairs of its component, block by block.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from imgspark.llm.components import connected_components
from imgspark.llm.scratch import Scratch, broadcast_bloom, in_bloom, lean, split_by_keys
from imgspark.llm.shingles import U, in_slices, mix, slice_sets


#: Members outside a group's largest component up to which they are compared with all of the group,
#: by parities, and verified if these allow a link; with more, the group gets a pivot instead. Either
#: way every possible link is looked at.
LARGE = 200
#: Members of a bucket up to which all its pairs are counted.
SMALL = 6
#: log2 of the buckets that short names of signatures are counted in, least and most, and signatures that a
#: task packs at a time.
BUCKETS, PACKED = (4, 13), 1 << 21
#: 64-bit words of the parities that sets are compared by before they are verified.
WORDS = 16
BITS = [f"w{i}_" for i in range(WORDS)]
#: Elements of the sets in one block of a component when links are counted; a set counts as LEAST at least.
BLOCK, LEAST = 300_000, 300
#: Elements whose columns are multiplied at once there.
COLUMNS = 2048


class Scheme:
    """Bands and signatures for a similarity of percent / 100."""

    def __init__(self, percent: int):
        self.percent = percent
        self.low, self.high = [1], [max(1, 100 // percent)]

    def band(self, size: int) -> int:
        while self.high[-1] < size:
            low = self.high[-1] + 1
            self.low.append(low)
            self.high.append(max(low, low * 100 // self.percent))
        return bisect_right(self.low, size) - 1

    def shape(self, band: int) -> tuple[int, int, int]:
        """(n1, n2, k2) of a band, or zeros if only equal sets can link there."""
        self.band(self.high[-1] + 1) if band >= len(self.high) else None
        k = 2 * self.high[band] * (100 - self.percent) // (100 + self.percent)
        if k == 0:
            return 0, 0, 0
        n1 = -(-(k + 1) // 2)
        if n1 <= 4:
            return n1, 3, 1
        # spare partitions, so that light ones need not sign (see signatures)
        spare = -(-(k + 1) * (20 if self.percent < 85 else 6) // 100)
        return -(-(k + 1 + spare) // 2), 2, 1

    def most_differing(self, band: int) -> int:
        return 2 * self.high[band] * (100 - self.percent) // (100 + self.percent)

    def signatures(self, s: np.ndarray) -> list[tuple[np.ndarray, int, int]]:
        """(signatures, how many of them a partner shares at least, band) of a sorted set of hashes, for
        its band and the next.

        With pairs of partitions a signature is one partition, and of f = 2 * n1 at least f - k agree
        with a partner's. Empty ones tell nothing: a set with fewer than f - k of them does not sign
        them, as one that agrees is then filled, in both sets; its partners share f - k less those.
        """
        if not len(s):
            return []
        band = self.band(len(s))
        sums = np.zeros(len(s) + 1, U)
        np.cumsum(mix(s ^ U(0xA0761D6478BD642F)), out=sums[1:])
        out = []
        for b in (band, band + 1):
            n1, n2, k2 = self.shape(b)
            if n1:
                ends = np.searchsorted(s, bounds(n1 * n2))
                parts = np.diff(sums[ends]).reshape(n1, n2)
                # subsets of n2 - 1 partitions: the group's sum without one of them
                subset = parts.sum(1, keepdims=True) - parts
                sig, shared = mix(subset + names(b, n1, n2)), 1
                if n2 == 2:
                    empty = (np.diff(ends) == 0).reshape(n1, n2)[:, ::-1]  # of the partition that signs
                    least = n1 * n2 - self.most_differing(b)
                    if empty.sum() < least:
                        sig, shared = sig[~empty], least - int(empty.sum())
                out.append((sig.ravel(), shared, b))
        return out


@lru_cache(4096)
def bounds(parts: int) -> np.ndarray:
    """The ends of equal parts of the 64-bit domain; the last lies past every hash but the largest."""
    return np.array([min((i << 64) // parts, 2**64 - 1) for i in range(parts + 1)], U)


@lru_cache(4096)
def names(band: int, n1: int, n2: int) -> np.ndarray:
    i = np.arange(n1 * n2, dtype=U).reshape(n1, n2)
    return mix(i + (U(band + 1) << U(40)))


def _shingled(batch, k: int):
    """(doc_id, set) of a batch."""
    return zip(batch.column(0).to_pylist(), slice_sets(batch.column(1), k))


def _classes(k: int):
    def run(batches):
        import pyarrow as pa

        for batch in in_slices(batches):
            ids, sizes, h1, h2 = [], [], [], []
            for doc, s in _shingled(batch, k):
                ids.append(doc)
                sizes.append(len(s))
                h1.append(int(mix(s + U(1)).sum()) if len(s) else 0)
                h2.append(int(mix(s ^ U(0xE7037ED1A0B428DB)).sum()) if len(s) else 0)
            col = lambda x: pa.array(np.array(x, U).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), col(h1), col(h2)], ["doc_id", "n_shingles", "h1", "h2"])

    return lean(run)


def bucket_log2(shingles: int) -> int:
    """log2 of the buckets for sets of so many shingles: some 2^16 in a bucket, up to the most."""
    return min(max((shingles >> 16).bit_length(), BUCKETS[0]), BUCKETS[1])


def short_names(sig: np.ndarray, log2: int) -> np.ndarray:
    """32 + log2 bits of signatures, by which repeated ones are found; those of equal signatures are equal, and
    what others share is told apart when pairs are counted."""
    return sig >> U(32 - log2)


def packed_names(held: list, log2: int):
    """(bucket, part) of many signatures."""
    import pyarrow as pa

    s = np.sort(short_names(np.concatenate(held), log2))
    s = s[np.concatenate([np.ones(min(2, len(s)), bool), s[2:] != s[:-2]])]  # two of a name tell as much as more
    ends = np.searchsorted(s, np.arange(1 << log2, dtype=U) << U(32))
    full = np.diff(ends, append=len(s)).nonzero()[0]
    parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(full), [None, pa.py_buffer(4 * np.append(ends[full], len(s)).astype(np.int64)), pa.py_buffer(s.astype(np.uint32))])
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), parts.cast(pa.binary())], ["bucket", "part"])


def _packed(k: int, percent: int, log2: int, skip=None):
    """(bucket, part): the short names of all signatures; log2 bits name a bucket, the other 32 lie packed in
    its parts, so that four bytes for each signature are shuffled. skip: a Bloom filter of ids to leave out."""

    def run(batches):
        import pyarrow as pa

        scheme, held, n = Scheme(percent), [], 0
        for batch in in_slices(batches):
            if skip:
                batch = batch.filter(pa.array(~in_bloom(skip.value, batch.column(0).to_numpy())))
            for _, s in _shingled(batch, k):
                for sig, shared, _ in scheme.signatures(s):
                    if len(sig) >= shared:
                        held.append(sig)
                        n += len(sig)
                if n >= PACKED:
                    yield packed_names(held, log2)
                    held, n = [], 0
        if held:
            yield packed_names(held, log2)

    return lean(run)


def _repeated(batches):
    """The short names that two parts of a bucket hold, or one part twice; buckets lie together in sorted rows."""
    import pyarrow as pa

    key, held = None, []

    def flush():
        s = np.sort(np.frombuffer(b"".join(held), np.uint32))
        s = s[1:][s[1:] == s[:-1]]
        s = s[np.concatenate([np.ones(min(1, len(s)), bool), s[1:] != s[:-1]])]
        return pa.RecordBatch.from_arrays([pa.array(s.astype(np.int64) | np.int64(key) << 32)], ["sig"])

    for batch in batches:
        for bucket, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if held and bucket != key:
                yield flush()
                held = []
            key = bucket
            held.append(part)
    if held:
        yield flush()


def _signed(k: int, percent: int, log2: int, bloom, skip=None):
    """The signatures that a Bloom filter of repeated short names holds, with the set's key, how many a partner
    shares at least and the band. skip: a Bloom filter of ids to leave out."""

    def run(batches):
        import pyarrow as pa

        scheme = Scheme(percent)
        for batch in in_slices(batches):
            if skip:
                batch = batch.filter(pa.array(~in_bloom(skip.value, batch.column(0).to_numpy())))
            held, sigs = [], [np.empty(0, U)]
            for _, s in _shingled(batch, k):
                key = int(mix(s + U(1)).sum().view(np.int64))
                for sig, shared, band in scheme.signatures(s):
                    if len(sig) >= shared:
                        sigs.append(sig)
                        held.append((len(sig), key, shared, band))
            if not held:
                continue
            sig = np.concatenate(sigs)
            size, key, shared, band = np.array(held, np.int64).T
            # with too few repeated ones there is no partner in that band
            hit = in_bloom(bloom.value, short_names(sig, log2).view(np.int64))
            own = np.repeat(np.arange(len(size)), size)
            n = np.bincount(own[hit], minlength=len(size))
            hit &= (n >= shared)[own]
            own = own[hit]
            cols = [pa.array(sig[hit].view(np.int64)), pa.array(key[own]), pa.array(n[own].astype(np.int32)), pa.array(shared[own].astype(np.int32)), pa.array(band[own].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, ["sig", "x", "hits", "least", "band"])

    return lean(run)


def parities(s: np.ndarray) -> np.ndarray:
    """WORDS 64-bit words, each element flipping one bit. Where the words of two sets differ, an element is
    in one of them only, so the differing bits are at most their symmetric difference."""
    place = (mix(s + U(0x8CB92BA72F3D8DD7)) % U(64 * WORDS)).astype(np.int64)
    odd = (np.bincount(place, minlength=64 * WORDS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def _sets(k: int, shared):
    """(doc_id, set, parities) of the documents that the filter holds."""

    def run(batches):
        import pyarrow as pa

        for batch in in_slices(batches):
            batch = batch.filter(pa.array(in_bloom(shared.value, batch.column(0).to_numpy())))
            if batch.num_rows:
                out = list(_shingled(batch, k))
                offsets = np.cumsum([0, *(len(s) for _, s in out)])
                sets = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([s.view(np.int64) for _, s in out])))
                bits = np.array([parities(s) for _, s in out])
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.int64()), sets, *[pa.array(np.ascontiguousarray(w)) for w in bits.T]], ["node", "s", *BITS])

    return lean(run)


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", degrees: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links_found) of every document; without the last if not degrees.

    Links: 100 * |A n B| >= percent * |A u B| over distinct k-word shingles; component_id is the
    smallest id reachable through links. Null, empty and blank texts have no shingles and link
    with nothing, not even each other; fewer than k words make one shingle; equal sets always
    link. Rows with a null id stay as they are with a null component_id. Rows with an equal id are one
    document: if their texts differ, the least of those with words stands for it, and each row has
    its own n_shingles. Other columns are ignored; an empty table gives an empty table. n_links_found is the number of other documents (distinct ids) that link with the
    document, equal copies among them.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "partenum")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    classes = scratch.cut(base.mapInArrow(_classes(k), "doc_id long, n_shingles long, h1 long, h2 long"))

    whole = classes.filter("n_shingles > 0 and doc_id is not null")
    # rows without an id are not counted in reps: as pivots they would take their bucket's links along
    base = base.filter("doc_id is not null")
    base, whole = _one_text(scratch, base, whole, k)
    reps = whole.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.countDistinct("doc_id").alias("copies"))
    reps = scratch.cut(reps)
    by_key = reps.select(F.col("h1").alias("x"), "rep")

    # one document of each class signs; the others are few, and only their texts are shuffled
    copies = scratch.cut(whole.join(reps, ["h1", "h2"]).filter("doc_id <> rep").select("doc_id").distinct())
    _, maybe = split_by_keys(scratch, base, "doc_id", copies)
    rest = scratch.cut(maybe.join(copies, "doc_id", "left_anti"))
    skip = broadcast_bloom(scratch, copies, "doc_id")

    log2 = bucket_log2(classes.agg(F.sum("n_shingles")).first()[0] or 0)

    def signing(schema, how, *filters):
        # one Python worker a task: the documents that may be copies are left out in the same pass
        sure = base.mapInArrow(how(k, percent, log2, *filters, skip), schema)
        return sure.unionByName(rest.mapInArrow(how(k, percent, log2, *filters), schema))

    # the short names of signatures that occur twice at least
    packed = signing("bucket int, part binary", _packed).repartition("bucket").sortWithinPartitions("bucket")
    twice = scratch.cut(packed.mapInArrow(lean(_repeated), "sig long"))
    del packed
    scratch.release()
    bloom = broadcast_bloom(scratch, twice, "sig")
    scratch.drop(twice)
    signed = scratch.cut(signing("sig long, x long, hits int, least int, band int", _signed, bloom))
    pairs = scratch.cut(_candidates(scratch, signed))
    scratch.drop(signed, rest, copies)
    scratch.release()
    by_x, by_y = by_key.withColumnRenamed("rep", "a"), by_key.select(F.col("x").alias("y"), F.col("rep").alias("b"))
    named = scratch.cut(pairs.join(by_x, "x").join(by_y, "y").select("a", "b", "again").filter("a <> b"))
    scratch.drop(pairs)
    pairs = named
    bloom.unpersist()
    skip.unpersist()

    wanted = scratch.cut(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    bloom = broadcast_bloom(scratch, wanted, "node")
    sets = base.mapInArrow(_sets(k, bloom), f"node long, s array<long>, {', '.join(f'{w} long' for w in BITS)}").join(wanted, "node", "left_semi").dropDuplicates(["node"])
    sets = scratch.cut(sets.select("node", "s", F.size("s").alias("n"), *BITS))
    scratch.release()

    labels = scratch.cut(wanted.select("node", F.col("node").alias("comp")))
    while True:
        links = scratch.cut(_verified(pairs, sets, percent))
        labels = _merged(scratch, labels, links)
        rest = _residual(scratch, pairs.filter("again").select("a", "b"), labels, sets, percent)
        scratch.drop(links, pairs)
        scratch.release()
        pairs = rest
        if not pairs.limit(1).count():
            break
    members = whole.select("doc_id", "h1", "h2").join(reps, ["h1", "h2"]).select("doc_id", "rep", "copies").distinct()
    comp = labels.select(F.col("node").alias("rep"), "comp")
    members = members.join(comp, "rep", "left")
    found = [F.coalesce("comp", "rep").alias("component_id")]
    if degrees:
        members = members.join(_degrees(scratch, labels, reps, sets, percent), "rep", "left")
        found.append((F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links_found"))
    out = classes.select("doc_id", "n_shingles").join(members.select("doc_id", *found), "doc_id", "left")
    last = [F.coalesce("n_links_found", F.lit(0)).cast("long").alias("n_links_found")] if degrees else []
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *last)
    done = scratch.cut(out)
    scratch.drop(sets, classes, reps, labels)
    scratch.release()
    return done


def _one_text(scratch: Scratch, base: DataFrame, whole: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """base and whole with the least text only, of those with words, for ids that have several."""
    several = whole.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("a"), F.max(F.struct("h1", "h2")).alias("b")).filter("a <> b").select("doc_id")
    several = scratch.cut(several)
    if not several.limit(1).count():
        return base, whole
    sure, maybe = split_by_keys(scratch, base, "doc_id", several)
    maybe = scratch.cut(maybe)
    least = maybe.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    least = scratch.cut(least)
    base = sure.unionByName(maybe.join(several, "doc_id", "left_anti")).unionByName(least)
    made = least.mapInArrow(_classes(k), "doc_id long, n_shingles long, h1 long, h2 long")
    return base, whole.join(several, "doc_id", "left_anti").unionByName(made)


def _candidates(scratch: Scratch, signed: DataFrame) -> DataFrame:
    """(x, y, again): pairs of sets to verify; again marks y as a member of the cluster of the pivot x."""
    size = signed.groupBy("sig").agg(F.count("*").alias("m"), F.max_by("x", F.struct("hits", "x")).alias("p")).filter("m > 1")
    rows = scratch.cut(signed.join(size, "sig").select("sig", "x", "least", "band", "m", "p"))
    few = rows.filter(F.col("m") <= SMALL).groupBy("sig", "band").agg(F.array_sort(F.collect_set(F.struct("x", "least"))).alias("e"))
    two = F.flatten(F.transform("e", lambda u, i: F.transform(F.slice("e", i + 2, F.size("e")), lambda v: F.struct(u.alias("u"), v.alias("v")))))
    few = few.select("band", F.explode(two).alias("t")).groupBy("band", F.col("t.u.x").alias("x"), F.col("t.v.x").alias("y")).agg(F.count("*").alias("c"), F.max(F.greatest("t.u.least", "t.v.least")).alias("least"))
    many = rows.filter(F.col("m") > SMALL).groupBy("x", "band", "p").agg(F.count("*").alias("c"), F.max("least").alias("least"))
    many = scratch.cut(many)
    total = many.groupBy("x", "band").agg(F.sum("c").alias("tx"))
    few = few.join(total, ["x", "band"], "left").join(total.select(F.col("x").alias("y"), "band", F.col("tx").alias("ty")), ["y", "band"], "left")
    few = few.filter(F.col("c") + F.least(F.coalesce("tx", F.lit(0)), F.coalesce("ty", F.lit(0))) >= F.col("least")).filter("x <> y")
    # the clusters of a set, those it shares least of first, itself as a pivot last
    of = Window.partitionBy("x", "band")
    upto = F.sum("c").over(of.orderBy(F.col("p") == F.col("x"), "c", "p").rowsBetween(Window.unboundedPreceding, 0))
    many = many.withColumn("t", F.sum("c").over(of)).withColumn("upto", upto)
    many = many.filter("t >= least and upto > floor((least - 1) / 2) and x <> p")
    pairs = few.select("x", "y", F.lit(False).alias("again")).union(many.select(F.col("p").alias("x"), F.col("x").alias("y"), F.lit(True)))
    return pairs.groupBy("x", "y").agg(F.max("again").alias("again"))


def _degrees(scratch: Scratch, labels: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(rep, links): the documents of other classes that link with the class.

    The two classes of a component of two are linked. Larger components are cut into blocks by hash,
    and each pair of blocks is one group: it yields a row for each member, never one for each pair.
    """
    copies = reps.groupBy(F.col("rep").alias("node")).agg(F.max("copies").alias("copies"))
    member = scratch.cut(labels.join(copies, "node").join(sets.select("node", "n"), "node"))
    comps = member.groupBy("comp").agg(F.count("*").alias("m"), F.sum("copies").alias("all"), F.ceil(F.sum(F.greatest("n", F.lit(LEAST))) / BLOCK).cast("long").alias("blocks")).filter("m > 1")
    member = scratch.cut(member.join(comps, "comp"))
    two = member.filter("m = 2").select(F.col("node").alias("rep"), (F.col("all") - F.col("copies")).alias("links"))
    more = member.filter("m > 2").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    more = more.join(sets.select("node", "s"), "node").withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    more = more.select("comp", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "node", "copies", "s")
    more = more.repartition("comp", "lo", "hi").sortWithinPartitions("comp", "lo", "hi")
    counted = more.mapInArrow(_counted(percent), "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))
    return scratch.cut(two.unionByName(counted))


def _counted(percent: int):
    """(rep, links) of each member in each group (comp, lo, hi); groups lie together in sorted rows."""

    def run(batches):
        import pyarrow as pa

        key, held = None, []

        def flush():
            rep, links = link_counts(key[1], key[2], *map(np.concatenate, zip(*held)), percent)
            return pa.RecordBatch.from_arrays([pa.array(rep), pa.array(links)], ["rep", "links"])

        for batch in batches:
            if not batch.num_rows:
                continue
            comp, lo, hi, block, node, copies = (batch.column(i).to_numpy() for i in range(6))
            cut = np.flatnonzero((np.diff(comp) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)) + 1
            size = batch.column(6).value_lengths().to_numpy().astype(np.int64)
            values, at = batch.column(6).flatten().to_numpy(), np.cumsum([0, *size])
            for i, j in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
                now = (comp[i], lo[i], hi[i])
                if held and now != key:
                    yield flush()
                    held = []
                key = now
                held.append((block[i:j].copy(), node[i:j].copy(), copies[i:j].copy(), size[i:j], values[at[i] : at[j]].copy()))
        if held:
            yield flush()

    return lean(run)


def link_counts(lo: int, hi: int, block, node, copies, size, values, percent: int):
    """(node, copies of what it links with) for members of the blocks lo and hi, over pairs across the two,
    or over all pairs of one block. size: of each member's set; values: the sets one after another."""
    a, b = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    row = np.repeat(np.arange(len(node)), size)
    _, col = np.unique(values, return_inverse=True)
    n = col.max() + 1
    # only elements that can be shared count
    if lo == hi:
        may = np.bincount(col, minlength=n) > 1
    else:
        left = (block == lo)[row]
        may = (np.bincount(col[left], minlength=n) > 0) & (np.bincount(col[~left], minlength=n) > 0)
    keep = may[col]
    row, col = row[keep], (np.cumsum(may) - 1)[col[keep]]
    order = np.argsort(col, kind="stable")
    row, col, n = row[order], col[order], int(may.sum())
    both = np.zeros((len(a), len(b)), np.int64)
    for c in range(0, n, COLUMNS):
        i, j = np.searchsorted(col, (c, c + COLUMNS))
        has = np.zeros((len(node), min(COLUMNS, n - c)), np.float32)
        has[row[i:j], col[i:j] - c] = 1
        both += (has[a] @ has[b].T).astype(np.int64)
    linked = (both > 0) & (100 * both >= percent * (size[a][:, None] + size[b][None] - both))
    if lo == hi:
        np.fill_diagonal(linked, False)
        return node[a], linked @ copies[a]
    return np.concatenate([node[a], node[b]]), np.concatenate([linked @ copies[b], copies[a] @ linked])


def _merged(scratch: Scratch, labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels with the components that links join as one: only components are joined, not nodes again."""
    la = labels.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
    lb = labels.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    edges = scratch.cut(links.join(la, "a").join(lb, "b").filter("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct())
    if not edges.limit(1).count():
        scratch.drop(edges)
        return labels
    found = connected_components(scratch, edges).withColumnRenamed("comp", "to").withColumnRenamed("node", "comp")
    new = scratch.cut(labels.join(found, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")))
    scratch.drop(edges, labels)
    return new


def _apart(percent: int, other: str = "2"):
    """Whether the parities of two sets allow a link; columns n and BITS, and the same with a suffix."""
    apart = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"{w}{other}"))) for w in BITS), F.lit(0))
    return apart * (100 + percent) <= (F.col("n") + F.col(f"n{other}")) * (100 - percent)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs that are links by their exact sets; parities rule most others out before."""
    light = sets.select("node", "n", *BITS)
    a = light.withColumnRenamed("node", "a")
    b = light.select(F.col("node").alias("b"), *[F.col(c).alias(f"{c}2") for c in ("n", *BITS)])
    near = pairs.join(b, "b").join(a, "a").filter(_apart(percent)).select("a", "b").distinct()
    sa = sets.select(F.col("node").alias("a"), F.col("s").alias("sa"), F.col("n").alias("na"))
    sb = sets.select(F.col("node").alias("b"), F.col("s").alias("sb"), F.col("n").alias("nb"))
    both = near.join(sb, "b").join(sa, "a").withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return both.filter(F.lit(100) * F.col("i") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("i"))).select("a", "b")


def _across(rows: DataFrame, groups: DataFrame, key: list[str], percent: int) -> DataFrame:
    """(a, b): pairs of members of a group in different components that parities allow to be links. groups:
    (key, mode), mode the largest component of the group; what is outside of it, LARGE members at most,
    is compared with all of the group."""
    all_ = rows.join(groups, key)
    other = all_.select(*key, *[F.col(c).alias(f"{c}2") for c in ("b", "cb", "n", *BITS)])
    pairs = all_.filter("cb <> mode").join(other, key).filter((F.col("cb") != F.col("cb2")) & ((F.col("b") < F.col("b2")) | (F.col("cb2") == F.col("mode"))) & _apart(percent))
    return pairs.select(F.least("b", "b2").alias("a"), F.greatest("b", "b2").alias("b")).distinct()


def _modes(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, mode, outside) of groups with members of several components."""
    per = rows.groupBy(*key, "cb").agg(F.count("*").alias("k"))
    per = per.groupBy(*key).agg(F.max_by("cb", F.struct("k", "cb")).alias("mode"), (F.sum("k") - F.max("k")).alias("outside"))
    return per.filter("outside > 0")


def _residual(scratch: Scratch, star: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The next pairs to verify, (a, b, again); again marks those of a new pivot.

    star: pairs (a, b) of a pivot a with the members b of its cluster. Only pairs of members from different
    components can add anything. Where few members are outside the largest component, they are
    compared with all; else members are grouped by the rare elements of their difference from the pivot.
    """
    light = sets.select(F.col("node").alias("b"), "n", *BITS)
    seen = scratch.cut(star.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b").distinct())
    modes = scratch.cut(_modes(seen, ["a"]))
    few = modes.filter(F.col("outside") <= LARGE).select("a", "mode")
    pairs = _across(seen.join(few.select("a"), "a", "left_semi").join(light, "b"), few, ["a"], percent).withColumn("again", F.lit(False))
    many = modes.filter(F.col("outside") > LARGE).select("a")
    if many.limit(1).count():
        pairs = pairs.unionByName(_by_elements(scratch, seen.join(many, "a", "left_semi"), sets, percent))
    pairs = scratch.cut(pairs)
    scratch.drop(seen, modes)
    return pairs


def _by_elements(scratch: Scratch, member: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The same for the members (a, b, cb) of large clusters."""
    sa = sets.select(F.col("node").alias("a"), F.col("s").alias("sa"))
    sb = sets.select(F.col("node").alias("b"), F.col("s").alias("sb"), "n", *BITS)
    d = F.concat(F.array_except("sb", "sa"), F.array_except("sa", "sb"))
    kx = F.floor(F.col("n") * (100 - percent) / percent)
    tok = member.join(sb, "b").join(sa, "a").select("a", "b", "cb", "n", kx.alias("kx"), d.alias("d"), *BITS)
    tok = tok.select("a", "b", "cb", "n", "kx", F.size("d").alias("nd"), *BITS, F.explode("d").alias("e"))
    # only pairs across components are wanted: elements that no member of another component has are
    # missing from any such partner; more than kx of them rule a member out, fewer come first in its
    # order by rarity
    shared = tok.groupBy("a", "e").agg(F.count("*").alias("f"), F.min("cb").alias("lo"), F.max("cb").alias("hi")).filter("lo <> hi").select("a", "e", "f")
    tok = tok.join(shared, ["a", "e"])
    own = Window.partitionBy("a", "b")
    tok = tok.withColumn("u", F.col("nd") - F.count("*").over(own)).withColumn("r", F.col("u") + F.row_number().over(own.orderBy("f", "e")))
    tok = scratch.cut(tok.filter("r <= kx + 1 and u <= kx").select("a", "e", "b", "cb", "n", "nd", *BITS))
    groups = scratch.cut(_modes(tok, ["a", "e"]))
    direct = _across(tok, groups.filter(F.col("outside") <= LARGE).select("a", "e", "mode"), ["a", "e"], percent)
    # a group with many outside gets a pivot of its own, and the step is applied again
    large = tok.join(groups.filter(F.col("outside") > LARGE).select("a", "e"), ["a", "e"], "left_semi")
    pivot = large.groupBy("a", "e").agg(F.min_by("b", F.struct("nd", "b")).alias("p"))
    star = large.join(pivot, ["a", "e"]).filter("b <> p").select(F.col("p").alias("a"), "b").distinct()
    return direct.withColumn("again", F.lit(False)).unionByName(star.withColumn("again", F.lit(True)))
