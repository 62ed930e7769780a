"""Words and word shingles of whole texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64


class WordHashes(dict):
    """Word -> hash, emptied when it holds `most` words so that memory stays bounded."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def in_slices(batches, rows: int = 256):
    """Arrow batches cut small, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(text: bytes | None, table: WordHashes) -> np.ndarray:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; null is empty."""
    if not text:
        return np.empty(0, U)
    words = text.lower().split()
    return np.fromiter(map(table.__getitem__, words), U, len(words))


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word windows; fewer words make one window, none make none."""
    n = len(words)
    if not n:
        return words
    w = min(n, k)
    acc = np.full(n - w + 1, U(w * 0x9E3779B97F4A7C15 % 2**64))
    for j in range(w):
        acc = mix(acc + words[j : n - w + 1 + j])
    return np.unique(acc)


def slice_words(texts) -> tuple[np.ndarray, np.ndarray]:
    """(word_hashes of a string column's texts one after another, how many words each has). Arrow cuts the
    texts, and a word is hashed once a slice, however often it is there."""
    import pyarrow as pa
    import pyarrow.compute as pc

    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    size = cut.value_lengths().to_numpy().astype(np.int64)
    coded = cut.flatten().dictionary_encode()
    found = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), U, len(found))
    # white space at an end leaves an empty word there
    word = np.array([len(w) > 0 for w in found], bool)[coded.indices.to_numpy()]
    own = np.repeat(np.arange(len(size)), size)[word]
    return hashes[coded.indices.to_numpy()[word]], np.bincount(own, minlength=len(size))


def slice_sets(texts, k: int) -> list[np.ndarray]:
    """shingle_set of each text of a string column, hashed together."""
    words, size = slice_words(texts)
    ends = np.cumsum(size)
    out = [shingle_set(words[e - n : e], k) if n < k else None for n, e in zip(size.tolist(), ends.tolist())]
    m = np.where(size >= k, size - k + 1, 0)
    if m.any():
        first = np.repeat(ends - size - (np.cumsum(m) - m), m) + np.arange(m.sum())
        acc = np.full(len(words) - k + 1, U(k * 0x9E3779B97F4A7C15 % 2**64))
        for j in range(k):
            acc = mix(acc + words[j : len(words) - k + 1 + j])
        acc, at = acc[first], np.cumsum(m)
        for n, e in zip(m.tolist(), at.tolist()):
            acc[e - n : e].sort()
        new = np.r_[True, acc[1:] != acc[:-1]]
        new[(at - m)[m > 0]] = True
        kept = np.r_[0, np.cumsum(new)]
        acc = acc[new]
        for i, (lo, hi) in enumerate(zip(kept[at - m].tolist(), kept[at].tolist())):
            if out[i] is None:
                out[i] = acc[lo:hi]
    return out
