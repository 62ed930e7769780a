"""BPE encoding and decoding by batched numpy merge rounds.

The distinct pre-tokens of a batch lie in one flat symbol array. In each round every adjacent
pair is looked up by binary search over the sorted pair keys, every word merges its lowest-ranked
pair (left to right, without overlap), and words without a known pair are done. Encodings of
words are kept across batches in a table of bounded size.

The vocabulary is a tokenizers JSON file: NFC, white space, lower case; a split into contractions,
letters, single digits and other marks; byte-level symbols; a word-end suffix.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame

from imgspark.llm.scratch import lean
from imgspark.llm.shingles import in_slices

SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
#: str.split() also splits at these; the tokenizer does not.
NOT_SPACE = regex.compile("[\x1c-\x1f]")
#: The byte alphabet: printable bytes stand for themselves, others for code points from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_symbols() -> list[str]:
    held, n = {b: chr(b) for b in PRINTABLE}, 0
    for b in range(256):
        if b not in held:
            held[b], n = chr(256 + n), n + 1
    return [held[b] for b in range(256)]


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + self.suffix] for s in symbols], np.int64)
        rank, key, made = [], [], []
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            rank.append(r)
            key.append(vocab[a] << 32 | vocab[b])
            made.append(vocab[a + b])
        order = np.argsort(key, kind="stable")
        self.keys = np.array(key, np.int64)[order]
        self.ranks = np.array(rank, np.int64)[order]
        self.made = np.array(made, np.int64)[order]

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each non-empty pre-token."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.inner[data]
        ends = np.cumsum(size) - 1
        sym[ends] = self.final[data[ends]]
        word = np.repeat(np.arange(len(raw)), size)
        none = np.int64(1 << 40)
        done_sym, done_word = [], []
        while len(sym):
            key = np.full(len(sym), -1, np.int64)
            same = word[1:] == word[:-1]
            key[:-1][same] = sym[:-1][same] << 32 | sym[1:][same]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            rank = np.where(self.keys[at] == key, self.ranks[at], none)
            start = np.flatnonzero(np.r_[True, ~same])
            least = np.minimum.reduceat(rank, start)
            run = np.diff(np.r_[start, len(sym)])
            low = np.repeat(least, run)
            open_ = low < none
            if not open_.all():
                done_sym.append(sym[~open_])
                done_word.append(word[~open_])
            hit = (rank == low) & open_
            # a run of hits, as in aaa, takes every other one from the left
            n = np.arange(len(sym))
            begin = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], n, -1))
            hit &= (n - begin) % 2 == 0
            sym = np.where(hit, self.made[at], sym)
            keep = open_ & ~np.r_[False, hit[:-1]]
            sym, word = sym[keep], word[keep]
        sym, word = np.concatenate(done_sym or [sym]), np.concatenate(done_word or [word])
        order = np.argsort(word, kind="stable")
        return np.split(sym[order], np.searchsorted(word[order], np.arange(1, len(raw))))


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def normalise(text: str) -> str:
    """NFC, then lower case by code point, as a tokenizer file's normaliser does (no final sigma)."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return text.lower() if "Σ" not in text else "".join(map(str.lower, text))


def split_space(text: str) -> list[str]:
    if NOT_SPACE.search(text):
        return [x for x in regex.split(r"\p{White_Space}+", text) if x]
    return text.split()


class Encoder:
    """Encodes texts; `most` chunks between white space are remembered. digests: as strings, not arrays."""

    def __init__(self, vocab: Vocabulary, most: int = 250_000, digests: bool = False):
        self.vocab, self.most, self.digests = vocab, most, digests
        self.known: dict[str, tuple] = {}

    def chunks(self, text: str | None) -> list:
        """Strings between white space, and ids of special tokens, in order."""
        if not text:
            return []
        if self.vocab.splitter is None or not any(s in text for s in self.vocab.special):
            return split_space(normalise(text))
        out: list = []
        for part in self.vocab.splitter.split(text):
            if part in self.vocab.special:
                out.append(self.vocab.special[part])
            else:
                out += split_space(normalise(part))
        return out

    def learn(self, lists: list[list]) -> None:
        """Encodes the chunks not known yet, in one flat array."""
        if len(self.known) > self.most:
            self.known.clear()
        new = set().union(*lists).difference(self.known)
        marks = {c for c in new if isinstance(c, int)}
        new -= marks
        parts = {c: SPLIT.findall(c) for c in new}
        words = list({w for p in parts.values() for w in p})
        ids = dict(zip(words, self.vocab.encode_words(words))) if words else {}
        for c, p in parts.items():
            got = [i for w in p for i in ids[w].tolist()]
            self.known[c] = self.entry(got)
        for c in marks:
            self.known[c] = self.entry([c])

    def entry(self, ids: list[int]) -> tuple:
        if self.digests:
            return (len(ids), " ".join(map(str, ids)), ids)
        return (np.array(ids, np.int32), len(ids))

    def groups(self, texts: list, most_chars: int = 2_000_000):
        """Texts in groups of bounded size, each with its chunks learnt."""
        held, n = [], 0
        for t in texts:
            held.append(self.chunks(t))
            n += len(t or "")
            if n > most_chars:
                self.learn(held)
                yield held
                held, n = [], 0
        if held:
            self.learn(held)
            yield held


def _encode(path: str, digest: bool):
    def run(batches):
        import pyarrow as pa

        coder = Encoder(vocabulary(path))
        for batch in in_slices(batches, 1024):
            at = 0
            for group in coder.groups(batch.column(0).to_pylist()):
                known = coder.known
                ids = [np.concatenate([known[c][0] for c in x]) if x else np.empty(0, np.int32) for x in group]
                offsets = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                rest = batch.slice(at, len(group))
                at += len(group)
                new = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids)))]
                if digest:
                    new.append(pa.array([hashlib.sha256(decode_ids(coder.vocab, x.tolist()).encode()).hexdigest() for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([*rest.columns[1:], *new], [*rest.schema.names[1:], "ids", "digest"][: len(rest.columns) - 1 + len(new)])

    return lean(run)


def encode(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "token_ids", digest_col: str | None = None) -> DataFrame:
    """docs without its text column, plus out_col array<int>: the ids of the whole text; with digest_col
    also the SHA-256 of what decode_ids makes of them.

    Null, empty and blank texts have no ids; equal texts have equal ids. Text that reads like a
    special token becomes that token's id, as in the tokenizers library. Other columns stay as
    they are, whatever their names; out_col and digest_col must be new. An empty table gives an empty table.
    """
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    for c in (out_col, digest_col):
        if c in docs.columns:
            raise ValueError(f"column {c} exists")
    rest = [f for f in docs.schema.fields if f.name != text_col]
    tmp = docs.select(F.col(f"`{text_col}`").cast("string"), *[F.col(f"`{f.name}`") for f in rest])
    new = [T.StructField(out_col, T.ArrayType(T.IntegerType()))] + ([T.StructField(digest_col, T.StringType())] if digest_col else [])
    return tmp.mapInArrow(_encode(path, bool(digest_col)), T.StructType([*rest, *new]))


def decode_ids(vocab: Vocabulary, ids: list[int]) -> str:
    """The names of the tokens with one space between, which is what a file without a decoder gives."""
    names = vocab.names
    return " ".join([names[i] for i in ids if i in names])


def decode(df: DataFrame, path: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """df plus out_col: the decoded string of ids_col; null ids give null, unknown ids are left out."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def run(col):
        vocab = vocabulary(path)
        return col.map(lambda x: None if x is None else decode_ids(vocab, list(x)))

    return df.withColumn(out_col, run(F.col(f"`{ids_col}`")))


def _digest(path: str):
    def run(batches):
        import pyarrow as pa

        coder, sha = Encoder(vocabulary(path), 400_000, digests=True), lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in in_slices(batches, 1024):
            docs, at = batch.column(0), 0
            for group in coder.groups(batch.column(1).to_pylist()):
                n, ids, back = [], [], []
                for x in group:
                    size, text, parts = zip(*map(coder.known.__getitem__, x)) if x else ((), (), ())
                    if 0 in size:  # a chunk of marks that the split leaves out
                        text = filter(None, text)
                    n.append(sum(size))
                    ids.append(sha(" ".join(text)))
                    back.append(sha(decode_ids(coder.vocab, list(chain.from_iterable(parts)))))
                yield pa.RecordBatch.from_arrays([docs.slice(at, len(group)), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                at += len(group)

    return lean(run)


def encoded_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes, decodes and hashes in one pass, so
    that ids of long texts need not leave the worker. Nulls and ties as in encode()."""
    from pyspark.sql import functions as F

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_digest(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
