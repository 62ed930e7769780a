import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from imgspark.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    rng = random.Random(0)
    marks = "aAbB'sStTİıΣσςßſK  \t\n\x0b\x1c\x1f\x85   　​123٣४½½é́é̀.,!?😀👍🏽한국가日本<|endoftext|>ÅåĀǅǆ're'VE'll﻿ͅ\x00"
    out = ["".join(rng.choices(marks, k=rng.randint(0, 40))) for _ in range(4000)]
    out += ["", " \n", "a", "aaaaaaaaa", "<|startoftext|>x<|endoftext|><|endoftext|>", "<|ENDOFTEXT|>", "it's IT'S don't", "ΑΣ ΣΑΣ", "x" * 3000, "ab" * 2000, "\x1c"]
    return out + ["".join(rng.choices("thandreoing ", k=rng.randint(5, 200))) for _ in range(300)]


def test_ids_and_names_equal_the_library(spark, library):
    rows = list(enumerate(texts())) + [(10**6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    digests = {r.doc_id: r for r in bpe.encoded_digests(df, PATH).collect()}
    plain = {r.doc_id: list(r.token_ids) for r in bpe.encode(df, PATH).collect()}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert plain[i] == ids, t
        back = library.decode(ids, skip_special_tokens=False)
        assert (digests[i].n_tokens, digests[i].ids_sha256, digests[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(back)), t


def test_decoding(spark, library):
    ids = library.encode("some text's end", add_special_tokens=False).ids
    df = spark.createDataFrame([(1, ids), (2, []), (3, None), (4, [49407, 10**6])], "doc_id long, token_ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(df, PATH).collect()}
    assert got == {1: library.decode(ids, skip_special_tokens=False), 2: "", 3: None, 4: "<|endoftext|>"}


def test_small_tables_and_clashes(spark):
    coder = bpe.Encoder(bpe.vocabulary(PATH), most=3)
    for group in coder.groups([f"w{i} v{i}" for i in range(50)], most_chars=20):
        assert group and all(c in coder.known for x in group for c in x)
    df = spark.createDataFrame([(1, "a b", 2)], "doc_id long, text string, ids int")
    assert bpe.encode(df, PATH).columns == ["doc_id", "ids", "token_ids"]
    with pytest.raises(ValueError):
        bpe.encode(df, PATH, out_col="ids")
    assert bpe.encode(df.limit(0), PATH).collect() == []


def test_queries_decode_the_ids(spark, library, monkeypatch):
    """The digests come from decode_ids, in op9's pass and in the pipeline's last stage."""
    import corpus_pipeline
    import pyarrow as pa

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = ["some text's end", "", None, "x <|endoftext|> y"]
    ids = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.token_ids, r.decoded_sha256) for r in corpus_pipeline.bpe_stage(spark, df, "", PATH).collect()}
    assert got == {i: (x, sha(library.decode(x, skip_special_tokens=False))) for i, x in enumerate(ids)}
    seen = []
    monkeypatch.setattr(bpe, "decode_ids", lambda vocab, x: seen.append(list(x)) or "decoded")
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(texts)], ["doc_id", "text"])
    out = pa.Table.from_batches(bpe._digest(PATH)([batch])).to_pydict()
    assert seen == ids and out["decoded_sha256"] == [sha("decoded")] * 4
