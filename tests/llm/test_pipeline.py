"""The pipeline and the opN_ queries against brute-force versions over sf0.001."""

import sys

import pytest
from tokenizers import Tokenizer

sys.path.insert(0, "tests")
from compare import assert_same, connect  # noqa: E402
from test_partenum import brute  # noqa: E402
from test_text_ops import brute_spans  # noqa: E402

import corpus_pipeline  # noqa: E402
from imgspark.llm import mixing, quality, registry  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(name, spark):
    assert_same(registry.queries()[name], registry.oracle_sql()[name], spark, connect(SF), SF)


def test_pipeline_equals_brute_force(spark):
    """Each stage by its definition: rules of the SQL form, all pairs, all spans, the mix's plan, the library."""
    import public_tokenizers

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    good = {r[0] for r in connect(SF).sql(f"SELECT doc_id FROM ({quality.sql()}) WHERE kept").fetchall()}
    rows = [(r.doc_id, r.text) for r in docs if r.doc_id in good]
    first = {d for d, (_, c) in brute(rows, 5, 80).items() if d == c}
    kept = brute_spans([(d, t) for d, t in rows if d in first])
    source = {r.doc_id: (r.lang, r.source) for r in docs}
    mixed = spark.createDataFrame([(d, t, *source[d]) for d, t in kept.items() if t.strip()], "doc_id long, text string, lang string, source string")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    want = []
    for r in mixing.mix_plan(mixed).collect():
        ids = tokenizer.encode(r.text, add_special_tokens=False).ids
        want += [(r.doc_id, r.lang, r.source, len(ids), tuple(ids))] * r._mix_copies
    got = [(r.doc_id, r.lang, r.source, r.n_tokens, tuple(r.token_ids)) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_stage_contract():
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    assert {n.split("_")[0] for n in registry.queries()} == {"pipeline", *(f"op{i}" for i in range(1, 14))}


def test_empty_tables_pass_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []
