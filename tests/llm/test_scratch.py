import numpy as np
from pyspark.sql import functions as F

from imgspark.llm.components import connected_components
from imgspark.llm import scratch as S
from imgspark.llm.scratch import Scratch, build_bloom, in_bloom, shared_dir, split_by_keys


def test_bloom_holds_its_keys_and_little_else(spark):
    keys = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 5000)
    bits = build_bloom(spark.createDataFrame([(int(k),) for k in keys], "k long"), "k")
    assert len(bits) == 2**14
    assert in_bloom(bits, keys).all()
    assert in_bloom(bits, np.arange(200_000)).mean() < 0.001
    assert not in_bloom(build_bloom(spark.createDataFrame([], "k long"), "k"), keys).any()


def test_bloom_grows_with_its_keys_and_gives_up_beyond(spark, monkeypatch):
    assert [S.bloom_log2(n) for n in (0, 1, 6553, 6554, 10**6, 10**12)] == [17, 17, 17, 18, 25, 29]
    monkeypatch.setattr(S, "BLOOM_LOG2", (17, 17))
    df = spark.range(40_000).withColumnRenamed("id", "k")
    assert build_bloom(df, "k") is None and in_bloom(None, np.arange(5)).all()
    a, b = split_by_keys(Scratch(spark, "t"), df, "k", df.limit(33_000))
    assert a.count() == 0 and b.count() == 40_000


def test_split_keeps_every_row(spark):
    df = spark.createDataFrame([(2**60 + i if i % 7 else None, i) for i in range(500)], "id long, n int")
    keys = spark.createDataFrame([(2**60 + i,) for i in range(0, 500, 5)], "id long")
    a, b = split_by_keys(Scratch(spark, "t"), df, "id", keys)
    assert sorted(r.n for r in a.collect() + b.collect()) == list(range(500))
    assert {r.n for r in b.collect()} >= {i for i in range(0, 500, 5) if i % 7}
    assert all(i % 7 or True for i in [r.n for r in a.collect()]) and {r.n for r in a.collect()} >= {i for i in range(0, 500, 7)}


def test_scratch_is_in_the_shared_folder(spark):
    s = Scratch(spark, "t")
    t = s.cut(spark.range(5))
    assert t._scratch_path.startswith(shared_dir(spark)) and t.count() == 5
    s.drop(t)


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 201), (201, 202), (202, 200), (202, 200), (5, 5)]
    got = {r.node: r.comp for r in connected_components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long").select(F.col("b").alias("a"), F.col("a").alias("b"))).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(40)} | {i: 200 for i in (200, 201, 202)}
    assert connected_components(Scratch(spark, "t"), spark.createDataFrame([], "a long, b long")).collect() == []


def test_spans_shuffle_names_of_runs_and_leave_no_tables(spark, tmp_path):
    """What is shuffled of all runs is four bytes each, and tables of runs are gone when the result is read."""
    import os

    import numpy as np

    from imgspark.llm import spans
    from imgspark.llm.scratch import shared_dir

    passage = " ".join(f"Shared w{i} of a passage that many have, number {i}." for i in range(12))
    rows = [(i, f"Own{i} start of text {i * 7} here. {passage if i % 2 else ''} End {i} of it all, {i * 3}.") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    top = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(top)) if os.path.isdir(top) else set()
    got = {r["doc_id"]: r["_s_removed"] for r in spans.dedup_spans(docs).collect()}
    assert all((got[i] > 0) == (i % 2 == 1 and i > 1) for i in got)
    made = [d for d in set(os.listdir(top)) - before if d.startswith("spans-")]
    assert len(made) == 1 and len(os.listdir(f"{top}/{made[0]}")) == 1  # what the result reads
    names = next(spans._names(4)(iter(docs.toArrow().to_batches())))
    n = sum(len(spans.Pieces([t], spans.Words()).runs()[0]) for _, t in rows)
    assert 0 < sum(map(len, names.column(1).to_pylist())) <= 4 * n and isinstance(n, int) and np.all(names.column(0).to_numpy() < 16)
