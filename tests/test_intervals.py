"""JPEG by restart intervals: cut, read and written by bands."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_sources import smooth, with_restarts

from imgspark.frame import SCHEMA, from_arrays, to_pixels
from imgspark.sources import intervals, jpeg
from imgspark.sources.codecs import decode_frames

RNG = np.random.default_rng(9)


def pasted(data, least=1):
    """The picture from its bands, and how many there are."""
    parts = list(intervals.split(data, least))
    assert all(whole == parts[0][1] for _, whole, _ in parts)
    decoded = [jpeg.read_jpeg(p) for _, _, p in parts]
    assert [top for top, _, _ in parts] == [sum(d.shape[0] for d in decoded[:i]) for i in range(len(parts))]
    return np.concatenate(decoded), len(parts)


@pytest.mark.parametrize("progressive", [True, False])
@pytest.mark.parametrize("rows", [1, 2, 3, 9])
def test_bands_of_written_files(progressive, rows):
    f = RNG.integers(0, 256, (67, 45, 3), dtype=np.uint8)
    data, plain = jpeg.write_jpeg(f, 80, progressive, rows), jpeg.write_jpeg(f, 80, progressive)
    got, n = pasted(data)
    assert (got == jpeg.read_jpeg(plain)).all() and (jpeg.read_jpeg(data) == got).all()
    assert n == -(-9 // rows)
    assert pasted(data, 24)[1] == -(-9 // (-(-3 // rows) * rows))
    assert pasted(plain)[1] == 1


@pytest.mark.parametrize("every, bands", [(1, 5), (5, 5), (10, 3), (3, 2), (7, 1), (100, 1)])
def test_intervals_across_rows(every, bands):
    """Five units in each of five rows: a file is cut where an interval starts with a row."""
    data = with_restarts(jpeg.write_jpeg(smooth(40, 33), 90, False), every)
    got, n = pasted(data)
    assert n == bands and (got == jpeg.read_jpeg(data)).all()


def subsampled(h, w, progressive):
    """A file whose chroma has half the rows and columns, with an interval for each row of units: a scan of all
    components and, if progressive, scans of one, whose blocks end with the picture and not with the unit."""
    across, down = -(-w // 16), -(-h // 16)
    cols, rows = -(-w // 8), -(-h // 8)
    blocks = [RNG.integers(-20, 20, (down * v, across * v, 64)) * (RNG.random((down * v, across * v, 64)) < 0.1) for v in (2, 1, 1)]
    head = jpeg.opening(w, h, 90, progressive).replace(bytes([3, 1, 0x11, 0]), bytes([3, 1, 0x22, 0]))

    def dri(n):
        return jpeg.segment(0xDD, n.to_bytes(2, "big"))

    def scan(which, first, last, tokens):
        opened, codes = jpeg.scan_head(which, first, last, sum(map(jpeg.symbol_counts, tokens)))
        return opened + jpeg.restarted(jpeg.coded(t, codes) for t in tokens)

    def row_of_units(r, first, last):
        order = {0: blocks[0][2 * r : 2 * r + 2].reshape(2, across, 2, 64).transpose(1, 0, 2, 3).reshape(-1, 64), 1: blocks[1][r], 2: blocks[2][r]}
        found = []
        for i, b in order.items():
            per = len(b) // across
            for kind, (block, place, *token) in [(0, jpeg.dc_tokens(b))] + ([(1, jpeg.ac_tokens(b, 1, last))] if last else []):
                found.append([((block // per * 6 + (0, 4, 5)[i] + block % per) * 256 + place), np.full(len(block), kind << 4 | min(i, 1)), *token])
        place, *token = (np.concatenate(x) for x in zip(*found))
        return [t[np.argsort(place, kind="stable")] for t in token]

    out = head + dri(across) + scan([0, 1, 2], 0, 0 if progressive else 63, [row_of_units(r, 0, 0 if progressive else 63) for r in range(down)])
    if progressive:
        luma = blocks[0][:rows, :cols]
        # one interval of the luma scan is a row of units, so two rows of blocks
        out += dri(2 * cols) + scan([0], 1, 63, [jpeg.scan_tokens([luma[r : r + 2].reshape(-1, 64)], [0], 1, 63) for r in range(0, rows, 2)])
        chroma = [b[: -(-(-(-h // 2)) // 8), : -(-(-(-w // 2)) // 8)] for b in blocks]
        for i in (1, 2):
            out += dri(chroma[i].shape[1]) + scan([i], 1, 63, [jpeg.scan_tokens([b[r] for b in chroma], [i], 1, 63) for r in range(chroma[i].shape[0])])
    return out + b"\xff\xd9"


@pytest.mark.parametrize("progressive", [True, False])
@pytest.mark.parametrize("h, w", [(64, 48), (57, 41), (37, 16), (9, 7)])
def test_subsampled_bands(progressive, h, w):
    data = subsampled(h, w, progressive)
    got, n = pasted(data)
    assert n == -(-h // 16) and got.shape == (h, w, 3) and (got == jpeg.read_jpeg(data)).all()


def test_missing_intervals_are_not_cut():
    data = jpeg.write_jpeg(RNG.integers(0, 256, (64, 40, 3), dtype=np.uint8), 90, False, 1)
    last = data.rindex(b"\xff\xd6")
    got, n = pasted(data[:last] + b"\xff\xd9")
    assert n == 1 and (got == jpeg.read_jpeg(data[:last] + b"\xff\xd9")).all()


@pytest.mark.parametrize("progressive", [True, False])
def test_files_by_bands(spark, progressive):
    """Files coded by many tasks are, byte for byte, those of one; read by bands they are the same picture."""
    shapes = [(70, 33, 3), (8, 8, 1), (1, 1, 3), (200, 17, 1)]
    arrays = [RNG.integers(0, 256, s, dtype=np.uint8) for s in shapes]
    table = from_arrays([(i, "x", a) for i, a in enumerate(arrays)])
    px = to_pixels(spark.createDataFrame(table.to_pylist(), SCHEMA))
    files = intervals.jpeg_files(px, 85, progressive, 2)
    got = {r.img_id: bytes(r.content) for r in files.collect()}
    rgb = [np.repeat(a, 3, 2) if a.shape[2] == 1 else a for a in arrays]
    assert got == {i: jpeg.write_jpeg(a, 85, progressive, 2) for i, a in enumerate(rgb)}
    stored = spark.createDataFrame([(i, f"{i}.jpg", bytearray(b)) for i, b in got.items()], "img_id long, path string, content binary")
    bands = intervals.jpeg_bands(stored, 16, 3)
    assert {r.img_id: r.n for r in bands.groupBy("img_id").agg(F.count("*").alias("n")).collect()} == {0: 5, 1: 1, 2: 1, 3: 13}
    whole = {r.img_id: bytes(r.data) for r in intervals.join_bands(bands).collect()}
    assert whole == {r.img_id: bytes(r.data) for r in decode_frames(stored).collect()}
    assert to_pixels(bands).exceptAll(to_pixels(decode_frames(stored))).isEmpty()
    assert intervals.jpeg_files(px.limit(0)).collect() == [] and intervals.jpeg_bands(stored.limit(0)).collect() == []


def test_broken_files_by_bands(spark, tmp_path):
    good = jpeg.write_jpeg(RNG.integers(0, 256, (64, 40, 3), dtype=np.uint8), 90, True, 1)
    for name, data in {"a.jpg": good, "b.jpg": b"\xff\xd8nothing", "c.jpeg": good[:300]}.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "d.png").write_bytes(b"")
    with pytest.raises(Exception, match="b.jpg|c.jpeg"):
        intervals.read_bands(spark, str(tmp_path), 8).collect()
    kept = intervals.read_bands(spark, str(tmp_path), 8, errors="drop").collect()
    assert {r.origin.rsplit("/", 1)[-1] for r in kept if r.whole == 64} >= {"a.jpg"} and sum(r.origin.endswith("a.jpg") for r in kept) == 8
    with pytest.raises(ValueError):
        intervals.jpeg_bands(kept and spark.createDataFrame([(1, "a", bytearray(good))], "img_id long, path string, content binary"), errors="column")


def test_the_query_makes_and_decodes_bands_once(spark):
    """Each step in Python stands in the plan as often as it has to run; bands were made twice and decoded three times."""
    from imgspark.catalogue import queries

    df = queries()["s_jpeg_intervals"](spark, "/root/testdata/sf0.001")
    assert all(r["same"] and r["within"] for r in df.collect())
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("MapInArrow decode(") == plan.count("MapInArrow code(") == plan.count("MapInArrow count(") == 1
    assert plan.count("MapInArrow run(") == 3  # rows of the source for the files and for the comparison, and whole files decoded
