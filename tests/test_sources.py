import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from imgspark.api import ImageFrame
from imgspark.frame import SCHEMA, from_pixels, from_spark_image, to_pixels
from imgspark.functions import registry
from imgspark.operators import kernels as K
from imgspark.plans.pipeline import Plan, rewrite
from imgspark.sources import codecs, jpeg, raster, reader
from imgspark.streaming import frames as S

RNG = np.random.default_rng(0)


def smooth(h, w, n=3):
    y, x = np.mgrid[:h, :w]
    return np.stack([(y * 5 + x * 3 + 40 * c) % 256 if n == 1 else np.clip(60 + y * 4 + x * (c + 1) * 2, 0, 255) for c in range(n)], 2).astype(np.uint8)


@pytest.mark.parametrize("shape", [(1, 1), (2, 3), (17, 13)])
def test_round_trips(shape):
    for n in (1, 3, 4):
        f = RNG.integers(0, 256, (*shape, n), dtype=np.uint8)
        for how in ("none", "sub"):
            assert (raster.read_png(raster.write_png(f, 6, how)) == f).all()
    f = RNG.integers(0, 256, (*shape, 3), dtype=np.uint8)
    f[0, 0] = 10  # white space as the first pixel
    assert (raster.read_ppm(raster.write_ppm(f)) == f).all()
    assert (raster.read_bmp(raster.write_bmp(f)) == f).all()


@pytest.mark.parametrize("n", [0, 1, 7, 10_000])
def test_chunked_deflate(n):
    data = bytes(RNG.integers(0, 4, n, dtype=np.uint8))
    for chunks in (1, 3, 8):
        assert zlib.decompress(raster.deflate_chunks(data, 6, chunks)) == data


def png(w, h, depth, colour, raw, extra=b""):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + bytes(4)
    return raster.PNG_HEAD + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def filtered(px, kinds, step):
    """Rows with the filters named, by the definition."""
    out, up = b"", [0] * len(px[0])
    for row, kind in zip(px, kinds):
        line = []
        for i, v in enumerate(row):
            a, b, c = (row[i - step] if i >= step else 0), up[i], (up[i - step] if i >= step else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((v - [0, a, b, (a + b) // 2, paeth][kind]) & 255)
        out += bytes([kind, *line])
        up = row
    return out


def test_png_matrix():
    rows = RNG.integers(0, 256, (5, 12)).tolist()
    assert raster.read_png(png(4, 5, 8, 2, filtered(rows, [0, 1, 2, 3, 4], 3))).reshape(5, 12).tolist() == rows
    assert raster.read_png(png(6, 5, 16, 0, filtered(rows, [4, 3, 2, 1, 0], 2)))[..., 0].tolist() == [r[::2] for r in rows]
    ga = raster.read_png(png(6, 5, 8, 4, filtered(rows, [0] * 5, 2)))
    assert ga.shape == (5, 6, 4) and ga[1, 2].tolist() == [rows[1][4]] * 3 + [rows[1][5]]
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + bytes(4)
    index = [[0, 1], [1, 0]]
    pal = chunk(b"PLTE", bytes([1, 2, 3, 4, 5, 6]))
    assert raster.read_png(png(2, 2, 8, 3, filtered(index, [0, 0], 1), pal))[0].tolist() == [[1, 2, 3], [4, 5, 6]]
    assert raster.read_png(png(2, 2, 8, 3, filtered(index, [0, 0], 1), pal + chunk(b"tRNS", b"\7")))[0].tolist() == [[1, 2, 3, 7], [4, 5, 6, 255]]
    for bad in (b"x", png(2, 2, 4, 0, b""), png(2, 2, 8, 0, bytes([9, 0, 0, 9, 0, 0]))):
        with pytest.raises((ValueError, zlib.error)):
            raster.read_png(bad)


@pytest.mark.parametrize("progressive", [True, False])
def test_jpeg(progressive):
    for h, w in ((1, 1), (8, 8), (17, 13), (40, 33)):
        f = smooth(h, w)
        back = jpeg.read_jpeg(jpeg.write_jpeg(f, 95, progressive))
        assert back.shape == f.shape and np.abs(back.astype(int) - f).max() <= 16
    low = jpeg.write_jpeg(smooth(40, 33), 20, progressive)
    assert len(low) < len(jpeg.write_jpeg(smooth(40, 33), 95, progressive))
    half = jpeg.read_jpeg(jpeg.write_jpeg(smooth(40, 33), 95), (16, 20), True)
    assert half.shape == (20, 17, 3)
    noise = RNG.integers(0, 256, (24, 24, 3), dtype=np.uint8)
    a, b = (jpeg.read_jpeg(jpeg.write_jpeg(noise, 90, p)) for p in (True, False))
    assert (a == b).all()


def test_jpeg_against_spark(spark, tmp_path):
    """Another decoder gives nearly the same pixels, for both kinds of file."""
    for p in (True, False):
        (tmp_path / f"{p}.jpg").write_bytes(jpeg.write_jpeg(smooth(40, 33), 95, p))
    theirs = from_spark_image(spark.read.format("image").load(str(tmp_path)))
    ours = {r.origin.rsplit("/", 1)[-1]: r.data for r in reader.read_images(spark, str(tmp_path)).collect()}
    for r in theirs.collect():
        a, b = (np.frombuffer(x, np.uint8).astype(int) for x in (r.data, ours[r.origin.rsplit("/", 1)[-1]]))
        assert np.abs(a - b).max() <= 6


def test_dispatch():
    assert codecs.format_of("a/B.JPEG") == "jpg"
    with pytest.raises(ValueError):
        codecs.format_of("a/b.gif")
    with pytest.raises(ValueError):
        codecs.encode_bytes(np.zeros((1, 1, 4), np.uint8), "bmp")
    assert codecs.decode_bytes(codecs.encode_bytes(smooth(4, 4, 1), "ppm")).shape == (4, 4, 3)
    for fmt in ("png", "bmp", "ppm", "jpg"):
        assert codecs.dims(codecs.encode_bytes(smooth(5, 7), fmt)) == (7, 5, 3)
    assert codecs.decode_bytes(raster.write_png(smooth(8, 8)), resize={"width": 4}).shape == (4, 4, 3)


def made(spark, n=5):
    rows = [(i, f"f{i}", 7, 5, 3, bytearray(RNG.integers(0, 256, 105, dtype=np.uint8).tobytes())) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_save_read_and_source(spark, tmp_path):
    reader.register(spark)
    fr = made(spark).cache()
    want = sorted(bytes(r.data) for r in fr.collect())
    assert ImageFrame.from_frames(fr).save(str(tmp_path / "a"), "png") == 5
    assert sorted(bytes(r.data) for r in ImageFrame.read(spark, str(tmp_path / "a")).df.collect()) == want
    fr.write.format("imgspark").mode("append").option("image_format", "bmp").save(str(tmp_path / "b"))
    assert sorted(bytes(r.data) for r in spark.read.format("imgspark").load(str(tmp_path / "b")).collect()) == want
    files = reader.image_files(spark, str(tmp_path / "a"))
    assert "content" not in files.select("path", "length")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_pixels_and_back(spark):
    fr = made(spark).cache()
    back = from_pixels(to_pixels(fr)).orderBy("img_id").collect()
    assert [bytes(r.data) for r in back] == [bytes(r.data) for r in fr.orderBy("img_id").collect()]


def test_plans():
    p = Plan().grayscale().blur(1).edges()
    assert [s.name for s in rewrite(p.steps)] == ["gray_binomial_edges"]
    assert [s.name for s in rewrite(Plan().grayscale().blur(1, 2.0).edges().steps)] == ["grayscale", "blur_edges"]
    assert [s.name for s in rewrite(Plan().grayscale().threshold(9).erode(2).invert().invert().steps)] == ["gray_threshold_erode"]
    assert [s.name for s in rewrite(Plan().grayscale().threshold(9).blur().edges().steps)] == ["gray_threshold", "binomial_edges"]
    f = RNG.integers(0, 256, (9, 9, 3), dtype=np.uint8)
    steps = rewrite(Plan().grayscale().threshold(90).erode(1).steps)
    assert (steps[0].run(f) == K.erode(K.threshold(K.grayscale(f), 90), 1)).all()
    with pytest.raises(AttributeError):
        Plan().no_such_kernel()


def test_fluent_and_user_kernel(spark):
    registry.register_kernel("darken", lambda f, by=1: (f // (by + 1)).astype(np.uint8))
    fr = made(spark, 2)
    im = ImageFrame.from_frames(fr)
    got = im.grayscale().darken(by=1).flip_h()
    first = fr.orderBy("img_id").first()
    want = K.flip_h(K.grayscale(np.frombuffer(first.data, np.uint8).reshape(5, 7, 3)) // 2)
    assert bytes(got.df.orderBy("img_id").first().data) == np.ascontiguousarray(want).tobytes()
    assert im.pipeline().grayscale().threshold(10).explain().startswith("gray_threshold")
    assert im.pipeline().grayscale().threshold(10).run().dims().collect()[0].channels == 1
    assert im.grayscale().histogram().count() == 2 * 256
    assert im.grayscale().threshold(1).connected_components().count() >= 2
    with pytest.raises(AttributeError):
        im.no_such_kernel


def test_streams(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    for i in range(3):
        (src / f"{i}.png").write_bytes(raster.write_png(smooth(6, 6)))
    frames = S.stream_images(spark, str(src))
    q = S.write_stream(frames, str(out), str(tmp_path / "ck"), "ppm").start()
    q.processAllAvailable()
    (src / "3.png").write_bytes(raster.write_png(smooth(6, 6)))
    q.processAllAvailable()
    q.stop()
    assert len(list(out.glob("*.ppm"))) == 4
    q = S.value_counts(S.stream_images(spark, str(src))).writeStream.outputMode("complete").format("memory").queryName("value_counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) AS n FROM value_counts").first().n == 4 * 108
    q = S.arrivals(S.stream_files(spark, str(src))).writeStream.outputMode("complete").format("memory").queryName("arrivals").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) AS n FROM arrivals").first().n == 4


def test_small_batches_start_few_jobs(spark, tmp_path):
    """A batch of 40 files starts no job to look them up; decoding and writing are one Python step, so a batch is as cheap as can be."""
    src = tmp_path / "in"
    src.mkdir()
    for i in range(40):
        (src / f"{i}.png").write_bytes(raster.write_png(smooth(6, 6)))
    name = "spark.sql.sources.parallelPartitionDiscovery.threshold"
    before, jobs = spark.conf.get(name), []
    for listed in (1, 40):
        with S.small_batches(spark, listed):
            q = S.write_stream(S.stream_images(spark, str(src), files_per_trigger=40), str(tmp_path / f"out{listed}"), str(tmp_path / f"ck{listed}")).trigger(availableNow=True).start()
            q.awaitTermination()
        assert len(list((tmp_path / f"out{listed}").glob("*.png"))) == 40
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(str(q.runId))))
    assert jobs[1] == jobs[0] - 1 and spark.conf.get(name) == before
    written = reader.write_images(codecs.decode_frames(reader.image_files(spark, str(src))), str(tmp_path / "w"), parts=3)
    plan = written._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and ", 3), REPARTITION_BY_NUM" in plan and written.count() == 40


def test_equal_names_are_an_error_when_only_counted(spark, tmp_path):
    """save and streams count what was written; two frames of one name are an error there too, and not one frame less."""
    px = spark.createDataFrame([(1, 0, 0, 0, 5)], "img_id long, y int, x int, c int, v int")
    fr = from_pixels(px)
    assert ImageFrame.from_frames(fr).save(str(tmp_path / "one"), "png") == 1
    with pytest.raises(Exception, match="several frames are named"):
        ImageFrame.from_frames(fr.unionByName(fr)).save(str(tmp_path / "two"), "png")


def with_restarts(data, every):
    """The same baseline picture with a restart marker after so many units, coded anew."""
    im = jpeg.parse(data)
    jpeg.coefficients(im)
    n = im.parts[0].blocks.shape[0] * im.parts[0].blocks.shape[1]
    comps = [c.blocks.reshape(n, 64).astype(np.int64) for c in im.parts]
    intervals = []
    for at in range(0, n, every):
        found = []
        for i, c in enumerate(comps):
            for kind, (block, place, *token) in ((0, jpeg.dc_tokens(c[at : at + every])), (1, jpeg.ac_tokens(c[at : at + every], 1, 63))):
                found.append([(block * 3 + i) * 256 + place, np.full(len(block), kind << 4 | min(i, 1)), *token])
        parts = [np.concatenate(x) for x in zip(*found)]
        order = np.argsort(parts[0], kind="stable")
        intervals.append([p[order] for p in parts[1:]])
    table, symbol = (np.concatenate(x) for x in list(zip(*intervals))[:2])
    head, codes = data[: data.index(b"\xff\xc4")], {}
    out = bytearray(head + struct.pack(">HHH", 0xFFDD, 4, every))
    for t in np.unique(table).tolist():
        counts, values = jpeg.optimal(np.bincount(symbol[table == t], minlength=256))
        out += struct.pack(">HHB", 0xFFC4, 3 + 16 + len(values), t) + bytes(counts) + bytes(values)
        codes |= {(t, v): c for v, c in jpeg.canonical(counts, values).items()}
    out += bytes([0xFF, 0xDA, 0, 12, 3, 1, 0, 2, 0x11, 3, 0x11, 0, 63, 0])
    for i, (t, s, v, k) in enumerate(intervals):
        code = np.array([codes[x] for x in zip(t.tolist(), s.tolist())])
        out += jpeg.pack_bits(np.column_stack([code[:, 0], v]).ravel(), np.column_stack([code[:, 1], k]).ravel())
        if i + 1 < len(intervals):
            out += bytes([0xFF, 0xD0 + i % 8])
    return bytes(out + b"\xff\xd9")


@pytest.mark.parametrize("every", [1, 3, 7, 100])
def test_jpeg_restart_markers(every):
    data = jpeg.write_jpeg(smooth(40, 33), 90, False)
    assert (jpeg.read_jpeg(with_restarts(data, every)) == jpeg.read_jpeg(data)).all()


def test_jpeg_in_many_chunks(monkeypatch):
    """Looking bits up a little at a time gives the same."""
    noise = RNG.integers(0, 256, (64, 48, 3), dtype=np.uint8)
    files = [jpeg.write_jpeg(noise, 95, p) for p in (True, False)]
    want = [jpeg.read_jpeg(f) for f in files]
    monkeypatch.setattr(jpeg, "CHUNK", 1)
    assert all((jpeg.read_jpeg(f) == w).all() for f, w in zip(files, want))


def test_broken_jpeg_is_a_value_error():
    data = jpeg.write_jpeg(smooth(40, 33), 90, False)
    for cut in range(2, len(data) - 30, 7):
        try:
            jpeg.read_jpeg(data[:cut])
        except ValueError:
            pass
    for at in range(len(data) // 2, len(data), 5):
        bad = bytearray(data)
        bad[at] ^= 0x55
        try:
            jpeg.read_jpeg(bytes(bad))
        except ValueError:
            pass


def test_broken_files(spark, tmp_path):
    """Each way of handling errors, by both readers; ids agree between them."""
    reader.register(spark)
    good = raster.write_png(smooth(6, 6))
    (tmp_path / "sub").mkdir()
    for name, data in {"a.png": good, "b.png": good[:40], "c.jpg": b"no image", "d.ppm": b"P6 x", "sub/e.png": good, "x.txt": b"x", ".hidden.png": b""}.items():
        (tmp_path / name).write_bytes(data)
    where = str(tmp_path)
    with pytest.raises(Exception, match="b.png|c.jpg|d.ppm"):
        reader.read_images(spark, where).collect()
    kept = reader.read_images(spark, where, errors="drop", recursive=True).collect()
    assert sorted(r.origin.rsplit("/", 1)[-1] for r in kept) == ["a.png", "e.png"]
    every = {r.origin.rsplit("/", 1)[-1]: r for r in reader.read_images(spark, where, errors="column").collect()}
    assert set(every) == {"a.png", "b.png", "c.jpg", "d.ppm"} and every["a.png"].error is None
    assert all(every[n].error and every[n].data is None for n in ("b.png", "c.jpg", "d.ppm"))
    source = spark.read.format("imgspark").option("errors", "drop").option("tasks", "3").load(where).collect()
    assert sorted(r.img_id for r in source) == sorted(r.img_id for r in kept)
    with pytest.raises(ValueError):
        reader.read_images(spark, where, errors="skip")


def test_source_writes_in_two_phases(spark, tmp_path):
    reader.register(spark)
    fr = made(spark, 6).cache()
    to = tmp_path / "out"
    to.mkdir()
    (to / "0.png").write_bytes(b"was here")
    bad = fr.withColumn("data", F.when(F.col("img_id") == 5, F.lit(bytearray(b"short"))).otherwise(F.col("data"))).coalesce(1)
    with pytest.raises(Exception, match="bad frame"):
        bad.write.format("imgspark").mode("append").save(str(to))
    assert (to / "0.png").read_bytes() == b"was here" and not (to / "1.png").exists()
    fr.write.format("imgspark").mode("append").save(reader.qualified(spark, str(to)))
    assert sorted(p.name for p in to.glob("*.png")) == [f"{i}.png" for i in range(6)] and (to / "0.png").read_bytes() != b"was here"


def test_frames_of_one_name_are_an_error(spark, tmp_path):
    a = np.zeros((2, 2, 1), np.uint8)
    reader.register(spark)
    fr = spark.createDataFrame([(1, "a", 2, 2, 1, bytearray(a.tobytes())), (1, "b", 2, 2, 1, bytearray((a + 1).tobytes()))], SCHEMA)
    with pytest.raises(Exception, match="several frames are named"):
        reader.write_images(fr, str(tmp_path / "w"), "png").collect()
    to = reader.qualified(spark, str(tmp_path / "s"))
    with pytest.raises(Exception, match="several frames are named"):
        fr.write.format("imgspark").mode("append").save(to)
    # written again under the same names is no error
    for _ in range(2):
        assert reader.write_images(fr.limit(1), str(tmp_path / "w2"), "png").count() == 1


def test_filters_reach_the_source(spark, tmp_path):
    """Of files that don't fit, the header alone is read: broken pixels behind it raise nothing."""
    where = tmp_path / "f"
    where.mkdir()
    for i, (h, w) in enumerate([(4, 8), (4, 16), (9, 16), (9, 40)]):
        data = raster.write_png(np.full((h, w, 1), i, np.uint8))
        (where / f"{i}.png").write_bytes(data if w != 40 else data[:40])  # the largest has a header only
    reader.register(spark)
    path = reader.qualified(spark, str(where))
    read = lambda: spark.read.format("imgspark").option("tasks", "2").load(path)
    with pytest.raises(Exception):
        read().collect()
    assert sorted((r.height, r.width) for r in read().filter("width < 20 AND height >= 4").collect()) == [(4, 8), (4, 16), (9, 16)]
    assert [(r.height, r.width) for r in read().filter("width = 16 AND height > 5").collect()] == [(9, 16)]
    name = read().filter("width = 8").first()["origin"]
    assert read().filter(F.col("origin") == name).count() == 1 and read().filter(F.col("origin").isin(name, "x")).count() == 1
