"""Megapixels and images a second of the frame operators on frames of a megapixel; prints one JSON line.

BENCH_CPUS: threads (default 8). BENCH_FRAMES: how many frames of 1024 x 1024 (default 64).
"""

import json
import os
import time

import numpy as np

SIDE = 1024


def frames(spark, n: int, channels: int):
    from imgspark.frame import SCHEMA, from_arrays

    def run(batches):
        y, x = np.mgrid[:SIDE, :SIDE]
        for batch in batches:
            for i in batch.column(0).to_pylist():
                rng = np.random.default_rng(i)
                base = (np.sin(x / (20 + i % 7)) + np.cos(y / 31)) * 60 + 128
                a = base[..., None] + np.arange(channels) * 20 + rng.integers(-8, 9, (SIDE, SIDE, channels))
                yield from_arrays([(i, "bench", np.clip(a, 0, 255).astype(np.uint8))])

    return spark.range(0, n, 1, n).mapInArrow(run, SCHEMA)


def main() -> None:
    from pyspark.sql import SparkSession

    from imgspark.frame import map_frames
    from imgspark.operators import components as C
    from imgspark.operators import kernels as K
    from imgspark.plans.pipeline import Plan
    from imgspark.sources import codecs

    cpus, n = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_FRAMES", "64"))
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.execution.arrow.maxRecordsPerBatch", "4").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    where = f"/tmp/bench-mpx-{os.getpid()}"
    gray, rgb = where + "/gray", where + "/rgb"
    frames(spark, n, 1).write.parquet(gray)
    frames(spark, n, 3).write.parquet(rgb)
    gray, rgb = spark.read.parquet(gray), spark.read.parquet(rgb)
    jpg, png = where + "/jpg", where + "/png"
    codecs.encode_frames(rgb, "jpg").write.parquet(jpg)
    codecs.encode_frames(rgb, "png").write.parquet(png)
    jpg, png = spark.read.parquet(jpg), spark.read.parquet(png)
    runs = {
        "read only": gray,
        "threshold": map_frames(gray, K.threshold),
        "grayscale": map_frames(rgb, K.grayscale),
        "rgb_to_hsv": map_frames(rgb, K.rgb_to_hsv),
        "resize bilinear 512": map_frames(rgb, lambda a: K.resize(a, 512, 512)),
        "resize area 512": map_frames(rgb, lambda a: K.resize(a, 512, 512, "area")),
        "resize fixed point 512": map_frames(rgb, lambda a: K.resize_q15(a, 512, 512)),
        "warp affine": map_frames(rgb, lambda a: K.warp_affine(a, (0.9, 0.1, 0, -0.1, 0.9, 0))),
        "gaussian radius 2": map_frames(gray, lambda a: K.gaussian_blur(a, 2)),
        "box blur radius 5": map_frames(gray, lambda a: K.box_blur(a, 5)),
        "sobel": map_frames(gray, K.sobel),
        "erode radius 5": map_frames(gray, lambda a: K.erode(a, 5)),
        "adaptive threshold": map_frames(gray, K.adaptive_threshold),
        "canny": map_frames(gray, K.canny),
        "equalize": map_frames(gray, K.equalize),
        "components": C.components(map_frames(gray, K.threshold)),
        "plan gray, blur, edges, threshold, dilate": Plan().grayscale().blur(1).edges().threshold(60).dilate(1).run(rgb),
        "jpeg decode": codecs.decode_frames(jpg),
        "jpeg encode": codecs.encode_frames(rgb, "jpg"),
        "png decode": codecs.decode_frames(png),
        "png encode": codecs.encode_frames(rgb, "png"),
    }
    out = {}
    for name, df in runs.items():
        best = None
        for _ in range(2):
            start = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.perf_counter() - start)
        out[name] = {"images_s": round(n / best, 1), "mpx_s": round(n * SIDE * SIDE / 1e6 / best, 1)}
    print(json.dumps({"metric": f"megapixels a second, {n} frames of {SIDE} x {SIDE}, {cpus} threads, best of 2", "operators": out}), flush=True)
    spark.stop()
    import shutil

    shutil.rmtree(where, ignore_errors=True)


if __name__ == "__main__":
    main()
