"""User kernels: methods of ImageFrame and SQL functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf, arrow_udtf, pandas_udf, udtf

from imgspark.frame import to_array
from imgspark.operators import kernels as K

#: name -> frame kernel that ImageFrame and plans offer
KERNELS: dict[str, Callable] = {}


def register_kernel(name: str, f: Callable | None = None):
    """Adds a kernel (frame array, arguments -> frame array) under a name; usable as a decorator."""
    if f is None:
        return lambda g: register_kernel(name, g)
    KERNELS[name] = f
    return f


for _name in (
    "grayscale threshold gray_to_rgb to_rgb invert brightness_contrast gamma extract_channel rgb_to_hsv hsv_to_rgb in_range_gray in_range_rgb in_range_hsv crop crop_around point_table flip_h flip_v rotate90 rotate180 rotate270 "
    "resize_nearest resize_bilinear resize_area resize resize_fit resize_q15 resize_auto scale warp_affine convolve sharpen box_blur gaussian_blur gaussian_blur_taps sobel erode dilate open_ close "
    "morph_gradient top_hat black_hat adaptive_threshold canny equalize normalize draw_point draw_line draw_rect draw_filled_rect draw_circle draw_filled_circle draw_boxes binomial_edges "
    "gray_binomial_edges gray_threshold gray_threshold_erode blur_edges"
).split():
    register_kernel(_name, getattr(K, _name))
for _alias, _name in {"blur": "gaussian_blur", "edges": "sobel", "open": "open_", "channel": "extract_channel"}.items():
    register_kernel(_alias, KERNELS[_name])


def register_functions(spark: SparkSession) -> None:
    """frame_mean(width, height, channels, data), frame_kernel(name, ...), frame_histogram(...) over Arrow arrays, and the table
    functions frame_components(width, height, channels, data) and, over Arrow batches, components_of_frames(TABLE(...))."""

    @pandas_udf("double")
    def frame_mean(width, height, channels, data):
        import pandas as pd

        return pd.Series([float(to_array(w, h, c, d).mean()) for w, h, c, d in zip(width, height, channels, data)])

    @pandas_udf("binary")
    def frame_kernel(name, width, height, channels, data):
        """Kernels without arguments that keep the size."""
        import pandas as pd

        return pd.Series([np.ascontiguousarray(KERNELS[n](to_array(w, h, c, d))).tobytes() for n, w, h, c, d in zip(name, width, height, channels, data)])

    @udtf(returnType="id int, x int, y int, width int, height int, area long, centroid_x double, centroid_y double")
    class FrameComponents:
        def eval(self, width: int, height: int, channels: int, data: bytes):
            yield from K.components(to_array(width, height, channels, bytes(data)))

    @arrow_udf("array<long>")
    def frame_histogram(width, height, channels, data):
        """256 counts a channel, one channel after the other; null for a null frame."""
        import pyarrow as pa

        out = []
        for w, h, c, d in zip(*(a.to_pylist() for a in (width, height, channels, data))):
            out.append(None if d is None else K.histogram(to_array(w, h, c, d)).ravel().tolist())
        return pa.array(out, pa.list_(pa.int64()))

    @arrow_udtf(returnType="img_id long, id int, x int, y int, width int, height int, area long")
    class ComponentsOfFrames:
        """Of a table of frames: whole Arrow batches in, one batch of components out."""

        def eval(self, table):
            import pyarrow as pa

            rows = [(i, *c[:6]) for i, w, h, n, d in zip(*(table.column(k).to_pylist() for k in ("img_id", "width", "height", "channels", "data"))) for c in K.components(to_array(w, h, n, d))]
            kinds = {"img_id": pa.int64(), "id": pa.int32(), "x": pa.int32(), "y": pa.int32(), "width": pa.int32(), "height": pa.int32(), "area": pa.int64()}
            yield pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(kinds.items())})

    spark.udf.register("frame_histogram", frame_histogram)
    spark.udtf.register("components_of_frames", ComponentsOfFrames)
    spark.udf.register("frame_mean", frame_mean)
    spark.udf.register("frame_kernel", frame_kernel)
    spark.udtf.register("frame_components", FrameComponents)
