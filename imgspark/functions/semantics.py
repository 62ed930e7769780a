"""Rounding rules, once for columns and once for arrays.

trunc_u8: clamp to 0..255 and drop the fraction, NaN is 0. half_up_u8: add a half first.
wrap_u8: the whole number modulo 256.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def trunc_u8(x: Column) -> Column:
    return F.when(F.isnan(x), F.lit(0)).otherwise(F.least(F.lit(255.0), F.greatest(F.lit(0.0), x)).cast("int"))


def half_up_u8(x: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(x + F.lit(0.5)))).cast("int")


def wrap_u8(x: Column) -> Column:
    return F.pmod(x.cast("long"), F.lit(256)).cast("int")


def np_trunc(x) -> np.ndarray:
    return np.clip(np.nan_to_num(np.asarray(x, np.float64), nan=0.0), 0, 255).astype(np.uint8)


def np_half_up(x) -> np.ndarray:
    return np.clip(np.floor(np.asarray(x, np.float64) + 0.5), 0, 255).astype(np.uint8)


def half_up(x: float) -> int:
    return int(np.floor(x + 0.5))


def gaussian_weights(radius: int, sigma: float | None = None) -> list[float]:
    """2r + 1 weights, summed left to right, then each divided by the sum; sigma is 0.6 r + 0.4 by default."""
    import math

    s = sigma if sigma else 0.6 * radius + 0.4
    raw = [math.exp(-(i * i) / (2 * s * s)) for i in range(-radius, radius + 1)]
    total = 0.0
    for v in raw:
        total += v
    return [v / total for v in raw]


def gaussian3_weights(sigma: float | None = None) -> tuple[float, float]:
    """(centre, side) of the three-tap filter for gray frames; sigma is 1 by default."""
    import math

    s = sigma if sigma else 1.0
    a = math.exp(-1.0 / (2 * s * s))
    centre = 1.0 / (1.0 + 2.0 * a)
    return centre, a * centre


def gamma_table(gamma: float) -> list[int]:
    """(i / 255) ^ (1 / gamma) * 255, truncated: gamma over 1 brightens."""
    if not gamma > 0:
        raise ValueError("gamma must be positive")
    return [min(255, max(0, int((i / 255.0) ** (1.0 / gamma) * 255.0))) for i in range(256)]


#: Fixed by the data model: gray = (77 r + 150 g + 29 b) >> 8.
GRAY = (77, 150, 29)
