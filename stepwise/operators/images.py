"""Screenshots: pixel change and blankness, by Arrow UDFs over image bytes."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

# Limits of a dark or blank screen.
DARK_MEAN, BLANK_STD = 8.0, 3.0


def _load(data: bytes, mode: str, size: tuple[int, int] | None = None) -> np.ndarray:
    from PIL import Image  # only needed where images are read

    image = Image.open(io.BytesIO(data)).convert(mode)
    return np.asarray(image if size is None or image.size == size else image.resize(size), dtype=np.float64)


@F.pandas_udf("double")
def pixel_change(before: pd.Series, after: pd.Series) -> pd.Series:
    """Mean absolute difference of two images over 255, the second in the first one's size; null if either is missing."""

    def one(a: bytes | None, b: bytes | None) -> float | None:
        if a is None or b is None:
            return None
        x = _load(a, "RGB")
        return float(np.abs(x - _load(b, "RGB", (x.shape[1], x.shape[0]))).mean() / 255)

    return pd.Series([one(a, b) for a, b in zip(before, after, strict=True)], dtype="float64")


@F.pandas_udf("boolean")
def blank_or_dark(image: pd.Series) -> pd.Series:
    def one(data: bytes | None) -> bool | None:
        if data is None:
            return None
        luma = _load(data, "L")
        return bool(luma.mean() < DARK_MEAN or luma.std() < BLANK_STD)

    return pd.Series([one(x) for x in image], dtype="object")
