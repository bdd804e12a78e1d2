"""Pixel statistics over Spark's ``image`` source (rows of BGR bytes), by NumPy in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

# Dark level and share of ink, saturation that counts as colour, label shapes.
INK_LEVEL, INK_SHARE, SATURATION = 90, 0.001, 20


def _gray(image: dict) -> np.ndarray:
    pixels = np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], image["nChannels"])
    if image["nChannels"] == 1:
        return pixels[:, :, 0]
    b, g, r = (pixels[:, :, i].astype(np.uint32) for i in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16).astype(np.uint8)


def _statistics(image: dict, margin: float) -> tuple[float, float, float]:
    gray = _gray(image)
    dy, dx = int(gray.shape[0] * margin), int(gray.shape[1] * margin)
    inner = gray[dy : gray.shape[0] - dy, dx : gray.shape[1] - dx]
    ink = float((inner < INK_LEVEL).mean()) if inner.size else 0.0
    if image["nChannels"] < 3:
        return ink, float(gray.mean()), 0.0
    pixels = np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], image["nChannels"])[:, :, :3].astype(np.int32)
    high, low = pixels.max(axis=2), pixels.min(axis=2)
    saturation = np.divide(255 * (high - low), high, out=np.zeros(high.shape), where=high > 0)
    return ink, float(gray.mean()), float((np.rint(saturation) > SATURATION).mean())


_SHARES = StructType([StructField(n, DoubleType()) for n in ("ink", "brightness", "colour")])


def shares(image: Column, margin: float = 0.0) -> Column:
    """Struct (ink, brightness, colour): share of dark inner pixels, mean grey, share of saturated
    pixels of an image struct."""

    @F.pandas_udf(_SHARES)
    def of(images: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([_statistics(i, margin) for i in images.to_dict("records")], columns=_SHARES.names)

    return of(image)


def has_ink(statistics: Column) -> Column:
    return statistics["ink"] >= INK_SHARE


def frame_label(aspect: Column, area: Column, pale: Column, strip_area: float, strip_aspect: float, whole: float, sheet_area: float, sheet_aspect: tuple[float, float]) -> Column:
    """Label of a box by shape: wide ones are cheques unless they are large pale strips, large pale
    portrait ones are sheets, and one that is the whole picture has none."""
    strip = (area >= strip_area) & (aspect <= strip_aspect) & pale
    sheet = (area >= sheet_area) & aspect.between(*sheet_aspect) & pale
    return F.when(aspect >= 1.8, F.when(strip, "sefach").otherwise("cheque_front")).when((area < whole) & sheet, "sefach")
