"""Perceptual signatures of image files through Spark's image reader (formats that the JVM decodes)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from dupscape.functions.bits import difference_hash

#: Shares of width and height that the three hashes look at, and the grid's size.
CROPS, ROWS, COLUMNS = (1.0, 0.9, 0.8), 8, 9


def grid(gray: np.ndarray) -> np.ndarray:
    """Mean brightness of 8 x 9 cells."""
    h, w = gray.shape
    ys = np.minimum(np.arange(ROWS + 1) * h // ROWS, h)
    xs = np.minimum(np.arange(COLUMNS + 1) * w // COLUMNS, w)
    sums = np.pad(gray.astype(np.float64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    y0, y1 = np.minimum(ys[:-1], h - 1), np.maximum(ys[1:], np.minimum(ys[:-1], h - 1) + 1)
    x0, x1 = np.minimum(xs[:-1], w - 1), np.maximum(xs[1:], np.minimum(xs[:-1], w - 1) + 1)
    total = sums[np.ix_(y1, x1)] - sums[np.ix_(y0, x1)] - sums[np.ix_(y1, x0)] + sums[np.ix_(y0, x0)]
    return total / ((y1 - y0)[:, None] * (x1 - x0)[None, :])


def signature(data: bytes, height: int, width: int, channels: int) -> tuple[list[int], float, float] | None:
    """Three hashes, mean and population deviation; rows are BGR or gray, as the image reader gives them."""
    if not data or height <= 0 or width <= 0 or len(data) < height * width * channels:
        return None
    pixels = np.frombuffer(data, np.uint8, height * width * channels).reshape(height, width, channels)
    gray = pixels[:, :, 0].astype(np.float64) if channels == 1 else pixels[:, :, :3] @ np.array([0.114, 0.587, 0.299])
    hashes = []
    for share in CROPS:
        dy, dx = int(height * (1 - share) / 2), int(width * (1 - share) / 2)
        hashes.append(difference_hash(grid(gray[dy : height - dy, dx : width - dx])))
    whole = grid(gray)
    return hashes, float(whole.mean()), float(whole.std())


@pandas_udf(StructType([StructField("hashes", ArrayType(LongType())), StructField("mean", DoubleType()), StructField("deviation", DoubleType())]))
def signed(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.DataFrame:
    rows = [signature(d, h, w, c) or (None, None, None) for d, h, w, c in zip(data, height, width, channels)]
    return pd.DataFrame(rows, columns=["hashes", "mean", "deviation"])


def image_signatures(spark: SparkSession, path: str) -> DataFrame:
    """``(path, hashes, mean, deviation)`` of the decodable images below ``path``; broken files are left out."""
    images = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path)
    found = images.select(F.col("image.origin").alias("path"), signed("image.data", "image.height", "image.width", "image.nChannels").alias("s"))
    return found.select("path", "s.hashes", "s.mean", "s.deviation").where("hashes is not null")
