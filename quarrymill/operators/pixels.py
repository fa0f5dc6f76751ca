"""Measures of decoded pictures: blur by a 3x3 stencil, and counts of four channels.

A picture is a row (id, width, height, pixels): red, green and blue of 0 to 255 by turns, row by row. Pictures of one size
are stacked and measured together inside a task; each gives one row. A picture without pixels, or whose pixels don't fill its
size, has a blur of 0 and no counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shares of red, green and blue in a grey value, as whole numbers of 2^14 and as decimals.
GREY, LUMINANCE = (4899, 9617, 1868), (0.299, 0.587, 0.114)
BATCH_PIXELS, BATCH_PICTURES = 1 << 19, 1_000  # of one stack; a picture's counts are 1,024 numbers, however small it is


def grey(rgb: np.ndarray) -> np.ndarray:
    """[..., 3] to grey values, rounded to whole ones."""
    return (rgb.astype(np.int64) @ np.array(GREY) + (1 << 13)) >> 14


def laplacian_variance(grey_pictures: np.ndarray) -> np.ndarray:
    """Of each picture [n, height, width] the variance of what the four neighbours have more than the middle; edges are mirrored, without the edge itself."""
    x = grey_pictures.astype(np.float64)
    for axis in (1, 2):
        x = np.pad(x, [(1, 1) if a == axis else (0, 0) for a in range(3)], mode="reflect" if x.shape[axis] > 1 else "edge")
    stencil = x[:, :-2, 1:-1] + x[:, 2:, 1:-1] + x[:, 1:-1, :-2] + x[:, 1:-1, 2:] - 4 * x[:, 1:-1, 1:-1]
    return stencil.reshape(len(x), -1).var(1)


def channel_counts(rgb: np.ndarray) -> np.ndarray:
    """[n, pixels, 3] to counts [n, 4, 256] of red, green, blue and luminance."""
    red, green, blue = (LUMINANCE[k] * rgb[..., k] for k in range(3))
    luminance = np.floor(red + green + blue + 0.5)
    values = np.concatenate([rgb, luminance[..., None]], 2).astype(np.int64)
    n = len(values)
    place = (np.arange(n)[:, None, None] * 4 + np.arange(4)) * 256 + values
    return np.bincount(place.ravel(), minlength=n * 1024).reshape(n, 4, 256)


def _stacks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray | None, int, int]]:
    """Rows of one size with their pixels [n, pixels, 3]; rows that are no picture with None."""
    for pdf in batches:
        size = pd.Series([len(p) if p is not None else -1 for p in pdf["pixels"]], index=pdf.index)
        w, h = pdf["width"].fillna(0).astype("int64"), pdf["height"].fillna(0).astype("int64")
        whole = (w > 0) & (h > 0) & (size == 3 * w * h)
        if (~whole).any():
            yield pdf[~whole], None, 0, 0
        for (width, height), own in pdf[whole].groupby([w[whole], h[whole]]):
            step = max(1, min(BATCH_PICTURES, BATCH_PIXELS // (width * height)))
            for k in range(0, len(own), step):
                part = own.iloc[k : k + step]
                yield part, np.clip(np.stack([np.asarray(p) for p in part["pixels"]]), 0, 255).reshape(len(part), -1, 3), width, height


def blur_scores(pictures: DataFrame) -> DataFrame:
    """Id, blur of every picture."""
    kind = dict(pictures.dtypes)["id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, rgb, width, height in _stacks(batches):
            yield pd.DataFrame({"id": part["id"], "blur": 0.0 if rgb is None else laplacian_variance(grey(rgb).reshape(-1, height, width))})

    return pictures.select("id", "width", "height", "pixels").mapInPandas(run, f"id {kind}, blur double")


def histograms(pictures: DataFrame) -> DataFrame:
    """Id, red, green, blue, luminance (256 counts each), shadow, highlight of every picture.

    shadow and highlight are percentages of the pixels: the least of the three colours' counts at 0 and at 255.
    """
    kind = dict(pictures.dtypes)["id"]
    names = ["red", "green", "blue", "luminance"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, rgb, _, _ in _stacks(batches):
            counts = np.zeros((len(part), 4, 256), np.int64) if rgb is None else channel_counts(rgb)
            least = counts[:, :3].min(1) * 100 / max(1, 0 if rgb is None else rgb.shape[1])
            yield pd.DataFrame({"id": part["id"].to_numpy(), **{c: list(counts[:, k]) for k, c in enumerate(names)}, "shadow": least[:, 0], "highlight": least[:, 255]})

    return pictures.select("id", "width", "height", "pixels").mapInPandas(run, f"id {kind}, red array<long>, green array<long>, blue array<long>, luminance array<long>, shadow double, highlight double")


def whole_counts(measured: DataFrame) -> DataFrame:
    """channel, bucket, n over all measured pictures; summed in each task before the shuffle."""
    each = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("counts")) for c in ("red", "green", "blue", "luminance")])
    spread = measured.select(F.explode(each).alias("c")).select("c.channel", F.posexplode("c.counts").alias("bucket", "k")).filter("k > 0")
    return spread.groupBy("channel", "bucket").agg(F.sum("k").alias("n"))
