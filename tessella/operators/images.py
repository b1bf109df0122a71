"""Jobs over rows of ``spark.read.format("image")``, with NumPy inside Arrow batches.

Image data is BGR, row by row; grey images count as three equal channels.
Statistics of an image with little tissue are null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Least saturation of tissue, least share of tissue for statistics, least grey (0 to 1) of glass.
SATURATION, LEAST_TISSUE, GLASS = 15, 0.05, 0.8


def rgb_of(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    a = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, 2::-1]


def _blurred(a: np.ndarray) -> np.ndarray:
    """Five taps (1, 4, 6, 4, 1)/16 along both axes, mirrored without the edge."""
    kernel = np.array([1, 4, 6, 4, 1]) / 16
    for axis in (0, 1):
        pad = [(2, 2) if k == axis else (0, 0) for k in range(a.ndim)]
        wide = np.pad(a, pad, mode="reflect" if a.shape[axis] > 2 else "edge")
        a = sum(w * np.take(wide, range(i, i + a.shape[axis]), axis=axis) for i, w in enumerate(kernel))
    return a


def tissue_mask(rgb: np.ndarray, method: str = "saturation", least: int = SATURATION, bright: float = 220, pale: int = 10) -> np.ndarray:
    """Blurred pixels of enough saturation; by "brightness", all but the pixels that are both bright and pale."""
    smooth = np.rint(_blurred(rgb.astype(float)))
    top, low = smooth.max(axis=2), smooth.min(axis=2)
    saturation = np.rint(255 * (top - low) / np.maximum(top, 1))
    if method == "brightness":
        return (smooth.mean(axis=2) < bright) | (saturation >= pale)
    return saturation >= least


def _eroded(mask: np.ndarray, times: int) -> np.ndarray:
    for _ in range(times):
        m = np.pad(mask, 1)
        mask = m[1:-1, 1:-1] & m[:-2, 1:-1] & m[2:, 1:-1] & m[1:-1, :-2] & m[1:-1, 2:]
    return mask


def tile_stats(rgb: np.ndarray) -> tuple:
    """Tissue share, brightness, saturation, red, blue and sharpness over tissue; all but the share null with little tissue.

    Tissue is stained, unlike grey glass, and darker than glass; nothing is
    blurred.  Sharpness is the variance of the second differences of grey (0 to
    1) away from the tissue's edges, null where there is no such place.
    """
    x = rgb.astype(float) / 255
    top, low = x.max(axis=2), x.min(axis=2)
    grey = x @ np.array([0.299, 0.587, 0.114])
    stain = (top - low) / np.maximum(top, 1e-6)
    mask = (stain >= (SATURATION - 0.5) / 255) & (grey < GLASS)  # saturation is rounded where 15 of 255 is asked
    share = float(mask.mean())
    if share < LEAST_TISSUE:
        return (share, *[None] * 5)
    g = np.pad(grey, 1, mode="symmetric")
    second = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * grey
    inner = _eroded(mask, 2)
    over = lambda a: float(a[mask].mean())
    return share, over(grey), over(stain), over(x[:, :, 0]), over(x[:, :, 2]), float(second[inner].var()) if inner.any() else None


def image_stats(images: DataFrame) -> DataFrame:
    """Rows of the image source to one row of statistics for each path."""

    def run(parts):
        for p in parts:
            rows = [tile_stats(rgb_of(*x)) for x in zip(p["height"], p["width"], p["n_channels"], p["data"])]
            names = ["tissue_fraction", "brightness", "saturation", "red", "blue", "sharpness"]
            yield pd.concat([p[["path"]].reset_index(drop=True), pd.DataFrame(rows, columns=names, dtype="float64")], axis=1)

    flat = images.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("n_channels"), F.col("image.data").alias("data"))
    kinds = ", ".join(f"{n} double" for n in ["tissue_fraction", "brightness", "saturation", "red", "blue", "sharpness"])
    out = flat.mapInPandas(run, f"path string, {kinds}")
    return out.select("path", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in out.columns[1:]])


def crop_tiles(images: DataFrame, tiles: DataFrame) -> DataFrame:
    """Pixels of each tile (path, tile_id, x0, y0, tile_size) as RGB bytes, zero beyond the image."""
    flat = images.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("n_channels"), F.col("image.data").alias("data"))

    @F.pandas_udf("binary")
    def cut(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series, x0: pd.Series, y0: pd.Series, size: pd.Series) -> pd.Series:
        out = []
        for h, w, c, d, x, y, n in zip(height, width, channels, data, x0, y0, size):
            tile = np.zeros((n, n, 3), dtype=np.uint8)
            part = rgb_of(h, w, c, d)[y : y + n, x : x + n]
            tile[: part.shape[0], : part.shape[1]] = part
            out.append(tile.tobytes())
        return pd.Series(out)

    return tiles.join(flat, "path").select(*tiles.columns, cut("height", "width", "n_channels", "data", "x0", "y0", "tile_size").alias("pixels"))


@F.pandas_udf(T.DoubleType())
def _share(pixels: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series([float(tissue_mask(np.frombuffer(p, dtype=np.uint8).reshape(n, n, 3)).mean()) for p, n in zip(pixels, size)], dtype="float64")


def tissue_share(pixels: str, size: str) -> Column:
    """The share of tissue in the RGB bytes of a square tile."""
    return _share(pixels, size)
