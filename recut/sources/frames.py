"""Image files as frame features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the frame descriptor.
GRAY_SIDE = 32
TOP_SHARE = 0.82
HIST_BINS = (8, 4, 4)
LETTERBOX = 96
# Images whose features are held at once.
FRAMES_AT_ONCE = 100


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images under a path: origin, height, width, nChannels, data (BGR rows)."""
    return spark.read.format("image").option("recursiveFileLookup", True).load(path).select("image.*")


def _resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area average onto a smaller or larger grid."""
    rows = np.linspace(0, image.shape[0], height + 1)
    cols = np.linspace(0, image.shape[1], width + 1)
    r0, c0 = rows[:-1].astype(int), cols[:-1].astype(int)
    r1, c1 = np.maximum(r0 + 1, np.ceil(rows[1:]).astype(int)), np.maximum(c0 + 1, np.ceil(cols[1:]).astype(int))
    total = np.zeros((image.shape[0] + 1, image.shape[1] + 1, *image.shape[2:]))
    total[1:, 1:] = image.cumsum(0).cumsum(1)
    area = ((r1 - r0)[:, None] * (c1 - c0)[None, :]).reshape(height, width, *([1] * (image.ndim - 2)))
    pick = lambda r, c: total[r][:, c]
    return (pick(r1, c1) - pick(r0, c1) - pick(r1, c0) + pick(r0, c0)) / area


def _gray(bgr: np.ndarray) -> np.ndarray:
    return bgr @ np.array([0.114, 0.587, 0.299])


def _hsv(bgr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    blue, green, red = (bgr[..., i] / 255.0 for i in range(3))
    top, low = np.maximum(np.maximum(red, green), blue), np.minimum(np.minimum(red, green), blue)
    span = np.where(top > low, top - low, 1.0)
    hue = np.where(top == red, (green - blue) / span, np.where(top == green, 2 + (blue - red) / span, 4 + (red - green) / span))
    hue = np.where(top > low, (hue / 6.0) % 1.0, 0.0)
    return hue, np.where(top > 0, (top - low) / np.where(top > 0, top, 1.0), 0.0), top


def _z(values: np.ndarray) -> np.ndarray:
    flat = values.ravel()
    return (flat - flat.mean()) / max(flat.std(), 1e-6)


def crop_black(bgr: np.ndarray, threshold: float = 16.0) -> np.ndarray:
    """Cut rows and columns that are black along their whole length at the border."""
    bright = _gray(bgr) > threshold
    rows, cols = np.nonzero(bright.any(1))[0], np.nonzero(bright.any(0))[0]
    if not len(rows) or not len(cols):
        return bgr
    return bgr[rows[0] : rows[-1] + 1, cols[0] : cols[-1] + 1]


def letterbox(bgr: np.ndarray, side: int = LETTERBOX) -> np.ndarray:
    scale = side / max(bgr.shape[:2])
    height, width = max(1, round(bgr.shape[0] * scale)), max(1, round(bgr.shape[1] * scale))
    out = np.zeros((side, side, 3))
    top, left = (side - height) // 2, (side - width) // 2
    out[top : top + height, left : left + width] = _resize(bgr, height, width)
    return out


def describe(bgr: np.ndarray) -> np.ndarray:
    """Unit vector of the gray top part, its centre, and a colour histogram."""
    square = letterbox(bgr)
    top = square[: int(square.shape[0] * TOP_SHARE)]
    h, w = top.shape[:2]
    centre = top[h // 4 : h - h // 4, w // 4 : w - w // 4]
    hist, _ = np.histogramdd(np.stack([c.ravel() for c in _hsv(top)], 1), bins=HIST_BINS, range=[(0, 1)] * 3)
    hist = hist.ravel() / max(hist.sum(), 1.0)
    vec = np.concatenate([_z(_resize(_gray(top), GRAY_SIDE, GRAY_SIDE)), _z(_resize(_gray(centre), GRAY_SIDE, GRAY_SIDE)), hist])
    norm = np.linalg.norm(vec)
    return vec / norm if norm >= 1e-8 else vec


def dhash(bgr: np.ndarray) -> int:
    """Signs of horizontal gradients on a 9 by 8 grid as a signed 64-bit number."""
    small = _resize(_gray(bgr), 8, 9)
    bits = np.packbits((small[:, 1:] > small[:, :-1]).ravel())
    return int(bits.view(">i8")[0])


def features_of(batches: Iterator[pd.DataFrame], crop: bool) -> Iterator[pd.DataFrame]:
    """Features go on in small parts: those of a whole batch can take far more memory than its images."""
    for batch in batches:
        for at in range(0, len(batch), FRAMES_AT_ONCE):
            rows = []
            for r in batch.iloc[at : at + FRAMES_AT_ONCE].itertuples(index=False):
                pixels = np.frombuffer(bytes(r.data), np.uint8).reshape(r.height, r.width, r.nChannels).astype(np.float64)
                bgr = np.repeat(pixels, 3, axis=2) if r.nChannels == 1 else pixels[..., :3]
                bgr = crop_black(bgr) if crop else bgr
                hist, _ = np.histogramdd(np.stack([c.ravel() for c in _hsv(bgr)], 1), bins=HIST_BINS, range=[(0, 1)] * 3)
                rows.append((r.origin, describe(bgr).astype(np.float32), dhash(bgr), hist.ravel().astype(np.float32)))
            yield pd.DataFrame(rows, columns=["origin", "descriptor", "dhash", "hist"])


def frame_features(images: DataFrame, *, crop: bool = True) -> DataFrame:
    """Descriptor, gradient hash and colour histogram of decoded images, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return features_of(batches, crop)

    return images.mapInPandas(run, "origin string, descriptor array<float>, dhash bigint, hist array<float>")
