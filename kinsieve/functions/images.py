"""Perceptual hashes and colour histograms of raw frames, and the tensor codec: numpy inside Arrow-batched functions."""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def gray(frame: np.ndarray) -> np.ndarray:
    """0.299 R + 0.587 G + 0.114 B, cut to a byte."""
    return np.clip(frame.astype(np.float64) @ np.array([0.299, 0.587, 0.114]), 0, 255).astype(np.uint8)


@lru_cache
def _dct(n: int) -> np.ndarray:
    k, i = np.arange(n)[:, None], np.arange(n)[None]
    return np.cos(np.pi * k * (2 * i + 1) / (2 * n))


def _averaged(g: np.ndarray, n: int) -> np.ndarray:
    """n rows: means of stretches of rows whose lengths differ by one at most, or rows again where there are fewer."""
    have = len(g)
    if have < n:
        return g[np.arange(n) * have // n]
    lengths = np.full(n, have // n) + (np.arange(n) < have % n)
    return np.add.reduceat(g, np.cumsum(lengths) - lengths, axis=0) / lengths[:, None]


def phash(frame: np.ndarray, size: int = 12) -> str:
    """Hex text of the low-frequency block of the DCT against its median; the frame is averaged to 4 * size squared first."""
    side = 4 * size
    small = _averaged(_averaged(gray(frame).astype(np.float64), side).T, side).T
    low = (_dct(side) @ small @ _dct(side).T)[:size, :size]
    bits = (low > np.median(low)).ravel()
    nibbles = np.r_[np.zeros(-len(bits) % 4, bool), bits].reshape(-1, 4) @ np.array([8, 4, 2, 1])
    return "".join(f"{n:x}" for n in nibbles)


def hsv_histogram(frame: np.ndarray, bins_h: int = 16, bins_s: int = 4) -> np.ndarray:
    """Shares of hue and saturation bins; the last bin is closed."""
    x = frame.reshape(-1, 3).astype(np.float64)
    top, low = x.max(1), x.min(1)
    span = np.where(top > low, top - low, 1)
    r, g, b = x.T
    hue = np.where(top == low, 0, np.where(top == r, (g - b) / span % 6, np.where(top == g, (b - r) / span + 2, (r - g) / span + 4))) / 6 * 255
    saturation = np.where(top > 0, (top - low) / np.where(top > 0, top, 1), 0) * 255
    h, s = (np.minimum((v * n / 256).astype(int), n - 1) for v, n in ((hue, bins_h), (saturation, bins_s)))
    return np.bincount(h * bins_s + s, minlength=bins_h * bins_s) / len(x)


@F.pandas_udf(T.StructType([T.StructField("phash_parts", T.ArrayType(T.StringType())), T.StructField("color_histogram", T.ArrayType(T.DoubleType()))]))
def visual_features(frames: pd.Series, heights: pd.Series, widths: pd.Series) -> pd.DataFrame:
    """Hashes and mean histogram of a file's frames (array of binary, 3 bytes a pixel); bad frames are skipped."""
    hashes, histograms = [], []
    for own, h, w in zip(frames, heights, widths, strict=True):
        good = [np.frombuffer(f, np.uint8).reshape(int(h), int(w), 3) for f in (own if own is not None else []) if f is not None and h and w and len(f) == h * w * 3]
        hashes.append([phash(f) for f in good])
        total = np.mean([hsv_histogram(f) for f in good], axis=0) if good else None
        histograms.append(None if total is None else (total / total.sum()).tolist())
    return pd.DataFrame({"phash_parts": hashes, "color_histogram": histograms})


def decoded(blob: bytes | None, dims: int) -> list | None:
    """A tensor of float16 behind a header of its sizes (uint32 each); None if the length does not fit."""
    if blob is None or len(blob) < 4 * dims:
        return None
    shape = struct.unpack(f"<{dims}I", blob[: 4 * dims])
    if 0 in shape or len(blob) != 4 * dims + 2 * int(np.prod(shape, dtype=np.int64)):
        return None
    return np.frombuffer(blob, "<f2", offset=4 * dims).reshape(shape).astype(np.float32).tolist()


def encoded(tensor: list) -> bytes:
    x = np.asarray(tensor, "<f2")
    return struct.pack(f"<{x.ndim}I", *x.shape) + x.tobytes()


@F.pandas_udf(T.ArrayType(T.ArrayType(T.FloatType())))
def decode_frames(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: decoded(b, 2))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.ArrayType(T.FloatType()))))
def decode_patches(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: decoded(b, 3))
