"""Frames to vectors by a named model: a registry of providers, each loaded once in a worker, pooled and normalised here."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .images import decoded


class Provider(Protocol):
    """A loaded model. tokens: frames (n, size, size, 3) of bytes to (n, side * side, width) numbers, one row for each patch."""

    def tokens(self, frames: np.ndarray) -> np.ndarray: ...


@dataclass(frozen=True)
class Model:
    """How a model is loaded, and what it takes: square frames of `size` pixels in patches of `patch`."""

    load: Callable[[], Provider]
    size: int
    patch: int

    @property
    def side(self) -> int:
        return self.size // self.patch


MODELS: dict[str, Model] = {}


def register(name: str, load: Callable[[], Provider], size: int, patch: int) -> None:
    """Makes a model known by name; load runs on workers."""
    MODELS[name] = Model(load, size, patch)


def model(name: str) -> Model:
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; known are {', '.join(sorted(MODELS))}")
    return MODELS[name]


class Colours:
    """A provider without weights: means and deviations of each colour, and slopes of brightness, in a patch."""

    def __init__(self, size: int = 64, patch: int = 8):
        self.side, self.patch = size // patch, patch

    def tokens(self, frames: np.ndarray) -> np.ndarray:
        n, p = len(frames), self.patch
        cells = frames.reshape(n, self.side, p, self.side, p, 3).transpose(0, 1, 3, 2, 4, 5).astype(np.float64) / 255
        mean, deviation = cells.mean((3, 4)), cells.std((3, 4))
        light = cells.mean(5)
        slope = np.stack([np.diff(light, axis=a).mean((3, 4)) for a in (3, 4)], -1)
        return np.concatenate([mean, deviation, slope], -1).reshape(n, self.side**2, -1)


register("colours", Colours, 64, 8)


def pooled(tokens: np.ndarray, side: int, grid: int) -> np.ndarray:
    """(n, grid * grid, width): means over windows of the side x side patches, which overlap where side isn't a multiple of grid."""
    if not 1 <= grid <= side:
        grid = side
    x = tokens.reshape(len(tokens), side, side, -1)
    edges = [(i * side // grid, -(-(i + 1) * side // grid)) for i in range(grid)]
    x = np.stack([x[:, a:b].mean(1) for a, b in edges], 1)
    x = np.stack([x[:, :, a:b].mean(2) for a, b in edges], 2)
    return x.reshape(len(tokens), grid * grid, -1)


def normalised(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1; those without length stay zero."""
    length = np.sqrt((x * x).sum(-1, keepdims=True))
    return x / np.where(length > 0, length, 1)


FEATURES = T.StructType([T.StructField("frames", T.ArrayType(T.ArrayType(T.FloatType()))), T.StructField("patches", T.ArrayType(T.ArrayType(T.ArrayType(T.FloatType()))))])


def embedded(frames: Column | str, name: str, grid: int = 8, at_once: int = 32) -> Column:
    """(frames, patches) of arrays of RGB frames (bytes) of the model's size: a vector for each frame, and grid x grid for its patches.

    Frames of another size are skipped; without a frame both are null, which only makes later gates abstain.
    """
    own = model(name)

    @F.pandas_udf(FEATURES)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        provider = own.load()  # once for a task's batches
        for batch in batches:
            rows = []
            for given in batch:
                good = [np.frombuffer(f, np.uint8).reshape(own.size, own.size, 3) for f in (given if given is not None else []) if f is not None and len(f) == own.size**2 * 3]
                if not good:
                    rows.append((None, None))
                    continue
                tokens = np.concatenate([provider.tokens(np.stack(good[i : i + at_once])) for i in range(0, len(good), at_once)])
                if tokens.shape[1] != own.side**2:
                    rows.append((None, None))
                    continue
                rows.append((normalised(tokens.mean(1)).tolist(), normalised(pooled(tokens, own.side, grid)).tolist()))
            yield pd.DataFrame(rows, columns=["frames", "patches"])

    return run(frames)


@F.pandas_udf(FEATURES)
def stored(frames: pd.Series, patches: pd.Series) -> pd.DataFrame:
    """The same features from what was stored of them (tensors of float16); null where a tensor doesn't fit its header."""
    return pd.DataFrame({"frames": frames.map(lambda b: decoded(b, 2)), "patches": patches.map(lambda b: decoded(b, 3))})
