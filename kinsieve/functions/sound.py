"""Acoustic fingerprints: 32-bit words of the chroma of sound, made to be compared place by place by fingerprint_distance()."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Samples a second, of a spectrum, and between two of them; spectra that a word looks at before and after its own.
RATE, WIDTH, HOP, REACH = 11025, 4096, 1365, 8
#: Frequencies that count, in Hz: a little over five octaves.
LOW, HIGH = 55.0, 2000.0


def _bins() -> np.ndarray:
    """(12, frequencies): the pitch class that each frequency of a spectrum counts for, split between the two nearest."""
    f = np.fft.rfftfreq(WIDTH, 1 / RATE)
    out = np.zeros((12, len(f)))
    used = np.flatnonzero((f >= LOW) & (f <= HIGH))
    pitch = 12 * np.log2(f[used] / 440.0)
    down = np.floor(pitch).astype(int)
    out[down % 12, used] += 1 - (pitch - down)
    out[(down + 1) % 12, used] += pitch - down
    return out


BINS = _bins()


def chroma(samples: np.ndarray) -> np.ndarray:
    """(spectra, 12): the energy of each pitch class in overlapping stretches, each spectrum of length 1."""
    n = 1 + (len(samples) - WIDTH) // HOP
    if n <= 0:
        return np.zeros((0, 12))
    stretches = np.lib.stride_tricks.sliding_window_view(samples, WIDTH)[::HOP][:n]
    out = np.concatenate([np.abs(np.fft.rfft(stretches[i : i + 256] * np.hanning(WIDTH))) ** 2 @ BINS.T for i in range(0, n, 256)])
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-9)


def words_of(samples: np.ndarray) -> np.ndarray:
    """A word for each spectrum, of 32 comparisons of the chroma around it: pitch classes among each other, and each before and after.

    Every comparison is of sums over REACH spectra, so a shift by a fraction of one changes few of them; loudness changes none.
    """
    c = chroma(np.asarray(samples, np.float64))
    n = len(c) - 2 * REACH
    if n <= 0:
        return np.zeros(0, np.int64)
    sums = np.concatenate([np.zeros((1, 12)), np.cumsum(c, 0)])
    before, after = sums[REACH : REACH + n] - sums[:n], sums[2 * REACH : 2 * REACH + n] - sums[REACH : REACH + n]
    whole = before + after
    bits = np.concatenate(
        [
            after > before,  # 12: each pitch class over time
            whole > np.roll(whole, 1, 1),  # 12: against the next one
            whole[:, :6] > whole[:, 6:],  # 6: against the opposite one
            (after[:, ::2] + before[:, 1::2]).sum(1, keepdims=True) > (before[:, ::2] + after[:, 1::2]).sum(1, keepdims=True),
            (after[:, :6] + before[:, 6:]).sum(1, keepdims=True) > (before[:, :6] + after[:, 6:]).sum(1, keepdims=True),
        ],
        axis=1,
    )
    return bits @ (1 << np.arange(32, dtype=np.int64))


@F.pandas_udf(T.ArrayType(T.LongType()))
def fingerprint_words(samples: pd.Series) -> pd.Series:
    """The words of mono sound at 11025 samples a second; null for null, empty if it is shorter than one word looks at."""
    return samples.map(lambda x: None if x is None else words_of(x))
