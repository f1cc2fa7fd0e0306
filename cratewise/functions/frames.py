"""Row-local spectrogram kernels: one Arrow batch of frames, one matrix product."""

from __future__ import annotations

from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf

if TYPE_CHECKING:
    from cratewise.plans.views import FrameGeometry


def bin_product(matrix: np.ndarray):
    """Column function: an array of bins times a (bins, out) matrix, per row."""
    @pandas_udf("array<double>")
    def product(mags: pd.Series) -> pd.Series:
        if len(mags) == 0:
            return pd.Series([], dtype=object)
        return pd.Series(list(np.stack(mags.to_numpy()) @ matrix))
    return product


def _half_up(x: np.ndarray) -> np.ndarray:
    return np.floor(x + 0.5).astype(int)


def pitch_class_matrix(geometry: "FrameGeometry", low_hz: float, high_hz: float,
                       harmonics: tuple[float, ...] = (1.0,), reference_hz: float = 440.0) -> np.ndarray:
    """(bins, 12): weight of each bin on each pitch class.

    Harmonic h of weight w also adds to the class of bin/(h+1), as long as that
    is not below the range. Bin 0 never counts.
    """
    out = np.zeros((geometry.bins, 12))
    for b in range(1, geometry.bins):
        hz = geometry.hz(b)
        if not low_hz <= hz <= high_hz:
            continue
        for h, weight in enumerate(harmonics):
            fundamental = hz / (h + 1)
            if h and fundamental < low_hz:
                break
            out[b, int(_half_up(69 + 12 * np.log2(fundamental / reference_hz))) % 12] += weight
    return out


def mel_matrix(geometry: "FrameGeometry", bands: int, low_hz: float = 30.0,
               high_hz: float = 11000.0) -> tuple[np.ndarray, np.ndarray]:
    """Triangular mel filters as a (bins, bands) matrix, and each band's lower edge in Hz."""
    def mel(hz):
        return 2595 * np.log10(1 + np.asarray(hz) / 700)
    top = min(high_hz, geometry.sample_rate / 2)
    points = mel(low_hz) + (mel(top) - mel(low_hz)) * np.arange(bands + 2) / (bands + 1)
    edges = 700 * (10 ** (points / 2595) - 1)
    at = edges * geometry.fft_size / geometry.sample_rate
    bins = np.arange(geometry.bins)[:, None]
    lo, mid, hi = at[None, :-2], at[None, 1:-1], at[None, 2:]
    with np.errstate(divide="ignore", invalid="ignore"):
        rise = np.where((bins >= lo) & (bins <= mid) & (mid > lo), (bins - lo) / (mid - lo), 0.0)
        fall = np.where((bins > mid) & (bins <= hi) & (hi > mid), (hi - bins) / (hi - mid), 0.0)
    return rise + fall, edges[:bands]
