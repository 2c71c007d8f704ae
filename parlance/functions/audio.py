"""Features of sampled sound: array work in NumPy, one row of samples at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

#: Fixed values of the filterbank: rate, frame, shift, transform, bins, band, pre-emphasis and scale of samples.
RATE, FRAME, SHIFT, POINTS, BINS, LOW_HZ, HIGH_HZ, EMPHASIS, SCALE, LEAST_ENERGY = 16_000, 400, 160, 512, 80, 20.0, 8_000.0, 0.97, 32_768.0, 1e-10


def mel_weights() -> np.ndarray:
    """POINTS / 2 + 1 by BINS triangles, evenly spaced in mel."""
    mel = lambda hz: 1127.0 * np.log(1.0 + np.asarray(hz) / 700.0)
    edge = np.linspace(mel(LOW_HZ), mel(HIGH_HZ), BINS + 2)
    at = mel(np.arange(POINTS // 2 + 1) * RATE / POINTS)[:, None]
    return np.clip(np.minimum((at - edge[:-2]) / (edge[1:-1] - edge[:-2]), (edge[2:] - at) / (edge[2:] - edge[1:-1])), 0.0, None)


def filterbank(samples: np.ndarray, centred: bool = True) -> np.ndarray:
    """Log energies of each frame's mel bands; less each band's mean over the frames if centred. No frames of short sound."""
    if len(samples) < FRAME:
        return np.zeros((0, BINS))
    frames = np.lib.stride_tricks.sliding_window_view(np.asarray(samples, float), FRAME)[::SHIFT] * SCALE
    frames = frames - frames.mean(1, keepdims=True)
    before = np.concatenate([frames[:, :1], frames[:, :-1]], axis=1)
    power = np.abs(np.fft.rfft((frames - EMPHASIS * before) * np.hamming(FRAME), POINTS)) ** 2
    logs = np.log(np.maximum(power @ mel_weights(), LEAST_ENERGY))
    return logs - logs.mean(0) if centred else logs


@pandas_udf(ArrayType(ArrayType(DoubleType())))
def log_mel(samples: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """M16 as a column function on arrays of samples."""
    for batch in samples:
        yield batch.map(lambda s: filterbank(np.asarray([] if s is None else s, float)).tolist())
