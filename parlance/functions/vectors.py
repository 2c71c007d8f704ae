"""Column functions on vectors and numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

#: Fixed value: squares of norms up to this count as silence.
SILENT = float(np.finfo(np.float32).eps)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """M5: 0 for different widths and for silence."""
    na, nb = dot(a, a), dot(b, b)
    return F.when((F.size(a) == F.size(b)) & (na > SILENT) & (nb > SILENT), dot(a, b) / (F.sqrt(na) * F.sqrt(nb))).otherwise(F.lit(0.0))


def normalised(a: Column) -> Column:
    """M6: unit length; silence stays as it is."""
    norm = F.sqrt(dot(a, a))
    return F.when(norm > SILENT, F.transform(a, lambda x: x / norm)).otherwise(a)


def weighted_mean(items: Column) -> Column:
    """Mean of an array of (weight, vector), normalised; vectors of another width than the first are left out."""
    width = F.size(items[0]["vector"])
    kept = F.filter(items, lambda i: F.size(i["vector"]) == width)
    zero = F.transform(items[0]["vector"], lambda x: F.lit(0.0))
    total = F.aggregate(kept, F.lit(0.0), lambda acc, i: acc + i["weight"])
    added = F.aggregate(kept, zero, lambda acc, i: F.zip_with(acc, i["vector"], lambda x, y: x + y * i["weight"]))
    return normalised(F.transform(added, lambda x: x / total))


def shared_ms(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """M8: what two intervals have in common."""
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def enrolment_window(channel: Column, start_ms: Column, end_ms: Column) -> Column:
    """(start_ms, end_ms) of the first 10 seconds of a microphone turn of at least 1.5; null otherwise."""
    return F.when((channel == "mic") & (end_ms - start_ms >= 1500), F.struct(start_ms.alias("start_ms"), F.least(end_ms, start_ms + 10_000).alias("end_ms")))


def embeddable_window(start_ms: Column, end_ms: Column, least: int = 1_500, most: int = 10_000) -> Column:
    """M9: (start_ms, end_ms) of what can be embedded of a turn: null under `least`, its middle if it is longer than `most`."""
    length = end_ms - start_ms
    middle = start_ms + F.floor(length / 2).cast("long")
    whole = F.struct(start_ms.alias("start_ms"), end_ms.alias("end_ms"))
    return F.when(length >= least, F.when(length <= most, whole).otherwise(F.struct((middle - most // 2).alias("start_ms"), (middle + most // 2).alias("end_ms"))))


def silence_threshold(elapsed_ms: Column, high: float = 0.80, low: float = 0.35, from_ms: int = 3_000, to_ms: int = 20_000) -> Column:
    """The speech probability below which a frame is silence: falls from high to low while a chunk grows."""
    part = F.least(F.greatest((elapsed_ms - from_ms) / float(to_ms - from_ms), F.lit(0.0)), F.lit(1.0))
    return high - part * (high - low)


@pandas_udf(ArrayType(FloatType()))
def from_bytes(blobs: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Little-endian single-precision numbers as an array; null if they don't divide evenly."""
    for b in blobs:
        yield b.map(lambda x: None if x is None or len(x) % 4 else np.frombuffer(x, "<f4"))


@pandas_udf(StructType([StructField(c, DoubleType()) for c in ("rms", "peak", "crossings", "centroid_hz")]))
def sound(samples: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Root mean square, peak, share of sign changes and spectral centroid (of the rate 16 kHz) of samples."""
    for batch in samples:
        rows = []
        for s in batch:
            x = np.asarray([] if s is None else s, float)
            if not len(x):
                rows.append((0.0, 0.0, 0.0, 0.0))
                continue
            power = np.abs(np.fft.rfft(x * np.hanning(len(x)))) ** 2
            rows.append((float(np.sqrt((x * x).mean())), float(np.abs(x).max()), float((np.signbit(x[1:]) != np.signbit(x[:-1])).mean()) if len(x) > 1 else 0.0, float((power * np.fft.rfftfreq(len(x), 1 / 16_000)).sum() / power.sum()) if power.sum() else 0.0))
        yield pd.DataFrame(rows, columns=["rms", "peak", "crossings", "centroid_hz"])


def resampled(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation to another rate."""
    n = len(samples) * to // rate
    return np.interp(np.arange(n) * rate / to, np.arange(len(samples)), samples) if n else np.zeros(0)


def resampled_column(samples: Column, rate: int, to: int) -> Column:
    """An array at another rate, by linear interpolation; the last sample stands for what would lie behind it."""
    n = F.floor(F.size(samples) * to / rate).cast("int")
    at = lambda i: i * float(rate) / float(to)
    low = lambda i: F.floor(at(i)).cast("int")
    value = lambda i: F.get(samples, F.least(i, F.size(samples) - 1)).cast("double")
    between = lambda i: value(low(i)) + (at(i) - low(i)) * (value(low(i) + 1) - value(low(i)))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), between)).when(samples.isNotNull(), F.array().cast("array<double>"))


def echo_loss_db(before: Column, after: Column) -> Column:
    """Decibels of mean power that cancellation took away."""
    return 10 * F.log10(F.avg(before * before) / F.greatest(F.avg(after * after), F.lit(1e-12)))
