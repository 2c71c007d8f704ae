"""Loudness, resampling, echo, edit counts and the calendar."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions import vectors as V
from parlance.operators import metrics
from parlance.sources import calendar
from parlance.sources.versions import scratch
from parlance.streaming import machines, sound

RNG = np.random.default_rng(4)


def heard(machine, parts):
    rows = [r for p in parts for r in machine.on({"at_ms": 0, "samples": p})] + machine.end()
    return np.concatenate([np.asarray(r[1]) for r in rows] or [np.zeros(0)])


def split(x, n=17):
    return np.split(x, np.sort(RNG.integers(0, len(x), n)))


@pytest.mark.parametrize("make", [lambda: sound.Resampled(48_000, 16_000), lambda: sound.Resampled(8_000, 11_025), lambda: sound.Loudness(4_000)])
def test_any_split_gives_the_same_samples(make):
    x = RNG.standard_normal(20_000) * 0.05
    assert np.array_equal(heard(make(), [x]), heard(make(), split(x)))


def test_resampling_keeps_a_tone():
    tone = lambda rate: np.sin(np.arange(rate) * 2 * np.pi * 440 / rate)
    out = heard(sound.Resampled(48_000, 16_000), [tone(48_000)])
    assert len(out) == 16_000 and np.abs(out - tone(16_000))[200:-200].max() < 1e-3
    high = heard(sound.Resampled(48_000, 16_000), [np.sin(np.arange(48_000) * 2 * np.pi * 12_000 / 48_000)])
    assert np.abs(high[200:-200]).max() < 0.01  # what the new rate can't hold is gone


def test_loudness():
    meter = sound.Loudness(48_000)
    meter.on({"at_ms": 0, "samples": np.sin(np.arange(48_000) * 2 * np.pi * 997 / 48_000)})
    assert meter.integrated() == pytest.approx(-3.01, abs=0.01)  # the standard's own example
    quiet, room = RNG.standard_normal(4_000 * 30) * 0.02, RNG.standard_normal(4_000 * 30) * 0.001
    lifted = sound.Loudness(4_000)
    out = heard(lifted, [quiet])
    assert 1.3 < lifted.gain <= sound.MOST_GAIN and np.allclose(out[: 4_000 * 3], quiet[: 4_000 * 3], atol=1e-7) and np.abs(out).max() <= sound.CEILING
    level = sound.Loudness(4_000)
    level.on({"at_ms": 0, "samples": out[-4_000 * 10 :]})
    assert level.integrated() == pytest.approx(sound.TARGET_LUFS, abs=1)
    still = sound.Loudness(4_000)
    heard(still, [room])
    assert still.gain == 1.0


def echoes(seconds, rate=4_000):
    far = RNG.standard_normal(rate * seconds) * 0.3
    return far, np.convolve(far, np.r_[np.zeros(12), 0.5, 0.2, -0.1])[: len(far)]


def cancelled(near, far, n, rate=4_000):
    f, out = sound.EchoFilter(rate), []
    for i in range(0, len(near), n):
        out += f.on({"at_ms": i * 1000 // rate, "near": near[i : i + n], "far": far[i : i + n]})
    return np.concatenate([r[1] for r in out + f.end()]), f


def test_echo_goes():
    far, near = echoes(3)
    out, _ = cancelled(near, far, 333)
    assert len(out) == len(near) and 10 * np.log10((near[4_000:] ** 2).mean() / (out[4_000:] ** 2).mean()) > 30
    assert np.array_equal(out, cancelled(near, far, 4_001)[0])  # whatever the arrays
    speech = RNG.standard_normal(len(near)) * 0.2
    assert np.allclose(cancelled(speech, np.zeros(len(near)), 500)[0], speech.astype(np.float32))  # nothing to learn from


def test_never_louder():
    far, near = echoes(4)
    near[8_000:] = np.convolve(far, np.r_[np.zeros(30), -0.6])[: len(far)][8_000:]  # the room changes
    near[12_000:] += RNG.standard_normal(4_000) * 0.4  # and somebody talks
    out, f = cancelled(near, far, 400)
    for i in range(0, len(near) - 39, 40):
        assert (out[i : i + 40].astype(float) ** 2).sum() <= (near[i : i + 40] ** 2).sum() * (1 + 1e-6)
    f.weights[:] = 3.0  # a filter that only harms is given up, and then rests
    for i in range(0, 800, 40):
        f.on({"at_ms": 0, "near": RNG.standard_normal(40) * 0.5, "far": far[i : i + 40] * 0.1})
    assert f.resets == 1 and not f.weights.any() and f.paused > 0


def test_resampled_column(spark):
    rows = [([0.0, 1.0, 2.0, 3.0],), ([5.0],), ([],), (None,)]
    found = [r["y"] for r in spark.createDataFrame(rows, "x array<double>").select(V.resampled_column(F.col("x"), 2, 4).alias("y")).collect()]
    assert found == [[0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.0], [5.0, 5.0], [], None]
    x = RNG.standard_normal(50)
    assert np.allclose(spark.createDataFrame([(x.tolist(),)], "x array<double>").select(V.resampled_column(F.col("x"), 48, 16).alias("y")).first()["y"], V.resampled(x, 48, 16))


def slow_edits(a, b):
    """By cost, then substitution before deletion before insertion, cell by cell."""
    table = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                table[i, j] = (i + j, 0, i, j)
            elif a[i - 1] == b[j - 1]:
                table[i, j] = table[i - 1, j - 1]
            else:
                steps = [(table[i - 1, j - 1], (1, 0, 0)), (table[i - 1, j], (0, 1, 0)), (table[i, j - 1], (0, 0, 1))]
                c, add = min(steps, key=lambda s: s[0][0])
                table[i, j] = (c[0] + 1, *(x + y for x, y in zip(c[1:], add, strict=True)))
    return table[len(a), len(b)][1:]


def test_edits():
    rng = random.Random(7)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 10))] for _ in range(2))
        assert metrics.edits(a, b) == slow_edits(a, b)


def test_readings():
    m = machines.CalendarReadings()
    entry = lambda i, start, end, **x: {"id": i, "title": "T", "attendees": [], "starts_ms": start, "ends_ms": end, "all_day": False, "declined": False} | x
    at = lambda now, *entries: [r[:3] for r in m.on({"at_ms": now, "readings": list(entries) if entries != (None,) else None})]
    assert at(0, entry("later", 10, 20), entry("holiday", 0, 99, all_day=True), entry("no", 0, 99, declined=True), entry("over", -9, 0)) == []
    assert at(10, entry("later", 10, 20)) == [(10, "CalendarEventStarted", "later")] and at(11, entry("later", 10, 30)) == []
    assert at(25, None) == [] and at(30, None) == [(30, "CalendarEventEnded", "later")]  # unreadable: its last known end decides
    assert at(31, entry("a", 30, 90)) == [(31, "CalendarEventStarted", "a")] and at(32, entry("a", 30, 90, declined=True)) == [(32, "CalendarEventEnded", "a")]
    assert at(33, entry("b", 30, 90, title=" ")) == [(33, "CalendarEventStarted", "b")] and at(34) == [(34, "CalendarEventEnded", "b")]  # gone from the calendar


def test_calendar_goes_on_after_a_restart(spark):
    entries = spark.createDataFrame([(1, "a", "A", ["x"], 100, 2_500, False, False), (1, "b", "B", [], 2_900, 9_000, False, False), (2, "c", None, None, 0, 50, False, False)], "calendar long, id string, title string, attendees array<string>, starts_ms long, ends_ms long, all_day boolean, declined boolean")
    out, offsets, counts = scratch(spark, "out"), scratch(spark, "offsets"), []
    for until in (1_000, 1_500, 3_500):
        found = calendar.changes(calendar.polls(spark, poll_ms=500, until_ms=until), entries)
        found.writeStream.option("checkpointLocation", offsets).trigger(availableNow=True).start(out, format="parquet").awaitTermination()
        counts.append(spark.read.schema(found.schema).parquet(out).count())
    rows = sorted(tuple(r)[:4] for r in spark.read.schema(found.schema).parquet(out).collect())
    assert rows == [(1, 500, "CalendarEventStarted", "a"), (1, 2_500, "CalendarEventEnded", "a"), (1, 3_000, "CalendarEventStarted", "b"), (2, 0, "CalendarEventStarted", "c"), (2, 500, "CalendarEventEnded", "c")]
    assert counts == [3, 3, 5]
