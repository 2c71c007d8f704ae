"""From sound to text as it comes: one clock, echo, loudness, speech, decoding, for `transcripts.understood` to keep or drop."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from parlance.operators.transcripts import LEAST_CONFIDENCE
from parlance.streaming import machines, sound

DECODED = "meeting long, channel string, start_ms long, end_ms long, text string, confidence double, language string"


class SegmentStream:
    """Frames of both channels to decoded chunks. Events have channel, offset_ms and samples, or finished. Rows: channel, start_ms, end_ms, text, confidence, language.

    decode(samples, context) gives (text, confidence, language). The text before is the context of the next decode of its channel; a decode that hears another language than
    its context's is done again without. Memory is what is not yet decoded, one chunk a channel at most.
    """

    def __init__(self, decode: Callable[[np.ndarray, str | None], tuple], rate: int = 16_000, cancel: bool = True):
        self.decode, self.rate, self.frame = decode, rate, rate * machines.FRAME_MS // 1000
        self.joined = machines.JoinedSamples(rate)
        self.echo = sound.EchoFilter(rate) if cancel else None
        self.legs = {c: Leg(rate) for c in ("mic", "system")}

    def on(self, event: dict) -> list[tuple]:
        return self.through(self.joined.on(event))

    def through(self, blocks: list[tuple]) -> list[tuple]:
        out = []
        for start, mic, system in blocks:
            rows = [(start, mic)] if self.echo is None else self.echo.on({"at_ms": start, "near": mic, "far": system})
            for at, samples in rows:
                out += self.heard("mic", at, samples)
            out += self.heard("system", start, system)
        return sorted(out, key=lambda r: r[1])

    def heard(self, channel: str, at: int, samples: list) -> list[tuple]:
        return [self.decoded(channel, *chunk) for chunk in self.legs[channel].on(at, samples)]

    def decoded(self, channel: str, start: int, end: int, samples: np.ndarray) -> tuple:
        leg = self.legs[channel]
        text, confidence, language = self.decode(samples, leg.text)
        if leg.text is not None and language != leg.language:
            text, confidence, language = self.decode(samples, None)
        if text and confidence >= LEAST_CONFIDENCE:
            leg.text, leg.language = text, language
        return (channel, start, end, text, float(confidence), language)

    def end(self) -> list[tuple]:
        out = self.through(self.joined.end())
        for at, samples in self.echo.end() if self.echo is not None else []:
            out += self.heard("mic", at, samples)
        for channel, leg in self.legs.items():
            out += [self.decoded(channel, *chunk) for chunk in leg.end()]
        return sorted(out, key=lambda r: r[1])


class Leg:
    """One channel: loudness, frames, speech chunks with their samples."""

    def __init__(self, rate: int):
        self.rate, self.size = rate, rate * machines.FRAME_MS // 1000
        self.loudness, self.floor, self.chunks = sound.Loudness(rate), machines.NoiseFloor(), machines.SpeechChunks()
        self.held, self.first, self.framed = np.zeros(0, np.float32), 0, 0  # held begins with sample number `first`; frames up to `framed` were judged
        self.text: str | None = None
        self.language: str | None = None

    def on(self, at: int, samples: list) -> list[tuple]:
        level = np.asarray(self.loudness.on({"at_ms": at, "samples": samples})[0][1], np.float32)
        self.held = np.concatenate([self.held, level])
        out = []
        at = self.framed - self.first
        n = max((len(self.held) - at) // self.size, 0)
        frames = self.held[at : at + n * self.size].reshape(n, self.size).astype(float)
        crossings = np.count_nonzero((frames[:, 1:] < 0) != (frames[:, :-1] < 0), axis=1) / self.size
        for rms, crossing in zip(np.sqrt((frames * frames).mean(1)).tolist(), crossings.tolist(), strict=True):
            p = self.floor.on({"at_ms": self.framed * 1000 // self.rate, "rms": rms, "crossings": crossing})[0][1]
            out += self.cut(self.chunks.on({"p": p}))
            self.framed += self.size
        keep = (self.chunks.chunk["start"] if self.chunks.chunk else max(self.chunks.now - self.chunks.pad_ms, 0)) * self.rate // 1000
        drop = max(min(keep, self.framed) - self.first, 0)
        self.held, self.first = self.held[drop:], self.first + drop
        return out

    def cut(self, rows: list[tuple]) -> list[tuple]:
        n = lambda ms: ms * self.rate // 1000 - self.first
        return [(start, end, self.held[max(n(start), 0) : n(end)]) for start, end, _ in rows]

    def end(self) -> list[tuple]:
        return self.cut(self.chunks.end())
