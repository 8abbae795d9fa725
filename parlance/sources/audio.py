"""Audio files as samples: RIFF files read, channels averaged, resampled by a polyphase windowed sinc, in slices.

An output sample depends only on the input samples around its place, weighed by the filter of its phase, so
the slices of a file put together are the file resampled as a whole.

Defined results: integer samples of 8 to 32 bits and 32-bit floats come out between -1 and 1; files that are no
RIFF audio, or are cut short before their samples, give no rows; a data chunk that names more than is there
ends with the file.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE, HALF, BETA = 16_000, 24, 8.6
SAMPLES = "rate int, at long, samples array<float>"


def riff(data: bytes) -> tuple[int, np.ndarray] | None:
    """(samples a second, mono samples) of a RIFF file."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, shape = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            kind = struct.unpack_from("<H", body, 24)[0] if kind == 0xFFFE and len(body) >= 26 else kind
            shape = kind, channels, rate, bits
        elif name == b"data" and shape:
            kind, channels, rate, bits = shape
            width = bits // 8
            if not channels or not rate or width not in (1, 2, 3, 4) or kind not in (1, 3) or (kind == 3 and width != 4):
                return None
            body = body[: len(body) // (width * channels) * width * channels]
            if kind == 3:
                x = np.frombuffer(body, "<f4").astype(np.float64)
            elif width == 3:
                raw = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
                x = ((raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16) << 8 >> 8) / 2.0**23
            else:
                x = np.frombuffer(body, {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(np.float64)
                x = (x - 128) / 128 if width == 1 else x / 2.0 ** (bits - 1)
            return rate, x.reshape(-1, channels).mean(axis=1)
        at += 8 + size + size % 2
    return None


@lru_cache(maxsize=8)
def filters(up: int, down: int) -> np.ndarray:
    """Phases x taps: a Kaiser-windowed sinc that cuts off below the lower of both rates."""
    cut = min(1.0, up / down)
    half = math.ceil(HALF / cut)
    place = np.arange(-half + 1, half + 1)[None, :] - (np.arange(up) / up)[:, None]
    window = np.i0(BETA * np.sqrt(np.maximum(0, 1 - (place / half) ** 2))) / np.i0(BETA)
    taps = cut * np.sinc(cut * place) * window
    return taps / taps.sum(axis=1, keepdims=True)


def resampled(x: np.ndarray, rate: int, target: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """Output samples ``first`` to ``last`` of ``x`` at ``target`` samples a second."""
    whole = -(-len(x) * target // rate)
    last = whole if last is None else min(last, whole)
    if rate == target:
        return x[first:last]
    g = math.gcd(rate, target)
    up, down = target // g, rate // g
    taps = filters(up, down)
    half = taps.shape[1] // 2
    out = np.empty(max(0, last - first))
    for a in range(first, last, 1 << 15):
        n = np.arange(a, min(last, a + (1 << 15)), dtype=np.int64)
        centre, phase = n * down // up, n * down % up
        at = centre[:, None] + np.arange(-half + 1, half + 1)[None, :]
        inside = (at >= 0) & (at < len(x))
        out[a - first : a - first + len(n)] = (np.where(inside, x[np.clip(at, 0, max(0, len(x) - 1))], 0.0) * taps[phase]).sum(axis=1)
    return out


def slices_of(data: bytes, target: int, seconds: float) -> Iterator[tuple[int, np.ndarray]]:
    """(first output sample, samples) of a file's slices."""
    found = riff(data)
    if found is None:
        return
    rate, x = found
    step = max(1, int(seconds * target))
    for a in range(0, -(-len(x) * target // rate), step):
        yield a, resampled(x, rate, target, a, a + step)


def samples(files: DataFrame, content: str = "content", keys: tuple[str, ...] = ("path",), target: int = RATE, seconds: float = 30.0) -> DataFrame:
    """``keys``, rate, at (first sample), samples: the slices of every audio file (``binaryFile`` rows)."""
    kinds = dict(files.dtypes)

    def run(batches):
        for batch in batches:
            for row, data in enumerate(batch.column(content).to_pylist()):
                for at, x in slices_of(data or b"", target, seconds):
                    own = [batch.column(k).slice(row, 1) for k in keys]
                    yield pa.RecordBatch.from_arrays([*own, pa.array([target], pa.int32()), pa.array([at], pa.int64()), pa.array([x.astype(np.float32)], pa.list_(pa.float32()))], names=[*keys, "rate", "at", "samples"])

    return files.select(*keys, content).mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + SAMPLES)


def levels(slices: DataFrame, *keys: str) -> DataFrame:
    """Seconds and root mean square (of 16-bit samples) of every file, from its slices."""
    square = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    g = slices.groupBy(*keys).agg(F.sum(F.size("samples")).alias("n"), F.sum(square).alias("s"), F.first("rate").alias("rate"))
    return g.select(*keys, (F.col("n") / F.col("rate")).alias("seconds"), (F.sqrt(F.col("s") / F.col("n")) * 32768).alias("rms"))
