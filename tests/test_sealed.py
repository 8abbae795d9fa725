"""Tokens, summaries, audio samples."""

import hashlib
import hmac
import math
import struct
import wave
import base64
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions import office, tokens
from parlance.operators import summaries
from parlance.sources import audio

# --- tokens -------------------------------------------------------------------------------------------

#: The published test vector of the token format.
KEY = base64.urlsafe_b64decode("cw_0x689RpI-jtRR7oE8h_eQsKImvJapLeSbXpwF4e4=")
TOKEN, WHEN = "gAAAAAAdwJ6wAAECAwQFBgcICQoLDA0ODy021cpGVWKZ_eEwCGM4BLLF_5CV9dOPmrhuVUPgJobwOz7JcbmrR64jVmpU4IwqDA==", 499162800


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def test_published_vector(spark):
    key = F.lit(KEY)
    vector = F.lit(bytes(range(16)))
    made, opened, fresh, old = one(spark, tokens.sealed(F.lit("hello"), key, F.lit(WHEN), vector), tokens.unsealed(F.lit(TOKEN), key), tokens.unsealed(F.lit(TOKEN), key, F.lit(WHEN + 60), 60), tokens.unsealed(F.lit(TOKEN), key, F.lit(WHEN + 61), 60))
    assert (made, opened, fresh, old) == (TOKEN, "hello", "hello", None)


def test_hmac_equals_the_library(spark):
    for key, text in ((b"", b""), (b"k" * 16, b"x"), (bytes(range(64)), b"a" * 1000), (b"\xff\x00" * 8, "é".encode())):
        (got,) = one(spark, tokens.hmac_sha256(F.lit(key), F.lit(text)))
        assert bytes(got) == hmac.new(key, text, hashlib.sha256).digest()


def test_every_changed_character_is_refused(spark):
    swap = lambda i: TOKEN[:i] + ("A" if TOKEN[i] != "A" else "B") + TOKEN[i + 1 :]
    bad = [swap(i) for i in range(len(TOKEN.rstrip("=")) - 1)] + ["", "x", "====", "é", TOKEN[:40], TOKEN + TOKEN, base64.urlsafe_b64encode(b"\x80" * 72).decode()]
    df = spark.createDataFrame([(t,) for t in [*bad, None]], "t string")
    assert df.where(tokens.unsealed(F.col("t"), F.lit(KEY)).isNotNull()).count() == 0
    assert one(spark, tokens.unsealed(F.lit(TOKEN), F.lit(KEY[::-1]))) == (None,)


def test_own_vectors_differ_and_open(spark):
    df = spark.createDataFrame([("same",), ("same",), ("",), (None,), ("é" * 500,)], "t string")
    rows = df.select("t", tokens.sealed(F.col("t"), F.lit(KEY), F.lit(1)).alias("token")).collect()
    assert len({r.token for r in rows}) == 5
    again = spark.createDataFrame([(r.t, r.token) for r in rows], "t string, token string").select("t", tokens.unsealed(F.col("token"), F.lit(KEY)).alias("o")).collect()
    assert all(r.t == r.o for r in again)


# --- summaries ----------------------------------------------------------------------------------------


def test_merged_sketches_are_within_their_bounds(spark):
    rows = spark.range(200_000).select((F.col("id") % 30).alias("day"), (F.col("id") % 3).alias("owner"), (F.xxhash64("id") % 40_000).alias("who"), (F.abs(F.xxhash64("id")) % 1_000_003).cast("double").alias("value"))
    s = summaries.stored(rows, ["day", "owner"], "who", "value")
    for r in summaries.merged(s, "owner").collect():
        own = rows.where(F.col("owner") == r.owner)
        n, people = own.agg(F.count("*"), F.count_distinct("who")).first()
        assert r.n == n and abs(r.people / people - 1) < 4 * 1.04 / math.sqrt(1 << summaries.PRECISION)
        for q, cut in zip((0.1, 0.5, 0.9), r.quantiles, strict=True):
            assert abs(own.where(F.col("value") <= cut).count() / n - q) < 0.02
    total = summaries.merged(s.where("day < 10")).first()
    assert total.n == rows.where("day < 10").count()


def test_sets(spark):
    s = summaries.stored(spark.createDataFrame([(1, "a", 7, 1.0), (1, "b", 7, 2.0), (2, "a", 8, 4.0)], "day int, kind string, who int, value double"), ["day", "kind"], "who", "value")
    got = sorted((str(r.day), str(r.kind), r.level, r.n, r.total) for r in summaries.in_sets(s, [["day"], ["kind"], []]).collect())
    assert got == sorted([("1", "None", 1, 2, 3.0), ("2", "None", 1, 1, 4.0), ("None", "a", 2, 2, 5.0), ("None", "b", 2, 1, 2.0), ("None", "None", 3, 3, 7.0)])


# --- audio --------------------------------------------------------------------------------------------


def sine(rate, freq, seconds, channels=1, level=0.5):
    x = level * np.sin(2 * np.pi * freq * np.arange(int(rate * seconds)) / rate)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.repeat(np.round(x * 32767).astype("<i2"), channels).tobytes())
    return out.getvalue(), x


@pytest.mark.parametrize("rate", [8000, 11025, 22050, 44100, 48000, 16000])
def test_a_sine_keeps_frequency_and_level(rate):
    data, x = sine(rate, 440.0, 1.0, channels=2)
    found, mono = audio.riff(data)
    assert found == rate and np.allclose(mono, np.round(x * 32767) / 32768, atol=1e-4)
    y = audio.resampled(mono, rate, 16_000)
    assert len(y) == 16_000
    want = 0.5 * np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000)
    assert np.abs(y - want)[500:-500].max() < 2e-3
    power = np.abs(np.fft.rfft(y))
    assert power.argmax() == 440


def test_what_is_above_half_the_rate_goes():
    _, x = sine(48_000, 11_000.0, 0.5)
    assert np.abs(audio.resampled(x, 48_000, 16_000)[500:-500]).max() < 5e-3


@pytest.mark.parametrize("seconds", [0.01, 0.1, 0.37])
def test_slices_equal_the_whole(seconds):
    data, _ = sine(44_100, 300.0, 0.9)
    rate, x = audio.riff(data)
    parts = list(audio.slices_of(data, 16_000, seconds))
    assert [a for a, _ in parts] == [k * int(seconds * 16_000) for k in range(len(parts))]
    assert (np.concatenate([p for _, p in parts]) == audio.resampled(x, rate, 16_000)).all()


def make(kind, bits, channels, body, rate=16_000, extra=b""):
    fmt = struct.pack("<HHIIHH", kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    chunks = b"fmt " + struct.pack("<I", len(fmt)) + fmt + extra + b"data" + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def test_sample_formats():
    want = [0.0, 0.5, -0.5, -1.0]
    assert np.allclose(audio.riff(make(1, 8, 1, bytes([128, 192, 64, 0])))[1], want)
    assert np.allclose(audio.riff(make(1, 16, 1, struct.pack("<4h", 0, 16384, -16384, -32768)))[1], want)
    assert np.allclose(audio.riff(make(1, 24, 1, b"".join(struct.pack("<i", v)[:3] for v in (0, 1 << 22, -(1 << 22), -(1 << 23)))))[1], want)
    assert np.allclose(audio.riff(make(1, 32, 1, struct.pack("<4i", 0, 1 << 30, -(1 << 30), -(1 << 31))))[1], want)
    assert np.allclose(audio.riff(make(3, 32, 2, struct.pack("<4f", 0.0, 1.0, -0.5, 0.5)))[1], [0.5, 0.0])
    odd = b"LIST" + struct.pack("<I", 3) + b"abc\0"  # an odd chunk is padded
    assert len(audio.riff(make(1, 16, 1, b"\1\0" * 5 + b"\1", extra=odd))[1]) == 5
    for bad in (b"", b"RIFF", b"nothing at all here", make(7, 8, 1, b"x"), make(1, 16, 0, b"xx"), make(1, 16, 1, b"xx")[:30]):
        assert audio.riff(bad) is None


def test_levels_of_files(spark, tmp_path):
    for i, rate in enumerate((16_000, 48_000)):
        (tmp_path / f"{i}.wav").write_bytes(sine(rate, 200.0, 2.5)[0])
    (tmp_path / "bad.wav").write_bytes(b"not audio")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    cut = audio.samples(files, seconds=1.0)
    assert cut.groupBy("path").count().where("count = 3").count() == 2
    got = [(r.seconds, r.rms) for r in audio.levels(cut, "path").collect()]
    assert all(s == 2.5 and abs(r - 0.5 * 32767 / math.sqrt(2)) < 20 for s, r in got) and len(got) == 2
    w = spark.createDataFrame([(1, bytearray(struct.pack("<3h", 3, -4, 0)))], "k int, b binary").select("k", office.wav_file(F.col("b")).alias("content"))
    assert abs(audio.levels(audio.samples(w, keys=("k",)), "k").first().rms - math.sqrt(25 / 3)) < 1e-3


def test_audio_files_are_made_by_built_ins(spark):
    data = [b"", b"\x01", b"\x01\x02", bytes(range(256)) * 300, None]
    made = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "i int, b binary").select("i", office.wav_file(F.col("b")).alias("w"))
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString()
    assert [r.w and bytes(r.w) for r in made.orderBy("i").collect()] == [d if d is None else office.wav(d) for d in data]
