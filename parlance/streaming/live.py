"""Live recordings: chunks in arrival order, with state per recording.

``LiveState`` holds what a recording needs between chunks: its audio clock, utterance counter, speaker
centroids in order of creation, the last words said, and the number of polish passes. The batch fold
(``live_batch``) and the stream (``LiveProcessor`` under ``transformWithStateInPandas``) share its rules, so
both give the same rows. The stream keeps clock and counters in a value state, centroids in a map state (blocks
of ``BLOCK`` as bytes, since every entry costs a call) and words in a list state; a batch writes only the blocks
that it has moved. A chunk with ``stop`` set ends the
recording: it gives a row of its own and clears the state. State survives restarts with the checkpoint: a
reconnect goes on where the recording stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from parlance.streaming.replay import ROCKSDB  # noqa: F401

#: Gate, durations and thresholds; fixed values.
SILENCE, SHORT, LEAST_AUDIO, SAME, KEEP, BUFFER, PROMPT = 500.0, 2.0, 1.0, 0.45, 0.7, 60, 30
#: Centroids in an entry of the stream's state.
BLOCK = 64

OUTPUT = "recording long, arrival long, kind string, ord long, start_time double, end_time double, text string, speaker_label string, prompt string, clock double"
INPUT = ["recording", "arrival", "seconds", "loudness", "start", "end", "text", "embedding"]


class LiveState:
    """What a recording needs between chunks; ``moved`` holds the centroids that have changed."""

    def __init__(self, clock: float = 0.0, count: int = 0, polished: int = 0, words: list[str] | None = None, centroids: list[np.ndarray] | None = None):
        self.clock, self.count, self.polished, self.words = clock, count, polished, words or []
        self.centroids = np.array(centroids) if centroids else np.zeros((0, 0))
        self.norms = np.linalg.norm(self.centroids, axis=1) if centroids else np.zeros(0)
        self.moved: set[int] = set()

    def speaker(self, length: float, audio: float, embedding) -> str:
        """Label of an utterance: the most similar centroid, a new one, or the newest if it is too short."""
        if length < SHORT or audio < LEAST_AUDIO or embedding is None or not len(embedding):
            return f"Speaker {max(1, len(self.centroids))}"
        e = np.asarray(embedding, dtype=np.float64)
        if len(self.centroids):
            norms = self.norms * np.linalg.norm(e)
            sims = np.divide(self.centroids @ e, norms, out=np.zeros(len(norms)), where=norms > 0)
            best = int(sims.argmax())
            if sims[best] > 0 and sims[best] >= SAME:
                self.centroids[best] = self.centroids[best] * KEEP + e * (1 - KEEP)
                self.norms[best] = np.linalg.norm(self.centroids[best])
                self.moved.add(best)
                return f"Speaker {best + 1}"
        self.centroids = np.vstack([self.centroids, e]) if len(self.centroids) else e[None].copy()
        self.norms = np.append(self.norms, np.linalg.norm(e))
        self.moved.add(len(self.norms) - 1)
        return f"Speaker {len(self.centroids)}"

    def said(self, recording, arrival, seconds, at, start, end, text, embedding, clock) -> tuple:
        """The row of a voiced chunk that starts at ``at``."""
        a, b = round(start + at, 3), round(end + at, 3)
        inside = min(seconds, b - at) - max(0.0, a - at)
        label, prompt = self.speaker(b - a, inside, embedding), " ".join(self.words[-PROMPT:]) or None
        self.count += 1
        self.words = (self.words + text.split())[-BUFFER:]
        return (recording, arrival, "segment", self.count, a, b, text, label, prompt, clock)

    def mark(self, recording, arrival, clock) -> list[tuple]:
        """The mark of a polish pass that is due at ``clock``; at most one a chunk."""
        target = (self.polished + 1) * 60 if self.polished < 5 else (self.polished - 3) * 300
        if clock < 60 or clock < target:
            return []
        self.polished += 1
        return [(recording, arrival, "polish", self.polished, None, None, None, None, None, clock)]

    def step(self, recording, arrival, seconds, loudness, start, end, text, embedding) -> Iterator[tuple]:
        if seconds is None or np.isnan(seconds):  # the chunk could not be decoded
            return
        at = self.clock
        self.clock += seconds
        text = (text or "").strip()
        if loudness is not None and loudness >= SILENCE and "<|" not in text and "|>" not in text and len(text) > 2:
            yield self.said(recording, arrival, seconds, at, start, end, text, embedding, self.clock)
        yield from self.mark(recording, arrival, self.clock)

    def stopped(self, recording, arrival) -> tuple:
        """The row of a recording's end: its utterances and length."""
        return (recording, arrival, "stopped", self.count, None, None, None, None, None, self.clock)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in OUTPUT.split(", ")])


def _voiced(text: Column, loudness: Column) -> Column:
    """The gate of ``LiveState.step`` as a column: loud enough, and not a leaked token or next to nothing."""
    return F.coalesce((loudness >= SILENCE) & (F.length(text) > 2) & ~text.contains("<|") & ~text.contains("|>"), F.lit(False))


def _with_stop(chunks: DataFrame) -> DataFrame:
    return chunks.select(*INPUT, (F.coalesce("stop", F.lit(False)) if "stop" in chunks.columns else F.lit(False)).alias("stop"))


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """A list column's vectors, as views of its values."""
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] if there else None for a, b, there in zip(ends[:-1], ends[1:], column.is_valid().to_pylist(), strict=True)]


def _spoken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The utterances of chunks sorted by recording and arrival; one recording's state is held at a time."""
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    columns = [c.split(" ") for c in OUTPUT.split(", ")]
    state, of = LiveState(), ...  # no recording yet; a null one is a recording too
    for batch in batches:
        out = []
        narrow = (batch.column(c).to_pylist() for c in ("recording", "arrival", "seconds", "stop", "voiced", "start", "end", "text"))
        for recording, arrival, seconds, stop, voiced, start, end, text, vector in zip(*narrow, _vectors(batch.column("embedding")), strict=True):
            if recording != of:
                state, of = LiveState(), recording
            at = state.clock
            state.clock += seconds
            if voiced:
                out.append(state.said(recording, arrival, seconds, at, start, end, text, vector, state.clock))
            if stop:
                state = LiveState()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, kinds[k]) for x, (_, k) in zip(zip(*out, strict=True), columns, strict=True)], names=[c for c, _ in columns])


def polish_marks(heard: DataFrame) -> DataFrame:
    """Polish marks of ``heard(recording, part, arrival, clock)``: pass j comes with the first chunk that reaches its time, at most one a chunk.

    With f(j) the first chunk that reaches pass j's time, pass j comes with chunk j + max(f(i) - i) over i up to j.
    """
    w = Window.partitionBy("recording", "part").orderBy("arrival")
    due = F.least(F.floor(F.col("clock") / 60), F.lit(5)) + F.greatest(F.floor(F.col("clock") / 300) - 1, F.lit(0))
    rows = heard.withColumns({"n": F.row_number().over(w), "due": due}).withColumn("late", F.coalesce(F.lag("due").over(w), F.lit(0)))
    passes = rows.where(F.col("due") > F.col("late")).select("recording", "part", F.col("n").alias("f"), F.explode(F.sequence(F.col("late") + 1, F.col("due"))).alias("ord"))
    order = Window.partitionBy("recording", "part").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = passes.select("recording", "part", "ord", (F.col("ord") + F.max(F.col("f") - F.col("ord")).over(order)).alias("n"))
    return rows.select("recording", "part", "n", "arrival", "clock").join(placed, ["recording", "part", "n"])


def live_batch(chunks: DataFrame) -> DataFrame:
    """All recordings folded in arrival order, as the stream does it.

    Gate, marks and ends are columns; only what depends on all before it goes through Python: speakers and
    prompts. Vectors are moved once, to the sorted chunks that the fold reads in batches; ``part`` counts the
    stops before a chunk.
    """
    chunks = _with_stop(chunks).where(F.col("stop") | (F.col("seconds").isNotNull() & ~F.isnan("seconds")))
    chunks = chunks.withColumns({"seconds": F.when(~F.col("stop"), F.col("seconds")).otherwise(F.lit(0.0)), "text": F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")})
    chunks = chunks.withColumn("voiced", _voiced(F.col("text"), F.col("loudness")) & ~F.col("stop"))
    w = Window.partitionBy("recording").orderBy("arrival")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    heard = chunks.select("recording", "arrival", "seconds", "stop", "voiced").withColumn("part", F.coalesce(F.sum(F.col("stop").cast("long")).over(before), F.lit(0)))
    own = Window.partitionBy("recording", "part").orderBy("arrival")
    heard = heard.withColumn("clock", F.sum("seconds").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    null = lambda kind: F.lit(None).cast(kind)
    row = lambda df, kind: df.select("recording", "arrival", F.lit(kind).alias("kind"), F.col("ord").cast("long").alias("ord"), *(null(t).alias(c) for c, t in (("start_time", "double"), ("end_time", "double"), ("text", "string"), ("speaker_label", "string"), ("prompt", "string"))), "clock")
    said = [F.when(F.col("voiced"), F.col(c)).alias(c) for c in ("start", "end", "text", "embedding")]
    dealt = chunks.select("recording", "arrival", "seconds", "stop", "voiced", *said).repartition("recording").sortWithinPartitions("recording", "arrival")
    spoken = dealt.mapInArrow(_spoken, OUTPUT)
    marks = polish_marks(heard.where(~F.col("stop")).select("recording", "part", "arrival", "clock"))
    ends = heard.withColumn("ord", F.sum(F.col("voiced").cast("long")).over(own)).where("stop")
    return spoken.unionByName(row(marks, "polish")).unionByName(row(ends, "stopped"))


class LiveProcessor(StatefulProcessor):
    """``keep_ms``: a recording that is silent for so long loses its state; None keeps it until it is stopped."""

    def __init__(self, keep_ms: int | None = None):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.book = handle.getValueState("book", "clock double, count long, polished int, speakers int", self.keep_ms)
        self.centroids = handle.getMapState("centroids", "block int", "centroids binary", self.keep_ms)
        self.words = handle.getListState("words", "word string", self.keep_ms)

    def _load(self) -> LiveState:
        held = self.book.get()
        if held is None:
            return LiveState()
        clock, count, polished, speakers = held
        return LiveState(clock, count, polished, [w[0] for w in self.words.get()], self._centroids(speakers))

    def _centroids(self, speakers: int) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for i in range(-(-speakers // BLOCK)):
            out.extend(np.frombuffer(self.centroids.getValue((i,))[0]).reshape(min(BLOCK, speakers - i * BLOCK), -1))
        return out

    def _clear(self) -> None:
        for state in (self.book, self.centroids, self.words):
            state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        live, said, ended, out = self._load(), 0, False, []
        frames = list(rows)
        frame = frames[0] if len(frames) == 1 else pd.concat(frames)
        order = frame["arrival"].to_numpy().argsort(kind="stable")
        for *row, stop in zip(*(frame[c].iloc[order].tolist() for c in (*INPUT, "stop")), strict=True):
            if stop:
                out.append(live.stopped(row[0], row[1]))
                live, said, ended = LiveState(), 0, True
                continue
            had = live.count
            out += live.step(*row)
            said += live.count - had
        if ended:
            self._clear()
        if live.clock or not ended:
            self.book.update((live.clock, live.count, live.polished, len(live.centroids)))
            for i in {label // BLOCK for label in live.moved}:
                self.centroids.updateValue((i,), (live.centroids[i * BLOCK : (i + 1) * BLOCK].tobytes(),))
            if said:
                self.words.put([(w,) for w in live.words])
        if out:
            yield _frame(out)

    def close(self) -> None:
        pass


def live_stream(chunks: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """The same over a stream; the state store must be RocksDB (``ROCKSDB``)."""
    how = "ProcessingTime" if keep_ms else "None"
    return _with_stop(chunks).groupBy("recording").transformWithStateInPandas(LiveProcessor(keep_ms), outputStructType=OUTPUT, outputMode="Append", timeMode=how)


def _timed(events: DataFrame, late: str) -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", late) if e.isStreaming else e


def windows(events: DataFrame, length: str = "4 seconds", late: str = "10 minutes") -> DataFrame:
    """Tumbling windows over event time with a watermark (batch or stream): count and mean loudness."""
    g = _timed(events, late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", "mean_value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Spells of a user's events with no gap of ``gap`` between them; late events are dropped by the watermark."""
    g = _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "total")


def delivered_once(messages: DataFrame, *keys: str, late: str = "10 minutes") -> DataFrame:
    """Each message once, however often it is delivered within the watermark's delay."""
    m = _timed(messages, late)
    return m.dropDuplicatesWithinWatermark(list(keys)) if m.isStreaming else m.dropDuplicates(list(keys))


def transcribed(chunks: DataFrame, transcripts: DataFrame, within: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Chunks with the transcripts that follow within so long in the same recording; both sides' state ends by their watermarks."""
    c = _timed(chunks, late).select("recording", "chunk_id", F.col("ts").alias("chunk_ts"))
    t = _timed(transcripts, late).select(F.col("recording").alias("_recording"), "transcript_id", F.col("ts").alias("transcript_ts"))
    near = (F.col("recording") == F.col("_recording")) & (F.col("transcript_ts") >= F.col("chunk_ts")) & (F.col("transcript_ts") < F.col("chunk_ts") + F.expr(f"INTERVAL {within}"))
    return c.join(t, near).drop("_recording")


#: Message types that a live client gets; fixed values.
RELAYED = ["polish_started", "polish_complete", "finalize_started", "finalize_complete", "progress", "error"]


def relayed(messages: DataFrame) -> DataFrame:
    """Channel messages that a live client gets."""
    return messages.where(F.get_json_object("value", "$.type").isin(RELAYED))


#: Samples a second and bytes a sample of recorded audio; fixed values.
RATE, WIDTH = 16_000, 2


def pcm_seconds(size) -> Column:
    """Seconds of so many bytes of audio."""
    return F.col(size) / F.lit(float(RATE * WIDTH))


def pcm_bounds(start, end, size) -> Column:
    """(first, last) byte of the audio between two times, whole samples, within ``size`` bytes."""
    at = lambda t: F.floor(F.greatest(F.col(t), F.lit(0.0)) * RATE) * WIDTH
    last = F.least(at(end), F.col(size))
    return F.struct(F.least(at(start), last).alias("first"), last.alias("last"))


def pcm_slice(df: DataFrame, audio: str, start: str, end: str, to: str = "slice") -> DataFrame:
    """``df`` with the bytes of ``audio`` between two times."""
    rows = df.withColumn("_size", F.octet_length(audio))
    at = pcm_bounds(start, end, "_size")
    return rows.withColumn(to, F.substring(F.col(audio), (at["first"] + 1).cast("int"), (at["last"] - at["first"]).cast("int"))).drop("_size")


def input_level(samples) -> Column:
    """Mean of byte levels as a share of 128; 0 without samples."""
    return F.coalesce(F.aggregate(F.col(samples), F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(samples), F.lit(0)) / 128, F.lit(0.0))
