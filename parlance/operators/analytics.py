"""Recording lists, speaking-time analytics, timelines, transcripts for prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import exprs as X


def list_meetings(meetings: DataFrame, speakers: DataFrame, segments: DataFrame) -> DataFrame:
    """Recordings with their numbers of speakers and utterances, newest first."""
    a = speakers.groupBy("meeting_id").agg(F.count("*").alias("speaker_count"))
    b = segments.groupBy("meeting_id").agg(F.count("*").alias("segment_count"))
    return meetings.join(a, "meeting_id", "left").join(b, "meeting_id", "left").fillna(0, ["speaker_count", "segment_count"]).orderBy(F.desc("created_at"), "meeting_id")


def meeting_analytics(meetings: DataFrame, speakers: DataFrame, segments: DataFrame, recompute: bool = False) -> DataFrame:
    """Per recording and speaker: time, share, count, rank; per recording: totals and silence, to one decimal.

    Stored speaker totals count, also where they are stale; ``recompute`` takes them from the utterances.
    Speakers sort by rounded time, then in order of speaker_id.
    """
    from parlance.operators.speakers import refreshed

    s = refreshed(speakers, segments) if recompute else speakers
    live = segments.groupBy("meeting_id", "speaker_id").agg(F.count("*").alias("live_count"))
    w = Window.partitionBy("meeting_id")
    s = s.join(live, ["meeting_id", "speaker_id"], "left").withColumn("t", F.coalesce("total_speaking_time", F.lit(0.0)))
    s = s.withColumn("all_t", F.sum("t").over(w)).join(meetings.select("meeting_id", F.coalesce("duration", F.lit(0.0)).alias("duration")), "meeting_id")
    count = F.when(F.coalesce("segment_count", F.lit(0)) != 0, F.col("segment_count")).otherwise(F.coalesce("live_count", F.lit(0)))
    r = lambda c: F.bround(c, 1)
    out = s.select(
        "meeting_id", "speaker_id", X.shown_name().alias("name"), r(F.col("t")).alias("speaking_time"), count.alias("segment_count"),
        r(F.when(F.col("all_t") > 0, F.try_divide("t", "all_t") * 100).otherwise(0.0)).alias("percentage"),
        r(F.col("duration")).alias("total_duration"), r(F.col("all_t")).alias("total_speaking_time"),
        r(F.when(F.col("duration") > 0, F.greatest(F.lit(0.0), F.try_divide(F.col("duration") - F.col("all_t"), "duration") * 100)).otherwise(0.0)).alias("silence_percentage"),
    )
    return out.withColumn("position", F.row_number().over(w.orderBy(F.desc("speaking_time"), "speaker_id")).cast("long"))


def timelines(speakers: DataFrame, segments: DataFrame) -> DataFrame:
    """Per speaker the (start, end) of all utterances, in order; an empty list without any."""
    t = segments.groupBy("meeting_id", "speaker_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("start_time").alias("start"), F.col("end_time").alias("end")))).alias("t"))
    t = t.withColumn("t", F.transform("t", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    return speakers.select("meeting_id", "speaker_id").join(t, ["meeting_id", "speaker_id"], "left").select("meeting_id", "speaker_id", F.coalesce("t", F.array().cast("array<struct<start:double,end:double>>")).alias("timeline"))


def timeline_bars(meetings: DataFrame, segments: DataFrame) -> DataFrame:
    """Left edge and width of each utterance in percent of the duration; at least half a percent wide."""
    d = meetings.select("meeting_id", "duration").where("duration > 0")
    return segments.join(d, "meeting_id").select("meeting_id", "ord", (F.col("start_time") / F.col("duration") * 100).alias("left"), F.greatest(F.lit(0.5), (F.col("end_time") - F.col("start_time")) / F.col("duration") * 100).alias("width"))


def with_speaker(segments: DataFrame, speakers: DataFrame, unknown: str = "Unknown") -> DataFrame:
    """Utterances with their speaker's shown name; those without a speaker stay."""
    s = speakers.select("meeting_id", "speaker_id", X.shown_name().alias("speaker_name"), "label")
    return segments.join(s, ["meeting_id", "speaker_id"], "left").withColumn("speaker_name", F.coalesce("speaker_name", F.lit(unknown)))


def live_summary(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """Speakers heard so far: first shown name, seconds, utterances, in order of appearance."""
    s = with_speaker(segments, speakers).where("speaker_id is not null")
    return s.groupBy("meeting_id", "speaker_id").agg(F.min("ord").alias("first_ord"), F.min(F.struct("ord", "speaker_name"))["speaker_name"].alias("name"), F.sum(F.col("end_time") - F.col("start_time")).alias("seconds"), F.count("*").alias("utterances"))


STYLES = {
    "insights": lambda: F.format_string("[%s] [%s]: %s", X.seconds_text("start_time"), "speaker_name", "text"),
    "action": lambda: F.format_string("[%s]: %s", "speaker_name", "text"),
    "protocol": lambda: F.format_string("[%s] [%s]: %s", X.minutes_time("start_time"), "speaker_name", "text"),
    "intro": lambda: F.format_string("[%s]: %s", F.coalesce("label", F.lit("UNKNOWN")), "text"),
}


#: What follows a transcript that is cut; fixed values.
CUT_MARKS = {"protocol": "\n\n[...transcript truncated...]", "insights": "\n\n[...transcription truncated...]", "action": "\n\n[...transcription truncated...]", "intro": ""}


def transcript_text(segments: DataFrame, speakers: DataFrame, style: str = "protocol", limit: int = 15_000, until: float | None = None) -> DataFrame:
    """One text per recording for a model call: a line per utterance, cut at ``limit`` characters."""
    s = with_speaker(segments, speakers)
    s = s if until is None else s.where(F.col("start_time") < until)
    lines = s.select("meeting_id", "ord", STYLES[style]().alias("line")).groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("l"))
    return lines.select("meeting_id", X.cut(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), limit, CUT_MARKS[style]).alias("transcript"))


def model_inputs(meetings: DataFrame, segments: DataFrame, speakers: DataFrame, style: str) -> DataFrame:
    """(meeting_id, input): what a model is told about a recording: for a protocol its date, length and attendees too.

    Recordings without utterances have no input.
    """
    m = meetings.join(transcript_text(segments, speakers, style), "meeting_id")
    title = F.concat(F.lit("Meeting title: "), "title")
    if style != "protocol":
        return m.select("meeting_id", F.concat(title, F.lit("\n\nTranscription:\n"), "transcript").alias("input"))
    known = speakers.where("label <> 'UNKNOWN'").groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("label", X.shown_name().alias("name")))).alias("p"))
    names = F.coalesce(F.array_join(F.transform("p", lambda x: x["name"]), ", "), F.lit(""))
    length = F.when(F.coalesce("duration", F.lit(0.0)) != 0, F.concat(X.whole_minutes("duration").cast("string"), F.lit(" minutes"))).otherwise("")
    lines = (title, F.concat(F.lit("Date: "), F.coalesce(X.day_text("created_at"), F.lit(""))), F.concat(F.lit("Duration: "), length), F.concat(F.lit("Attendees: "), names, F.lit("\n")), F.concat(F.lit("Transcript:\n"), "transcript"))
    return m.join(known, "meeting_id", "left").select("meeting_id", F.concat_ws("\n", *lines).alias("input"))


def speaker_texts(segments: DataFrame, limit: int = 800) -> DataFrame:
    """What each speaker said, in order, cut at ``limit`` characters."""
    g = segments.groupBy("meeting_id", "speaker_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("t"))
    return g.select("meeting_id", "speaker_id", "n", X.cut(F.array_join(F.transform("t", lambda x: x["text"]), " "), limit).alias("text"))


def live_colours(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """``live_summary`` with each speaker's colour as first shown."""
    return live_summary(segments, speakers).join(speakers.select("meeting_id", "speaker_id", "color"), ["meeting_id", "speaker_id"], "left")


def insights_by_type(insights: DataFrame) -> DataFrame:
    """Numbers of insights per recording: decisions, action items, open questions, and those done."""
    kinds = ("decision", "action_item", "open_question")
    n = lambda when: F.count(F.when(when, 1))
    return insights.groupBy("meeting_id").agg(*(n(F.col("insight_type") == k).alias(f"{k}s") for k in kinds), n(F.col("status") == "completed").alias("completed"))


def health(checks: DataFrame, free: str = "disk_free_gb") -> DataFrame:
    """Per host: ok if every check but the free space says so, else degraded."""
    ok = F.bool_and(F.when(F.col("name") != free, F.coalesce(F.col("value") == "ok", F.lit(False))))
    return checks.groupBy("host").agg(F.when(F.coalesce(ok, F.lit(True)), "ok").otherwise("degraded").alias("status"), F.bool_or(F.col("value") == "ok").alias("any_ok"))


def flagged(segments: DataFrame, least: float = 0.6) -> DataFrame:
    """``low_confidence``: utterances whose known confidence is below ``least``."""
    return segments.withColumn("low_confidence", F.coalesce(F.col("confidence") < least, F.lit(False)))


def nested(meetings: DataFrame, speakers: DataFrame, segments: DataFrame) -> DataFrame:
    """Recordings with their speakers (by label) and utterances (in order) as nested rows."""
    rows = lambda df, by: df.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct(by, *(c for c in df.columns if c not in ("meeting_id", by))))).alias("x"))
    out = meetings.join(rows(speakers, "label").withColumnRenamed("x", "speakers"), "meeting_id", "left")
    return out.join(rows(segments, "ord").withColumnRenamed("x", "segments"), "meeting_id", "left")


def has_intro(segments: DataFrame, within: float = 120.0) -> DataFrame:
    """Whether the first ``within`` seconds hold an introduction phrase."""
    from parlance.schemas import INTRO_PATTERNS

    early = segments.where(F.col("start_time") < within).groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("t"))
    text = F.lower(F.array_join(F.transform("t", lambda x: x["text"]), " "))
    hit = text.rlike("(?U)" + "|".join(f"(?:{p})" for p in INTRO_PATTERNS))
    return segments.select("meeting_id").distinct().join(early.select("meeting_id", hit.alias("h")), "meeting_id", "left").select("meeting_id", F.coalesce("h", F.lit(False)).alias("has_intro"))
