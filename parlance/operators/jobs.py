"""Whole jobs, composed of the operators: processing, new diarization, new identification, finalizing, polishing.

Each is a function from tables to tables; a failing call or an empty input changes nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance import schemas
from parlance.functions import exprs as X
from parlance.operators import align, analytics, chunks, models, mutate, speakers, vocabulary

#: Where a progress bar goes on to its next step; fixed values.
STEPS = [("audio", 2), ("whisper", 10), ("llm", 30), ("diarization", 45), ("alignment", 75), ("speaker_id", 90), ("done", 100)]


def speaker_key(meeting: str = "meeting_id", label: str = "label") -> Column:
    return F.concat_ws(":", F.col(meeting).cast("string"), label)


def identified(aligned: DataFrame, answers: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Speakers of aligned utterances: names out of the model's answers, then participants, colours, UNKNOWN.

    ``asked`` limits the recordings whose answers count: those with an introduction, unless given.
    """
    if asked is None:
        asked = analytics.has_intro(aligned).where("has_intro")
    named = speakers.intro_names(answers.join(asked.select("meeting_id").distinct(), "meeting_id", "left_semi"))
    return speakers.name_speakers(aligned.select("meeting_id", F.col("speaker").alias("label")), named)


def with_voices(found: DataFrame, turns: DataFrame, voices: DataFrame, profiles: DataFrame, threshold: float = 0.55) -> DataFrame:
    """Saved voices lend their names, except to speakers named by the introduction with more than 0.7.

    ``voices(meeting_id, label, embedding)`` is the embedding of a speaker's longest turn; speakers whose
    longest turn is under two seconds, or without an embedding, stay as they are.
    """
    sure = (F.col("identified_by") == "intro_llm") & (F.col("confidence") > 0.7)
    open_ = found.where((F.col("label") != schemas.UNKNOWN_LABEL) & ~F.coalesce(sure, F.lit(False))).select("meeting_id", "label")
    probes = open_.join(speakers.longest_turn(turns).select("meeting_id", "label"), ["meeting_id", "label"]).join(voices, ["meeting_id", "label"])
    hits = speakers.match_profiles(probes, profiles, threshold).where("profile is not null").select("meeting_id", "label", F.col("profile").alias("display_name"), F.lit("voice_profile").alias("identified_by"), F.bround("similarity", 3).alias("confidence"))
    return mutate.patch(found, hits, "meeting_id", "label")


def rebuild(aligned: DataFrame, found: DataFrame, old: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(segments, speakers) of a recording anew: edits of ``old`` kept, rows numbered from 0, statistics taken."""
    rows = aligned.withColumn("is_edited", F.lit(False)) if old is None else aligned
    rows = rows.withColumn("original_text", F.col("text")) if old is None else align.preserve_edits(rows, old)
    number = F.row_number().over(Window.partitionBy("meeting_id").orderBy("ord")) - 1
    known = found.select("meeting_id", F.col("label").alias("speaker"), speaker_key().alias("speaker_id"))
    segments = rows.join(known, ["meeting_id", "speaker"], "left").withColumn("ord", number.cast("long"))
    stats = speakers.speaker_stats(aligned, "speaker").withColumnRenamed("speaker", "label")
    people = found.withColumn("speaker_id", speaker_key()).join(stats, ["meeting_id", "label"], "left").fillna({"segment_count": 0, "total_speaking_time": 0.0})
    return segments.drop("speaker"), people


def process(transcript: DataFrame, turns: DataFrame, answers: DataFrame, intros: DataFrame, voices: DataFrame | None = None, profiles: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A new recording: align, identify (where the introduction gave names or an end), match voices, store."""
    aligned = align.align(transcript, turns)
    known = intros.where("size(names) > 0 or coalesce(intro_end_time, 0) <> 0")
    found = identified(aligned, answers, known)
    if voices is not None and profiles is not None:
        found = with_voices(found, turns, voices, profiles)
    return rebuild(aligned, found)


def reprocess(transcript: DataFrame, turns: DataFrame, answers: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New diarization, new identification, or finalizing: which of them, is only which inputs are new."""
    aligned = align.align(transcript, turns)
    return rebuild(aligned, identified(aligned, answers), old)


def finished(meetings: DataFrame, jobs: DataFrame, now: Column, live: bool = False) -> tuple[DataFrame, DataFrame]:
    """(meetings, jobs) after success of the jobs' recordings; a live one's recording is complete too."""
    done = jobs.select("meeting_id").distinct().withColumn("_d", F.lit(True))
    m = meetings.join(done, "meeting_id", "left")
    hit = F.coalesce("_d", F.lit(False))
    m = m.withColumn("status", F.when(hit, "completed").otherwise(F.col("status")))
    if live:
        m = m.withColumn("recording_status", F.when(hit, "complete").otherwise(F.col("recording_status")))
    return m.drop("_d"), jobs.withColumns({"status": F.lit("completed"), "progress": F.lit(100.0), "current_step": F.lit("Done!"), "completed_at": now})


def failed(meetings: DataFrame, jobs: DataFrame, errors: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(meetings, jobs, messages) after ``errors(job_id, error)``: job and recording fail, clients hear of it."""
    e = errors.select("job_id", F.col("error").alias("_e"))
    j = jobs.join(e, "job_id", "left")
    hit = F.col("_e").isNotNull()
    j = j.withColumns({"status": F.when(hit, "failed").otherwise(F.col("status")), "error": F.coalesce("_e", "error"), "completed_at": F.when(hit, now).otherwise(F.col("completed_at"))})
    lost = j.where(hit).select("meeting_id").distinct().withColumn("_l", F.lit(True))
    m = meetings.join(lost, "meeting_id", "left").withColumn("status", F.when(F.col("_l"), "failed").otherwise(F.col("status"))).drop("_l")
    told = j.where(hit).select(F.concat(F.lit("meeting:"), F.col("meeting_id").cast("string")).alias("key"), F.to_json(F.struct(F.lit("error").alias("type"), F.col("_e").alias("error"))).alias("value"))
    return m, j.drop("_e"), told


def polish(segments: DataFrame, people: DataFrame, answers: DataFrame, number: Column, keep: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segments, speakers, passes): small speakers merged into the nearest, names laid over, statistics anew.

    Speakers who lost their last utterance in the merge go. ``passes(meeting_id, p)`` are the entries for
    the recordings' history.
    """
    moved = align.nearest_reassign(segments, keep)
    small = segments.where("speaker_id is not null").groupBy("meeting_id", "speaker_id").agg(F.count("*").alias("n")).where(F.col("n") < keep)
    emptied = small.join(moved.select("meeting_id", F.col("new_speaker_id").alias("speaker_id")).distinct(), ["meeting_id", "speaker_id"], "left_anti")
    merged = moved.where(~F.col("new_speaker_id").eqNullSafe(F.col("speaker_id"))).groupBy("meeting_id").agg(F.count("*").alias("merged"))
    after = moved.withColumn("speaker_id", F.col("new_speaker_id")).drop("new_speaker_id")
    heard = segments.select("meeting_id").distinct()
    left = people.join(heard, "meeting_id", "left_semi").join(emptied, ["meeting_id", "speaker_id"], "left_anti")
    names = answers.where("coalesce(label, '') <> '' AND coalesce(name, '') <> ''").groupBy("meeting_id", "label").agg(F.max(F.struct("pos", "name"))["name"].alias("name"))
    named = speakers.refreshed(speakers.polish_names(left, names), after)
    counts = left.groupBy("meeting_id").agg(F.count("*").alias("people")).join(names.groupBy("meeting_id").agg(F.count("*").alias("found")), "meeting_id", "left").join(merged, "meeting_id", "left")
    entry = F.struct(number.cast("long").alias("pass"), F.lit(None).cast("double").alias("duration_seconds"), F.col("people").alias("speaker_count"), F.coalesce("found", F.lit(0)).alias("names_found"), F.coalesce("merged", F.lit(0)).alias("merged_segments"), F.lit(None).cast("timestamp").alias("timestamp"))
    return after, named, counts.select("meeting_id", entry.alias("p"))


def polish_prompts(segments: DataFrame, people: DataFrame, limit: int = 800) -> DataFrame:
    """The part of the naming prompt that tells what each speaker said: one text per recording."""
    said = analytics.speaker_texts(segments.where("speaker_id is not null"), limit).join(people.select("meeting_id", "speaker_id", "label"), ["meeting_id", "speaker_id"])
    rows = said.select("meeting_id", "label", F.format_string("[%s] (%d segment): %s", "label", "n", "text").alias("block"))
    g = rows.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("label", "block"))).alias("b"))
    return g.select("meeting_id", F.size("b").alias("speakers"), F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("prompt"))


def run_action(meetings: DataFrame, segments: DataFrame, people: DataFrame, actions: DataFrame, model: Callable[[str, str], str | None]) -> DataFrame:
    """Results (action_id, meeting_id, status, result_text) of every action on every recording with utterances.

    ``model(prompt, input)`` answers; a call that fails gives a failed result.
    """
    inputs = analytics.model_inputs(meetings, segments, people, "action")
    # The actions travel as one array value: each recording is called with each of them, as was asked for.
    held = actions.agg(F.array_sort(F.collect_list(F.struct("action_id", "prompt"))).alias("a"))
    asked = inputs.withColumn("a", F.explode(held.scalar())).select("meeting_id", "input", "a.*")
    answered = models.run_model(asked, ["prompt", "input"], model, "result_text")
    return answered.select("action_id", "meeting_id", F.when(F.col("result_text").isNull(), "failed").otherwise("completed").alias("status"), "result_text")


def write_protocols(meetings: DataFrame, segments: DataFrame, people: DataFrame, model: Callable[[str], str | None]) -> DataFrame:
    """``meetings`` with the protocols that the model wrote of completed ones; others keep what they have."""
    done = analytics.model_inputs(meetings.where("status = 'completed'"), segments, people, "protocol")
    answers = models.run_model(done, ["input"], model, "protocol_text").select("meeting_id", "protocol_text")
    return mutate.patch(meetings, answers, "meeting_id")


def extract_insights(insights: DataFrame, answers: DataFrame) -> DataFrame:
    """``insights`` with those of the answered recordings replaced by what ``answers(meeting_id, answer)`` hold."""
    new = chunks.insight_rows(answers)
    return mutate.remove(insights, answers, "meeting_id").unionByName(new, allowMissingColumns=True)


def edit_and_learn(segments: DataFrame, edits: DataFrame, meetings: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, vocabulary) after ``edits(meeting_id, ord, text)``: terms are learned against the original text.

    Edits of encrypted recordings change nothing and teach nothing; an edit repeated teaches again.
    """
    after = mutate.edit_texts(segments, edits, meetings)
    locked = meetings.where(F.col("is_encrypted").eqNullSafe(True)).select("meeting_id")
    old = segments.select("meeting_id", "ord", F.coalesce("original_text", "text").alias("old_text"))
    pairs = edits.join(locked, "meeting_id", "left_anti").select("meeting_id", "ord", F.col("text").alias("new_text")).join(old, ["meeting_id", "ord"])
    return after, vocabulary.merge_terms(entries, vocabulary.learn(pairs))


def remaining(segments: DataFrame, people: DataFrame) -> DataFrame:
    """Utterances left per speaker, zeros included."""
    n = segments.groupBy("meeting_id", "speaker_id").agg(F.count("*").alias("n"))
    return people.select("meeting_id", "speaker_id").join(n, ["meeting_id", "speaker_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def step_of(progress) -> Column:
    """Name of the active step at a progress in percent."""
    out = F.lit(STEPS[-1][0])
    for (name, _), (_, following) in reversed(list(zip(STEPS[:-1], STEPS[1:], strict=True))):
        out = F.when(X.col(progress) < following, name).otherwise(out)
    return out


# --- live recordings ----------------------------------------------------------------------------------


def get_or_create(people: DataFrame, heard: DataFrame) -> DataFrame:
    """``people`` with a new speaker for every label heard that has none; colours go on from those that exist.

    ``heard(meeting_id, label, ord)``; new speakers are created in order of first appearance.
    """
    first = heard.groupBy("meeting_id", "label").agg(F.min("ord").alias("ord")).join(people.select("meeting_id", "label"), ["meeting_id", "label"], "left_anti")
    have = people.groupBy("meeting_id").agg(F.count("*").alias("have"))
    place = F.row_number().over(Window.partitionBy("meeting_id").orderBy("ord", "label")) - 1
    new = first.join(have, "meeting_id", "left").withColumn("i", place + F.coalesce("have", F.lit(0)))
    palette = F.array(*map(F.lit, schemas.PALETTE))
    new = new.select("meeting_id", "label", speaker_key().alias("speaker_id"), F.col("label").alias("display_name"), F.element_at(palette, (F.col("i") % len(schemas.PALETTE) + 1).cast("int")).alias("color"))
    return people.unionByName(new, allowMissingColumns=True)


def live_duration(chunks: DataFrame) -> DataFrame:
    """Duration of a live recording so far: what was decoded of it, silence included."""
    return chunks.groupBy("recording").agg(F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("duration"))


def stopped(meetings: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(meetings, jobs) after text frames ``commands(meeting_id, body)``: a stop command starts finalizing, others and bad JSON do nothing."""
    stop = commands.where(F.get_json_object("body", "$.type") == "stop_recording").select("meeting_id").distinct()
    m = meetings.join(stop.withColumn("_s", F.lit(True)), "meeting_id", "left")
    m = m.withColumns({"status": F.when(F.col("_s"), "finalizing").otherwise(F.col("status")), "recording_status": F.when(F.col("_s"), "stopped").otherwise(F.col("recording_status"))}).drop("_s")
    return m, stop.join(meetings.select("meeting_id"), "meeting_id", "left_semi").select("meeting_id", F.lit("finalize_live").alias("job_type"), F.lit("pending").alias("status"))


def client_rows(messages: DataFrame) -> DataFrame:
    """What a live client shows: the last polish's rows in place of all before, and what came after it.

    ``messages(recording, arrival, kind, ...)``: kind ``live_segment`` adds a row, ``polish_complete`` rows of
    one arrival replace the list.
    """
    last = F.max(F.when(F.col("kind") == "polish_complete", F.col("arrival"))).over(Window.partitionBy("recording"))
    m = messages.where("kind in ('live_segment', 'polish_complete')").withColumn("_last", last)
    return m.where(F.col("_last").isNull() | (F.col("arrival") == F.col("_last")) | ((F.col("arrival") > F.col("_last")) & (F.col("kind") == "live_segment"))).drop("_last")
