"""Whole jobs on small tables with the outcome written out, files, sinks and settings."""

import io
import wave
import zipfile

import pytest
from pyspark.sql import functions as F

from parlance.functions import learned, office
from parlance.operators import jobs, models, mutate, render
from parlance.sources import readers

HEARD = "meeting_id long, ord long, text string, start_time double, end_time double, confidence double"
TURNS = "meeting_id long, di long, ds double, de double, lab string"
PEOPLE = "meeting_id long, speaker_id string, label string, display_name string, color string"


def test_process_names_voices_and_statistics(spark):
    heard = spark.createDataFrame([(1, 4, "a", 0.0, 3.0, 0.5), (1, 7, "b", 3.0, 4.0, None), (1, 9, "c", 50.0, 52.0, 0.9), (2, 0, "d", 0.0, 1.0, 0.1)], HEARD)
    turns = spark.createDataFrame([(1, 0, 0.0, 3.0, "S0"), (1, 1, 3.0, 4.0, "S1"), (2, 0, 0.0, 5.0, "S0")], TURNS)
    answers = spark.createDataFrame([(1, "S0", "Ann", 0), (2, "S0", "Not asked", 0)], "meeting_id long, label string, name string, pos int")
    intros = spark.createDataFrame([(1, ["Ann"], None), (2, [], 0.0)], "meeting_id long, names array<string>, intro_end_time double")
    voices = spark.createDataFrame([(1, "S0", [1.0, 0.0]), (1, "S1", [1.0, 0.0]), (2, "S0", [0.9, 0.1])], "meeting_id long, label string, embedding array<double>")
    profiles = spark.createDataFrame([(1, "Eve", [1.0, 0.0])], "profile_id int, name string, embedding array<double>")
    segments, people = jobs.process(heard, turns, answers, intros, voices, profiles)
    got = {(r.meeting_id, r.label): r for r in people.collect()}
    # Ann is sure enough to stay, S1 spoke too shortly for a voice, recording 2 gets its participant's voice.
    assert {k: (r.display_name, r.identified_by) for k, r in got.items()} == {(1, "S0"): ("Ann", "intro_llm"), (1, "S1"): ("Participant 2", None), (1, "UNKNOWN"): ("Unknown", None), (2, "S0"): ("Eve", "voice_profile")}
    assert got[2, "S0"].confidence == 0.994 and (got[1, "S0"].segment_count, got[1, "S0"].total_speaking_time) == (1, 3.0)
    rows = segments.where("meeting_id = 1").orderBy("ord").collect()
    assert [(r.ord, r.speaker_id, r.original_text, r.is_edited) for r in rows] == [(0, "1:S0", "a", False), (1, "1:S1", "b", False), (2, "1:UNKNOWN", "c", False)]


def test_rebuild_keeps_edits_and_renumbers(spark):
    heard = spark.createDataFrame([(1, 10, "hello my name is x", 0.0, 2.0, 0.5), (1, 20, "b", 9.0, 10.0, 0.5)], HEARD)
    old = spark.createDataFrame([(1, 0, "edited", 1.0, 2.5, True), (1, 1, "no", 9.0, 10.0, False)], "meeting_id long, ord long, text string, start_time double, end_time double, is_edited boolean")
    turns = spark.createDataFrame([(1, 0, 0.0, 20.0, "S0")], TURNS)
    answers = spark.createDataFrame([(1, "S0", "Xe", 0)], "meeting_id long, label string, name string, pos int")
    segments, people = jobs.reprocess(heard, turns, answers, old)
    assert [(r.ord, r.text, r.original_text, r.is_edited) for r in segments.orderBy("ord").collect()] == [(0, "edited", "hello my name is x", True), (1, "b", "b", False)]
    assert [(r.display_name, r.segment_count) for r in people.collect()] == [("Xe", 2)]
    segments, people = jobs.reprocess(heard.where("ord = 20"), turns, answers, old)
    assert people.first().display_name == "Participant 1"  # no introduction, no names


def test_polish_merges_names_and_records(spark):
    seg = spark.createDataFrame([(1, 0, 0.0, 1.0, 10), (1, 1, 1.0, 2.0, 10), (1, 2, 2.0, 3.0, 11), (1, 3, 3.0, 4.0, None), (2, 0, 0.0, 1.0, 20)], "meeting_id long, ord long, start_time double, end_time double, speaker_id long")
    people = spark.createDataFrame([(1, 10, "A", None, 9, 9.0), (1, 11, "B", None, 9, 9.0), (1, 12, "C", None, 9, 9.0), (2, 20, "A", None, 0, 0.0), (3, 30, "A", None, 0, 0.0)], "meeting_id long, speaker_id long, label string, display_name string, segment_count long, total_speaking_time double")
    people = people.withColumns({"identified_by": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    answers = spark.createDataFrame([(1, "A", "Ann", 0), (1, "C", "", 1)], "meeting_id long, label string, name string, pos int")
    segments, after, passes = jobs.polish(seg, people, answers, F.lit(4))
    assert [r.speaker_id for r in segments.orderBy("meeting_id", "ord").collect()] == [10, 10, 10, 10, 20]
    got = {(r.meeting_id, r.speaker_id): (r.display_name, r.segment_count, r.total_speaking_time) for r in after.collect()}
    assert got == {(1, 10): ("Ann", 4, 4.0), (1, 12): (None, 0, 0.0), (2, 20): (None, 1, 1.0)}  # 11 lost its last, 12 had none, 3 was not heard
    p = {r.meeting_id: r.p for r in passes.collect()}
    assert (p[1]["pass"], p[1].speaker_count, p[1].names_found, p[1].merged_segments) == (4, 2, 1, 2) and p[2].merged_segments == 0
    m = mutate.append_polish(spark.createDataFrame([(1,), (3,)], "meeting_id long").withColumn("polish_history", F.lit(None).cast("array<struct<pass:long,duration_seconds:double,speaker_count:long,names_found:long,merged_segments:long,timestamp:timestamp>>")), passes)
    assert {r.meeting_id: r.polish_history and len(r.polish_history) for r in m.collect()} == {1: 1, 3: None}


def test_new_speakers_go_on_with_the_colours(spark):
    old = spark.createDataFrame([(1, "x", "Speaker 1", "Ann", "#1")], PEOPLE)
    heard = spark.createDataFrame([(1, "Speaker 1", 0), (1, "Speaker 3", 1), (1, "Speaker 2", 2), (2, "Speaker 1", 5)], "meeting_id long, label string, ord long")
    got = {(r.meeting_id, r.label): (r.display_name, r.color) for r in jobs.get_or_create(old, heard).collect()}
    assert got == {(1, "Speaker 1"): ("Ann", "#1"), (1, "Speaker 3"): ("Speaker 3", "#ec4899"), (1, "Speaker 2"): ("Speaker 2", "#10b981"), (2, "Speaker 1"): ("Speaker 1", "#6366f1")}
    again = jobs.get_or_create(jobs.get_or_create(old, heard), heard)
    assert again.count() == 4  # the same chunk twice makes nothing new


def test_files(spark):
    blocks = [("heading", 1, "T & <x>"), ("note", 0, "Duration: 1:00"), ("paragraph", 0, "a\nb \x01é " + "w" * 400)] + [("paragraph", 0, "many words " * 60)] * 40
    assert office.docx_text(office.docx(blocks))[:3] == ["T & <x>", "Duration: 1:00", "a\nb é " + "w" * 400]
    with zipfile.ZipFile(io.BytesIO(office.docx([]))) as z:
        assert z.testzip() is None and "[Content_Types].xml" in z.namelist()
    data = office.pdf(blocks)
    start = int(data.rsplit(b"startxref\n", 1)[1].split()[0])
    assert data[start:].startswith(b"xref") and data.count(b"/Type /Page ") > 3
    places = [int(x[:10]) for x in data[start:].splitlines()[3:-5]]
    assert all(data[p:].startswith(b"%d 0 obj" % n) for n, p in enumerate(places, 1))
    assert office.pdf([]).count(b"/Type /Page ") == 1
    shown = office.pdf_text(data)
    assert shown[:3] == ["T & <x>", "Duration: 1:00", "a"] and "".join(shown[3:9]).startswith("b \x01é" + "w" * 400)
    assert " ".join(shown).count("many words") == 2400
    assert office.pdf_text(office.pdf([("paragraph", 0, "a (b) \\ c\\) Ł")])) == ["a (b) \\ c\\) ?"] and office.pdf_text(office.pdf([])) == []
    with pytest.raises(ValueError):
        office.pdf_text(data.replace(b"2 0 obj", b"9 0 obj", 1))
    with wave.open(io.BytesIO(office.wav(b"\x01\x00" * 8))) as w:
        assert (w.getnchannels(), w.getframerate(), w.getnframes()) == (1, 16_000, 8)


def test_settings_listing_and_vectors(spark, tmp_path):
    spark.conf.set("parlance.live_chunk_seconds", "2")
    try:
        held = readers.settings(spark)
        assert held["live_chunk_seconds"] == 2.0 and held["profile_threshold"] == 0.55
    finally:
        spark.conf.unset("parlance.live_chunk_seconds")
    (tmp_path / "m1").mkdir()
    (tmp_path / "file").write_text("x")
    assert [r.name for r in readers.storage_folders(spark, str(tmp_path)).collect()] == ["m1"]
    v = spark.createDataFrame([(1, [1.0, -2.5]), (2, []), (3, None)], "k int, v array<float>").withColumn("b", readers.vector_blob("v"))
    assert [(r.v, r.w) for r in v.withColumn("w", readers.blob_vector("b")).orderBy("k").collect()] == [([1.0, -2.5], [1.0, -2.5]), ([], []), (None, None)]
    b = spark.createDataFrame([(bytearray(b"\x00\x00\x80\x3f\x01"),)], "b binary")
    assert b.select(readers.blob_vector("b").alias("v")).first().v == [1.0]


def test_action_result_files(spark):
    r = spark.createDataFrame([(1, "Sum", "T", "# One\n\n  \n#### four\nplain\n### "), (2, None, None, "x"), (3, "Sum", "T", ""), (4, "Sum", "T", None)], "result_id int, action_name string, title string, result_text string")
    got = [(b.result_id, b.kind, b.level, b.text) for b in render.action_file_blocks(r).orderBy("result_id", "block").collect()]
    assert got == [
        (1, "heading", 1, "Sum"), (1, "note", 0, "Meeting: T"), (1, "heading", 1, "One"), (1, "paragraph", 0, "#### four"), (1, "paragraph", 0, "plain"), (1, "heading", 3, ""),
        (2, "heading", 1, "Action"), (2, "note", 0, "Meeting: Meeting"), (2, "paragraph", 0, "x"),
    ]
    assert [b.content for b in render.action_document(r).orderBy("result_id").collect()][1:] == ["# Action\n\n**Meeting:** Meeting\n\n---\n\nx"]
    files = {f.result_id: f for f in office.document_files(render.action_file_blocks(r), "result_id").collect()}
    assert office.docx_text(bytes(files[1].docx)) == ["Sum", "Meeting: T", "One", "#### four", "plain", ""] == office.pdf_text(bytes(files[1].pdf))


def test_presets_and_settings_by_type(spark):
    p = spark.createDataFrame([("a", "llm"), ("b", "whisper"), ("c", None)], "id string, type string")
    assert [r.id for r in models.presets_of_type(p, "llm").collect()] == ["a"] and models.presets_of_type(p).count() == 3
    stored = spark.createDataFrame([(1, "live", "a"), (1, "actions", "b")], "owner int, task string, preset_id string")
    changes = spark.createDataFrame([(1, "live", "c"), (2, "live", "b"), (2, "nonsense", "b")], "owner int, task string, preset_id string")
    after = models.changed_assignments(stored, changes)
    assert sorted(tuple(r) for r in after.collect()) == [(1, "actions", "b"), (1, "live", "c"), (2, "live", "b")]
    assert [tuple(r) for r in models.without_presets(after, spark.createDataFrame([("b",), ("b",), (None,)], "id string")).collect()] == [(1, "live", "c")]
    s = spark.createDataFrame([(1, "LIVE_CHUNK_SECONDS", "2"), (1, "max_upload_bytes", "2.5e"), (1, "other", "x"), (2, None, None)], "owner int, name string, value string")
    got = {(r.owner, r.name): (r.value, r.valid) for r in readers.typed_settings(s).collect()}
    assert len(got) == 2 * len(readers.SETTINGS)
    assert got[1, "live_chunk_seconds"] == ("2.0", True) and got[1, "max_upload_bytes"] == (None, False) and got[2, "live_chunk_seconds"] == ("4.0", True)


def test_tokens_and_passwords(spark):
    key = learned.recording_key("pw", b"s" * 16, rounds=10)
    t = spark.range(1).select(learned.verify_token(key).alias("t"), F.lit("nonsense").alias("n"), F.lit(None).cast("string").alias("z"))
    other = learned.recording_key("pw2", b"s" * 16, rounds=10)
    row = t.select(learned.opens("t", key), learned.opens("t", other), learned.opens("n", key), learned.opens("z", key)).first()
    assert tuple(row) == (True, False, False, False)
    p = spark.createDataFrame([("abcd", "abcd"), ("abc", "abc"), ("abcd", "abce"), (None, "abcd")], "a string, b string")
    assert [r.ok for r in p.select(learned.acceptable_password("a", "b").alias("ok")).collect()] == [True, False, False, False]
