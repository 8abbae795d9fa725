"""Queries over whole jobs: processing, new diarization, finalizing, polishing, failures; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance import schemas
from parlance.operators import jobs
from parlance.plans.catalogue import ALIGN_SQL, PROFILE_CTE
from parlance.plans.registry import query
from parlance.sources import views as V

COLOURS = "(['" + "', '".join(schemas.PALETTE) + "'])"


def aligned_sql(segments: str, turns: str) -> str:
    """The alignment over other tables of utterances and turns."""
    return ALIGN_SQL.replace("FROM seg s", f"FROM {segments} s").replace("JOIN diar d", f"JOIN {turns} d")


def found_sql(answers: str) -> str:
    """Speakers of ``aligned``: ``answers(meeting_id, label, name)``, then participants, colours, UNKNOWN."""
    return f""", lab AS (SELECT DISTINCT meeting_id, speaker AS label FROM aligned), named AS (SELECT meeting_id, label, name AS display_name, 'intro_llm' AS identified_by, CAST(0.8 AS DOUBLE) AS confidence FROM {answers}),
k AS (SELECT meeting_id, count(*) AS n FROM named GROUP BY 1),
rest AS (SELECT l.meeting_id, l.label, 'Participant ' || (row_number() OVER (PARTITION BY l.meeting_id ORDER BY l.label) + coalesce(k.n, 0)) AS display_name, NULL AS identified_by, CAST(NULL AS DOUBLE) AS confidence FROM lab l LEFT JOIN k USING (meeting_id) WHERE l.label <> 'UNKNOWN' AND NOT EXISTS (SELECT 1 FROM named n WHERE n.meeting_id = l.meeting_id AND n.label = l.label)),
every AS (SELECT * FROM named UNION ALL SELECT * FROM rest),
found AS (SELECT *, {COLOURS}[((row_number() OVER (PARTITION BY meeting_id ORDER BY label)) - 1) % 10 + 1] AS color FROM every UNION ALL SELECT meeting_id, label, 'Unknown', NULL, NULL, '#9ca3af' FROM lab WHERE label = 'UNKNOWN')"""


STATS_SQL = "SELECT f.meeting_id, f.label, display_name, identified_by, f.confidence, color, count(a.ord) AS segment_count, coalesce(sum(a.end_time - a.start_time), 0) AS total_speaking_time FROM {found} f LEFT JOIN aligned a ON a.meeting_id = f.meeting_id AND a.speaker = f.label GROUP BY ALL"
PEOPLE = ["meeting_id", "label", "display_name", "identified_by", "confidence", "color", "segment_count", "total_speaking_time"]


def _intros(spark, sf):
    k = F.col("meeting_id") % 3
    none = F.array().cast("array<string>")
    return V.meetings(spark, sf).select("meeting_id", F.when(k == 0, F.array(F.lit("Ann"))).otherwise(none).alias("names"), F.when(k == 1, 31.5).alias("intro_end_time"))


def _answers(spark, sf):
    """A name for every recording's second speaker, and one that no turn has."""
    m = V.meetings(spark, sf).select("meeting_id")
    row = lambda label, name, pos: F.struct(F.lit(label).alias("label"), F.concat(F.lit(name), "meeting_id").alias("name"), F.lit(pos).alias("pos"))
    return m.select("meeting_id", F.explode(F.array(row("SPEAKER_01", "Bo ", 0), row("SPEAKER_09", "Guest ", 1))).alias("a")).select("meeting_id", "a.*")


ANSWERS_SQL = "(SELECT meeting_id, label, name || meeting_id AS name FROM mtg, (VALUES ('SPEAKER_01', 'Bo '), ('SPEAKER_09', 'Guest ')) v(label, name) WHERE {where})"


def _voices(spark, sf):
    e = V.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    labels = V.speakers(spark, sf).crossJoin(F.broadcast(V.vectors(spark, sf))).select("meeting_id", "label", ((F.col("speaker_id") * 7 + 1) % F.col("vectors")).alias("vec_id"))
    return labels.join(e, "vec_id").select("meeting_id", "label", "embedding")


VOICES_SQL = """, longest AS (SELECT meeting_id, lab AS label FROM diar GROUP BY 1, 2 HAVING max(de - ds) >= 2),
probe AS (SELECT f.meeting_id, f.label, CAST(e.embedding AS DOUBLE[]) AS v FROM found f JOIN longest USING (meeting_id, label) JOIN spk USING (meeting_id, label) JOIN embeddings e ON e.vec_id = (spk.speaker_id * 7 + 1) % (SELECT max(vec_id) + 1 FROM embeddings) WHERE NOT coalesce(f.identified_by = 'intro_llm' AND f.confidence > 0.7, false) AND f.label <> 'UNKNOWN'),
hit AS (SELECT b.meeting_id, b.label, p.name, list_cosine_similarity(b.v, p.e) AS c FROM probe b, p QUALIFY row_number() OVER (PARTITION BY b.meeting_id, b.label ORDER BY c DESC, CAST(p.profile_id AS VARCHAR)) = 1),
voiced AS (SELECT f.meeting_id, f.label, CASE WHEN c >= 0.55 THEN h.name ELSE f.display_name END AS display_name, CASE WHEN c >= 0.55 THEN 'voice_profile' ELSE f.identified_by END AS identified_by, CASE WHEN c >= 0.55 THEN round_even(c, 3) ELSE f.confidence END AS confidence, f.color FROM found f LEFT JOIN hit h USING (meeting_id, label))"""


def _process(spark, sf):
    s = V.segments(spark, sf).select("meeting_id", "ord", "text", "start_time", "end_time", "confidence")
    return jobs.process(s, V.turns(spark, sf), _answers(spark, sf), _intros(spark, sf), _voices(spark, sf), V.profiles(spark, sf))


PROCESS_SQL = f", {PROFILE_CTE}" + ALIGN_SQL + found_sql(ANSWERS_SQL.format(where="meeting_id % 3 < 2")) + VOICES_SQL


@query(PROCESS_SQL + " " + STATS_SQL.format(found="voiced"))
def job_process_speakers(spark, sf):
    """The speakers that processing stores: introduction, participants, voices, colours, statistics."""
    return _process(spark, sf)[1].select(*PEOPLE)


@query(PROCESS_SQL + " SELECT a.meeting_id, a.ord, a.text, a.text AS original_text, a.start_time, a.end_time, a.confidence, false AS is_edited, v.meeting_id || ':' || v.label AS speaker_id FROM aligned a LEFT JOIN voiced v ON v.meeting_id = a.meeting_id AND v.label = a.speaker")
def job_process_segments(spark, sf):
    return _process(spark, sf)[0].select("meeting_id", "ord", "text", "original_text", "start_time", "end_time", "confidence", "is_edited", "speaker_id")


#: A second transcription and diarization: later times, other holes and numbers.
FRESH_SQL = """, heard AS (SELECT meeting_id, ord * 3 + 5 AS ord, CASE WHEN ord = 0 THEN 'My name is Bo. ' || text ELSE text END AS text, start_time + CAST(0.25 AS DOUBLE) * (ord % 8) AS start_time, end_time + CAST(0.125 AS DOUBLE) * (ord % 8) AS end_time, confidence FROM seg WHERE meeting_id % 2 = 0 OR ord > 0),
fresh AS (SELECT meeting_id, ord AS di, start_time AS ds, end_time + CAST(0.25 AS DOUBLE) AS de, 'SPEAKER_0' || (spk + ord // 7) % 3 AS lab FROM seg WHERE ord % 5 <> 2)"""
INTRO_SQL = r", asked AS (SELECT meeting_id FROM aligned GROUP BY 1 HAVING coalesce(regexp_matches(lower(string_agg(text, ' ' ORDER BY ord) FILTER (start_time < 120)), 'jag heter\s+[\p{L}\p{N}_]+|mitt namn [aä]r\s+[\p{L}\p{N}_]+|jag [aä]r\s+[\p{L}\p{N}_]+|my name is\s+[\p{L}\p{N}_]+|i am\s+[\p{L}\p{N}_]+|this is\s+[\p{L}\p{N}_]+|hej.{0,20}jag heter|hej.{0,20}mitt namn|hi.{0,20}my name is|hello.{0,20}i am'), false))"
AGAIN_SQL = FRESH_SQL + aligned_sql("heard", "fresh") + INTRO_SQL + found_sql(ANSWERS_SQL.format(where="meeting_id IN (SELECT meeting_id FROM asked)"))


def _again(spark, sf):
    s = V.segments(spark, sf)
    k = F.col("ord")
    heard = s.where((F.col("meeting_id") % 2 == 0) | (k > 0)).select("meeting_id", (k * 3 + 5).alias("ord"), F.when(k == 0, F.concat(F.lit("My name is Bo. "), "text")).otherwise(F.col("text")).alias("text"), (F.col("start_time") + 0.25 * (k % 8)).alias("start_time"), (F.col("end_time") + 0.125 * (k % 8)).alias("end_time"), "confidence")
    turns = s.where("ord % 5 <> 2").select("meeting_id", k.alias("di"), F.col("start_time").alias("ds"), (F.col("end_time") + 0.25).alias("de"), F.concat(F.lit("SPEAKER_0"), (F.col("spk") + F.floor(k / 7)) % 3).alias("lab"))
    return jobs.reprocess(heard, turns, _answers(spark, sf), s)


@query(AGAIN_SQL + """, hit AS (SELECT a.meeting_id, a.ord, e.text FROM aligned a JOIN seg e ON a.meeting_id = e.meeting_id AND e.is_edited AND abs(a.start_time - e.start_time) < 1.5 AND abs(a.end_time - e.end_time) < 1.5 QUALIFY row_number() OVER (PARTITION BY a.meeting_id, a.ord ORDER BY e.ord) = 1)
SELECT a.meeting_id, row_number() OVER (PARTITION BY a.meeting_id ORDER BY a.ord) - 1 AS ord, coalesce(h.text, a.text) AS text, a.text AS original_text, h.ord IS NOT NULL AS is_edited, f.meeting_id || ':' || f.label AS speaker_id FROM aligned a LEFT JOIN hit h USING (meeting_id, ord) LEFT JOIN found f ON f.meeting_id = a.meeting_id AND f.label = a.speaker""")
def job_rebuild_segments(spark, sf):
    """New diarization, identification and finalizing rebuild a recording: renumbered, edits kept."""
    return _again(spark, sf)[0].select("meeting_id", "ord", "text", "original_text", "is_edited", "speaker_id")


@query(AGAIN_SQL + " " + STATS_SQL.format(found="found"))
def job_rebuild_speakers(spark, sf):
    return _again(spark, sf)[1].select(*PEOPLE)


JOBS_SQL = """WITH j AS (SELECT o_orderkey AS job_id, o_custkey AS meeting_id, 'running' AS status, NULL AS error FROM orders WHERE o_orderkey % 7 < 2), m AS (SELECT c_custkey AS meeting_id, CASE c_custkey % 2 WHEN 0 THEN 'finalizing' ELSE 'recording' END AS status, 'stopped' AS recording_status FROM customer)"""


def _jobs(spark, sf):
    j = V.table(spark, sf, "orders").where("o_orderkey % 7 < 2").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("meeting_id"), F.lit("running").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("timestamp").alias("completed_at"))
    m = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("meeting_id"), F.when(F.col("c_custkey") % 2 == 0, "finalizing").otherwise("recording").alias("status"), F.lit("stopped").alias("recording_status"))
    return j, m, F.lit("2024-01-01").cast("timestamp")


@query(JOBS_SQL + " SELECT 'meeting' AS kind, meeting_id AS id, CASE WHEN meeting_id IN (SELECT meeting_id FROM j) THEN 'completed' ELSE status END AS status, CASE WHEN meeting_id IN (SELECT meeting_id FROM j) THEN 'complete' ELSE recording_status END AS detail FROM m UNION ALL SELECT 'job', job_id, 'completed', 'Done!' FROM j", views=False)
def job_finished(spark, sf):
    j, m, now = _jobs(spark, sf)
    m, j = jobs.finished(m, j, now, live=True)
    return m.select(F.lit("meeting").alias("kind"), F.col("meeting_id").alias("id"), "status", F.col("recording_status").alias("detail")).unionByName(j.select(F.lit("job").alias("kind"), F.col("job_id").alias("id"), "status", F.col("current_step").alias("detail")))


@query(JOBS_SQL + """, e AS (SELECT *, job_id % 7 = 1 AS bad FROM j) SELECT 'meeting' AS kind, CAST(meeting_id AS VARCHAR) AS id, CASE WHEN meeting_id IN (SELECT meeting_id FROM e WHERE bad) THEN 'failed' ELSE status END AS status, NULL AS detail FROM m
UNION ALL SELECT 'job', CAST(job_id AS VARCHAR), CASE WHEN bad THEN 'failed' ELSE status END, CASE WHEN bad THEN 'boom ' || job_id END FROM e UNION ALL SELECT 'message', 'meeting:' || meeting_id, 'error', '{"type":"error","error":"boom ' || job_id || '"}' FROM e WHERE bad""", views=False)
def job_failures(spark, sf):
    j, m, now = _jobs(spark, sf)
    m, j, told = jobs.failed(m, j, j.where("job_id % 7 = 1").select("job_id", F.concat(F.lit("boom "), "job_id").alias("error")), now)
    row = lambda df, kind, id_, status, detail: df.select(F.lit(kind).alias("kind"), F.col(id_).cast("string").alias("id"), status.alias("status"), detail.alias("detail"))
    out = row(m, "meeting", "meeting_id", F.col("status"), F.lit(None).cast("string")).unionByName(row(j, "job", "job_id", F.col("status"), F.col("error")))
    return out.unionByName(row(told, "message", "key", F.lit("error"), F.col("value")))


POLISH_SQL = """, cut AS (SELECT * FROM seg WHERE meeting_id % 5 <> 4 OR ord < 3), g AS (SELECT *, count(*) OVER (PARTITION BY meeting_id, speaker_id) AS n, min(ord) OVER (PARTITION BY meeting_id, speaker_id) AS f, (start_time + end_time) / 2 AS mid FROM cut),
best AS (SELECT a.meeting_id, a.ord, b.speaker_id AS t FROM g a JOIN g b ON a.meeting_id = b.meeting_id AND a.n < 2 AND b.n >= 2 AND b.speaker_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY a.meeting_id, a.ord ORDER BY abs(a.mid - b.mid), b.f, b.ord) = 1),
after AS (SELECT s.*, coalesce(b.t, s.speaker_id) AS sid FROM cut s LEFT JOIN best b USING (meeting_id, ord)),
stay AS (SELECT p.* FROM spk p WHERE NOT (EXISTS (SELECT 1 FROM g WHERE g.meeting_id = p.meeting_id AND g.speaker_id = p.speaker_id AND g.n < 2) AND NOT EXISTS (SELECT 1 FROM after a WHERE a.meeting_id = p.meeting_id AND a.sid = p.speaker_id)))"""


def _polish(spark, sf):
    s = V.segments(spark, sf).where("meeting_id % 5 <> 4 OR ord < 3")
    p = V.speakers(spark, sf).withColumns({"identified_by": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    answers = p.where("meeting_id % 2 = 0").select("meeting_id", "label", F.when(F.col("label") != "SPEAKER_02", F.concat(F.lit("Polished "), "speaker_id")).alias("name"), F.lit(0).alias("pos"))
    return jobs.polish(s, p, answers, F.lit(1))


@query(POLISH_SQL + """ SELECT p.meeting_id, p.label, CASE WHEN p.meeting_id % 2 = 0 AND label <> 'SPEAKER_02' THEN 'Polished ' || p.speaker_id ELSE display_name END AS display_name, CASE WHEN p.meeting_id % 2 = 0 AND label <> 'SPEAKER_02' THEN 'polish_llm' END AS identified_by, count(a.ord) AS segment_count, coalesce(sum(a.end_time - a.start_time), 0) AS total_speaking_time
FROM stay p LEFT JOIN after a ON a.meeting_id = p.meeting_id AND a.sid = p.speaker_id GROUP BY p.meeting_id, p.label, p.speaker_id, p.display_name""")
def job_polish_speakers(spark, sf):
    return _polish(spark, sf)[1].select("meeting_id", "label", "display_name", "identified_by", "segment_count", "total_speaking_time")


@query(POLISH_SQL + " SELECT meeting_id, ord, sid AS speaker_id FROM after")
def job_polish_segments(spark, sf):
    return _polish(spark, sf)[0].select("meeting_id", "ord", "speaker_id")


@query(POLISH_SQL + """ SELECT meeting_id, 1 AS "pass", count(*) AS speaker_count, (SELECT count(*) FROM spk q WHERE q.meeting_id = p.meeting_id AND q.meeting_id % 2 = 0 AND q.label <> 'SPEAKER_02') AS names_found, (SELECT count(*) FROM best b WHERE b.meeting_id = p.meeting_id) AS merged_segments FROM stay p GROUP BY 1""")
def job_polish_passes(spark, sf):
    return _polish(spark, sf)[2].select("meeting_id", "p.pass", "p.speaker_count", "p.names_found", "p.merged_segments")
