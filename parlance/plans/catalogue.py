"""Query catalogue: the main queries; the other modules of this folder add theirs (see the end)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parlance.functions import exprs as X
from parlance.functions import learned
from parlance.operators import align, analytics, chunks, mutate, render, search, speakers, vocabulary
from parlance.plans.registry import QUERIES, SQL, query  # noqa: F401
from parlance.sources import views as V
from parlance.streaming import live

TERM = "the"


ALIGN_SQL = """, pair AS (
  SELECT s.meeting_id, s.ord, s.start_time, s.end_time, d.di, d.lab, d.ds, d.de, greatest(0, least(s.end_time, d.de) - greatest(s.start_time, d.ds)) AS ov, (s.start_time + s.end_time) / 2 AS mid
  FROM seg s JOIN diar d USING (meeting_id)
), most AS (
  SELECT meeting_id, ord, lab FROM pair WHERE ov > 0 QUALIFY row_number() OVER (PARTITION BY meeting_id, ord ORDER BY ov DESC, di) = 1
), held AS (
  SELECT meeting_id, ord, lab FROM pair WHERE ds <= mid AND mid <= de QUALIFY row_number() OVER (PARTITION BY meeting_id, ord ORDER BY di) = 1
), aligned AS (
  SELECT s.meeting_id, s.ord, s.text, s.start_time, s.end_time, s.confidence, coalesce(m.lab, h.lab, 'UNKNOWN') AS speaker
  FROM seg s LEFT JOIN most m USING (meeting_id, ord) LEFT JOIN held h USING (meeting_id, ord)
)"""


def _aligned(spark, sf):
    return align.align(V.segments(spark, sf).select("meeting_id", "ord", "text", "start_time", "end_time", "confidence"), V.turns(spark, sf))


# --- alignment and joins ----------------------------------------------------------------------------


@query(ALIGN_SQL + " SELECT meeting_id, ord, start_time, end_time, speaker, confidence FROM aligned")
def align_segments(spark, sf):
    return _aligned(spark, sf).select("meeting_id", "ord", "start_time", "end_time", "speaker", "confidence")


@query(ALIGN_SQL + " SELECT meeting_id, speaker, count(*) AS segment_count, sum(end_time - start_time) AS total_speaking_time FROM aligned GROUP BY 1, 2")
def speaker_stats(spark, sf):
    return speakers.speaker_stats(_aligned(spark, sf), "speaker")


@query("""SELECT s.meeting_id, s.ord, s.text, s.speaker_id, coalesce(p.display_name, p.label, 'Unknown') AS speaker_name FROM seg s LEFT JOIN spk p USING (meeting_id, speaker_id)""")
def segments_with_speaker(spark, sf):
    return analytics.with_speaker(V.segments(spark, sf), V.speakers(spark, sf)).select("meeting_id", "ord", "text", "speaker_id", "speaker_name")


@query(""", g AS (SELECT *, count(*) OVER (PARTITION BY meeting_id, speaker_id) AS n, min(ord) OVER (PARTITION BY meeting_id, speaker_id) AS f, (start_time + end_time) / 2 AS mid FROM seg),
best AS (SELECT a.meeting_id, a.ord, b.speaker_id AS t FROM g a JOIN g b ON a.meeting_id = b.meeting_id AND a.n < 2 AND b.n >= 2
  QUALIFY row_number() OVER (PARTITION BY a.meeting_id, a.ord ORDER BY abs(a.mid - b.mid), b.f, b.ord) = 1)
SELECT s.meeting_id, s.ord, coalesce(best.t, s.speaker_id) AS new_speaker_id FROM seg s LEFT JOIN best USING (meeting_id, ord)""")
def nearest_reassign(spark, sf):
    return align.nearest_reassign(V.segments(spark, sf)).select("meeting_id", "ord", "new_speaker_id")


def _drifted(spark, sf):
    s = V.segments(spark, sf)
    return s.withColumns({"start_time": F.col("start_time") + 0.25 * (F.col("ord") % 8), "end_time": F.col("end_time") + 0.125 * (F.col("ord") % 8), "text": F.concat(F.lit("new "), "ord")})


@query(""", fresh AS (SELECT meeting_id, ord, start_time + CAST(0.25 AS DOUBLE) * (ord % 8) AS start_time, end_time + CAST(0.125 AS DOUBLE) * (ord % 8) AS end_time, 'new ' || ord AS text FROM seg),
hit AS (SELECT n.meeting_id, n.ord, e.text FROM fresh n JOIN seg e ON n.meeting_id = e.meeting_id AND e.is_edited AND abs(n.start_time - e.start_time) < 1.5 AND abs(n.end_time - e.end_time) < 1.5
  QUALIFY row_number() OVER (PARTITION BY n.meeting_id, n.ord ORDER BY e.ord) = 1)
SELECT n.meeting_id, n.ord, coalesce(h.text, n.text) AS text, n.text AS original_text, h.ord IS NOT NULL AS is_edited FROM fresh n LEFT JOIN hit h USING (meeting_id, ord)""")
def edit_preserve(spark, sf):
    return align.preserve_edits(_drifted(spark, sf), V.segments(spark, sf)).select("meeting_id", "ord", "text", "original_text", "is_edited")


@query(""", p AS (SELECT meeting_id, ord * CAST(7.5 AS DOUBLE) AS t FROM seg) SELECT p.meeting_id, p.t, min(s.ord) AS ord FROM p LEFT JOIN seg s ON s.meeting_id = p.meeting_id AND s.start_time <= p.t AND p.t < s.end_time GROUP BY 1, 2""")
def playback_position(spark, sf):
    return align.at_position(V.segments(spark, sf), V.segments(spark, sf).select("meeting_id", (F.col("ord") * 7.5).alias("t")))


PROFILE_CTE = """p AS (SELECT label AS profile_id, 'Voice ' || label AS name, list(x ORDER BY i) AS e FROM (
  SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) r(i) WHERE vec_id % 2 = 0 GROUP BY label, i) GROUP BY label)"""
PROFILE_SQL = "WITH " + PROFILE_CTE


@query(PROFILE_SQL + """, s AS (SELECT v.vec_id, p.name, p.profile_id, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), p.e) AS c FROM embeddings v, p WHERE v.vec_id % 2 = 1),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, CAST(profile_id AS VARCHAR)) = 1)
SELECT vec_id, CASE WHEN c >= 0.55 THEN name END AS profile, CASE WHEN c >= 0.55 THEN round(c, 6) END AS similarity FROM b""", views=False)
def profile_match(spark, sf):
    return speakers.match_profiles(V.probes(spark, sf), V.profiles(spark, sf)).select("vec_id", "profile", F.round("similarity", 6).alias("similarity"))


@query(PROFILE_SQL + """, n AS (SELECT 'Voice ' || vec_id AS name, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)
SELECT coalesce(p.name, n.name) AS name, CASE WHEN p.e IS NULL THEN 1 WHEN n.x IS NULL THEN 3 ELSE 4 END::DOUBLE AS sample_count,
  round(list_sum(list_transform(range(1, 65), lambda i: i * CASE WHEN p.e IS NULL THEN n.x[i] WHEN n.x IS NULL THEN p.e[i] ELSE (p.e[i] * 3 + n.x[i]) / 4 END)), 6) AS digest FROM p FULL JOIN n ON p.name = n.name""", views=False)
def profile_running_mean(spark, sf):
    """Every vector as a voice: known names take the running mean. The digest weighs all components."""
    new = V.table(spark, sf, "embeddings").select(F.concat(F.lit("Voice "), "vec_id").alias("name"), F.col("embedding").cast("array<double>").alias("embedding"))
    old = V.profiles(spark, sf).withColumn("sample_count", F.lit(3.0))
    digest = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return speakers.profile_update(old, new).select("name", "sample_count", F.round(digest, 6).alias("digest"))


# --- aggregates ---------------------------------------------------------------------------------------


@query(""" SELECT m.meeting_id, m.title, m.created_at, coalesce(a.n, 0) AS speaker_count, coalesce(b.n, 0) AS segment_count FROM mtg m
LEFT JOIN (SELECT meeting_id, count(*) AS n FROM spk GROUP BY 1) a USING (meeting_id) LEFT JOIN (SELECT meeting_id, count(*) AS n FROM seg GROUP BY 1) b USING (meeting_id)""")
def list_meetings(spark, sf):
    out = analytics.list_meetings(V.meetings(spark, sf), V.speakers(spark, sf), V.segments(spark, sf))
    return out.select("meeting_id", "title", F.col("created_at").cast("timestamp_ntz").alias("created_at"), "speaker_count", "segment_count")


@query("""SELECT o_orderkey AS meeting_id, coalesce(a.n, 0) AS speaker_count, coalesce(b.n, 0) AS segment_count FROM orders
LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) a ON a.l_orderkey = o_orderkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) b ON b.l_orderkey = o_orderkey""", views=False)
def list_meetings_at_scale(spark, sf):
    """``list_meetings`` over orders as recordings, their lines as utterances and suppliers as speakers."""
    o = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("meeting_id"), F.col("o_orderdate").alias("created_at"))
    l = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("meeting_id"), "l_suppkey")
    return analytics.list_meetings(o, l.distinct(), l).select("meeting_id", "speaker_count", "segment_count")


ANALYTICS_SQL = """, t AS (SELECT s.*, sum(total_speaking_time) OVER (PARTITION BY s.meeting_id) AS all_t, m.duration FROM spk s JOIN mtg m USING (meeting_id)),
a AS (SELECT t.meeting_id, t.speaker_id, coalesce(display_name, label) AS name, round_even(total_speaking_time, 1) AS speaking_time, segment_count,
  round_even(CASE WHEN all_t > 0 THEN total_speaking_time / all_t * 100 ELSE 0 END, 1) AS percentage, round_even(duration, 1) AS total_duration, round_even(all_t, 1) AS total_speaking_time,
  round_even(greatest(0, (duration - all_t) / duration * 100), 1) AS silence_percentage FROM t)
SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY speaking_time DESC, speaker_id) AS position FROM a"""


@query(ANALYTICS_SQL)
def meeting_analytics(spark, sf):
    return analytics.meeting_analytics(V.meetings(spark, sf), V.speakers(spark, sf), V.segments(spark, sf))


@query(ANALYTICS_SQL)
def meeting_analytics_recomputed(spark, sf):
    return analytics.meeting_analytics(V.meetings(spark, sf), V.speakers(spark, sf), V.segments(spark, sf), recompute=True)


@query("""SELECT p.meeting_id, p.speaker_id, count(s.ord) AS spans, coalesce(string_agg(CAST(CAST(s.start_time * 16 AS BIGINT) AS VARCHAR), ',' ORDER BY s.ord), '') AS starts FROM spk p LEFT JOIN seg s USING (meeting_id, speaker_id) GROUP BY 1, 2""")
def speaker_timelines(spark, sf):
    t = analytics.timelines(V.speakers(spark, sf), V.segments(spark, sf))
    return t.select("meeting_id", "speaker_id", F.size("timeline").cast("long").alias("spans"), F.array_join(F.transform("timeline", lambda x: (x["start"] * 16).cast("long").cast("string")), ",").alias("starts"))


@query("SELECT s.meeting_id, s.ord, round(start_time / duration * 100, 6) AS \"left\", round(greatest(0.5, (end_time - start_time) / duration * 100), 6) AS width FROM seg s JOIN mtg m USING (meeting_id)")
def timeline_bars(spark, sf):
    return analytics.timeline_bars(V.meetings(spark, sf), V.segments(spark, sf)).select("meeting_id", "ord", F.round("left", 6).alias("left"), F.round("width", 6).alias("width"))


@query("SELECT s.meeting_id, s.speaker_id, min(ord) AS first_ord, arg_min(coalesce(display_name, label), ord) AS name, sum(end_time - start_time) AS seconds, count(*) AS utterances FROM seg s JOIN spk p USING (meeting_id, speaker_id) GROUP BY 1, 2")
def live_summary(spark, sf):
    return analytics.live_summary(V.segments(spark, sf), V.speakers(spark, sf))


@query("""SELECT meeting_id, speaker_id, n, CASE WHEN length(t) > 800 THEN substring(t, 1, 800) || '...' ELSE t END AS text FROM (SELECT meeting_id, speaker_id, count(*) AS n, string_agg(text, ' ' ORDER BY ord) AS t FROM seg GROUP BY 1, 2)""")
def speaker_texts(spark, sf):
    return analytics.speaker_texts(V.segments(spark, sf))


@query("""SELECT meeting_id, CASE WHEN length(t) > 15000 THEN substring(t, 1, 15000) || chr(10) || chr(10) || '[...transcript truncated...]' ELSE t END AS transcript FROM (
SELECT s.meeting_id, string_agg('[' || CAST(floor(start_time / 60) AS BIGINT) || ':' || lpad(CAST(CAST(floor(start_time) AS BIGINT) % 60 AS VARCHAR), 2, '0') || '] [' || coalesce(display_name, label, 'Unknown') || ']: ' || text, chr(10) ORDER BY ord) AS t
FROM seg s LEFT JOIN spk USING (meeting_id, speaker_id) GROUP BY 1)""")
def transcript_text(spark, sf):
    return analytics.transcript_text(V.segments(spark, sf), V.speakers(spark, sf))


@query(r"""SELECT meeting_id, coalesce(regexp_matches(lower(string_agg(text, ' ' ORDER BY ord) FILTER (start_time < 120)), 'jag heter\s+[\p{L}\p{N}_]+|mitt namn [aä]r\s+[\p{L}\p{N}_]+|jag [aä]r\s+[\p{L}\p{N}_]+|my name is\s+[\p{L}\p{N}_]+|i am\s+[\p{L}\p{N}_]+|this is\s+[\p{L}\p{N}_]+|hej.{0,20}jag heter|hej.{0,20}mitt namn|hi.{0,20}my name is|hello.{0,20}i am'), false) AS has_intro FROM seg GROUP BY 1""")
def intro_test(spark, sf):
    return analytics.has_intro(V.segments(spark, sf))


# --- sequence operators -------------------------------------------------------------------------------


@query(""", r AS (SELECT *, CASE WHEN ord = min(ord) OVER (PARTITION BY meeting_id) OR speaker_id IS DISTINCT FROM lag(speaker_id) OVER (PARTITION BY meeting_id ORDER BY ord) THEN 1 ELSE 0 END AS c FROM seg),
g AS (SELECT *, sum(c) OVER (PARTITION BY meeting_id ORDER BY ord) AS run FROM r)
SELECT meeting_id, CAST(run AS BIGINT) AS run, any_value(speaker_id) AS speaker_id, min(ord) AS first_ord, max(ord) AS last_ord, count(*) AS n, min(start_time) AS start_time, max(end_time) AS end_time FROM g GROUP BY 1, 2""")
def run_groups(spark, sf):
    return chunks.run_groups(V.segments(spark, sf))


CHUNK_SQL = """, s AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY ord) AS rn, first_value(start_time) OVER (PARTITION BY meeting_id ORDER BY ord) AS f FROM seg),
said AS (SELECT meeting_id, ord, trim(text) AS text, start_time, end_time, f, row_number() OVER (PARTITION BY meeting_id ORDER BY ord) AS k FROM s WHERE trim(text) <> ''),
r AS (SELECT meeting_id, k, 0 AS chunk, f AS a FROM said WHERE k = 1 UNION ALL
  SELECT x.meeting_id, x.k, CASE WHEN x.start_time - r.a >= 30 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN x.start_time - r.a >= 30 THEN x.start_time ELSE r.a END FROM r JOIN said x ON x.meeting_id = r.meeting_id AND x.k = r.k + 1)
SELECT r.meeting_id, r.chunk, string_agg(x.text, ' ' ORDER BY x.k) AS text, min(r.a) AS start_time, max(x.end_time) AS end_time FROM r JOIN said x USING (meeting_id, k) GROUP BY 1, 2"""


@query(CHUNK_SQL)
def time_chunks(spark, sf):
    return chunks.time_chunks(V.segments(spark, sf))


@query(CHUNK_SQL)
def time_chunks_joined(spark, sf):
    return chunks.time_chunks_joined(V.segments(spark, sf))


@query(""", l AS (SELECT meeting_id % 3 AS rec, meeting_id * 1000 + ord AS ord, text, dur FROM (SELECT *, end_time - start_time AS dur FROM seg)),
t AS (SELECT *, coalesce(sum(dur + 0.5) OVER (PARTITION BY rec ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM l),
said AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY ord) AS k FROM t WHERE trim(text) <> ''),
r AS (SELECT rec, CAST(0 AS BIGINT) AS chunk, min(a) AS a FROM t GROUP BY rec HAVING rec IN (SELECT rec FROM said) UNION ALL SELECT r.rec, r.chunk + 1, min(x.a) FROM r JOIN said x ON x.rec = r.rec AND x.k > 1 AND x.a - r.a >= 30 GROUP BY r.rec, r.chunk),
b AS (SELECT *, lead(a) OVER (PARTITION BY rec ORDER BY chunk) AS b FROM r)
SELECT b.rec AS meeting_id, CAST(b.chunk AS INTEGER) AS chunk, md5(string_agg(trim(x.text), ' ' ORDER BY x.ord)) AS text, min(b.a) AS start_time, max(x.a + x.dur) AS end_time FROM b JOIN said x ON x.rec = b.rec AND (x.k = 1 AND b.chunk = 0 OR x.k > 1 AND x.a >= b.a AND (b.b IS NULL OR x.a < b.b)) GROUP BY 1, 2""")
def long_recordings(spark, sf):
    """Chunks of three recordings that hold every conversation, one after the other."""
    w = Window.partitionBy("rec").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    s = V.segments(spark, sf).select((F.col("meeting_id") % 3).alias("rec"), (F.col("meeting_id") * 1000 + F.col("ord")).alias("ord"), "text", (F.col("end_time") - F.col("start_time")).alias("dur"))
    s = s.withColumn("start_time", F.coalesce(F.sum(F.col("dur") + 0.5).over(w), F.lit(0.0)))
    s = s.select(F.col("rec").alias("meeting_id"), "ord", "text", "start_time", (F.col("start_time") + F.col("dur")).alias("end_time"))
    return chunks.time_chunks_joined(s).withColumn("text", F.md5("text"))


@query(""", p AS (SELECT *, coalesce(sum(end_time - start_time) OVER (PARTITION BY meeting_id, speaker_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM seg WHERE speaker_id IS NOT NULL)
SELECT meeting_id, speaker_id, ord, start_time, least(end_time - start_time, 30 - before) AS clip FROM p WHERE before < 30""")
def clip_budget(spark, sf):
    return speakers.clip_budget(V.segments(spark, sf))


@query("""SELECT user_id AS recording, event_id AS arrival, coalesce(sum(4.0::DOUBLE) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk_start FROM events""", views=False)
def audio_clock(spark, sf):
    return chunks.clock(V.live_chunks(spark, sf)).select("recording", "arrival", "chunk_start")


@query(r""", w AS (SELECT meeting_id, ord, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '') AS w FROM seg),
p AS (SELECT a.meeting_id, a.ord, flatten(list(b.w ORDER BY b.ord)) AS said FROM w a JOIN w b ON a.meeting_id = b.meeting_id AND b.ord < a.ord GROUP BY 1, 2)
SELECT w.meeting_id, w.ord, CASE WHEN len(said) > 0 THEN array_to_string(said[-30:], ' ') END AS prompt FROM w LEFT JOIN p USING (meeting_id, ord)""")
def rolling_prompt(spark, sf):
    return chunks.rolling_prompt(V.segments(spark, sf))


NAMED_SQL = """, lab AS (SELECT DISTINCT meeting_id, speaker AS label FROM aligned), named AS (SELECT meeting_id, label, 'Person ' || label AS display_name, 'intro_llm' AS identified_by, CAST(0.8 AS DOUBLE) AS confidence FROM lab WHERE label = 'SPEAKER_01'),
k AS (SELECT meeting_id, count(*) AS n FROM named GROUP BY 1),
rest AS (SELECT l.meeting_id, l.label, 'Participant ' || (row_number() OVER (PARTITION BY l.meeting_id ORDER BY l.label) + coalesce(k.n, 0)) AS display_name, NULL AS identified_by, NULL AS confidence FROM lab l LEFT JOIN k USING (meeting_id) WHERE l.label NOT IN ('UNKNOWN', 'SPEAKER_01')),
e AS (SELECT * FROM named UNION ALL SELECT * FROM rest)
SELECT *, (['#6366f1', '#ec4899', '#10b981', '#f59e0b', '#3b82f6', '#ef4444', '#8b5cf6', '#14b8a6', '#f97316', '#06b6d4'])[((row_number() OVER (PARTITION BY meeting_id ORDER BY label)) - 1) % 10 + 1] AS color FROM e
UNION ALL SELECT meeting_id, label, 'Unknown', NULL, NULL, '#9ca3af' FROM lab WHERE label = 'UNKNOWN'"""


@query(ALIGN_SQL + NAMED_SQL)
def fallback_names(spark, sf):
    labels = _aligned(spark, sf).select("meeting_id", F.col("speaker").alias("label")).distinct()
    answers = labels.where("label = 'SPEAKER_01'").select("meeting_id", "label", F.concat(F.lit("Person "), "label").alias("name"), F.lit(0).alias("pos"))
    return speakers.name_speakers(labels, speakers.intro_names(answers))


@query(""", m AS (SELECT meeting_id, meeting_id * 10 + 1 AS src, meeting_id * 10 AS dst FROM mtg WHERE meeting_id * 10 + 1 IN (SELECT speaker_id FROM spk)), s AS (SELECT seg.*, CASE WHEN seg.speaker_id = m.src THEN m.dst ELSE seg.speaker_id END AS sid FROM seg LEFT JOIN m USING (meeting_id))
SELECT p.meeting_id, p.speaker_id, CASE WHEN m.dst = p.speaker_id THEN (SELECT count(*) FROM s WHERE s.meeting_id = p.meeting_id AND s.sid = p.speaker_id) ELSE p.segment_count END AS segment_count,
  CASE WHEN m.dst = p.speaker_id THEN (SELECT coalesce(sum(s.end_time - s.start_time), 0) FROM s WHERE s.meeting_id = p.meeting_id AND s.sid = p.speaker_id) ELSE p.total_speaking_time END AS total_speaking_time
FROM spk p LEFT JOIN m USING (meeting_id) WHERE m.src IS NULL OR p.speaker_id <> m.src""")
def merge_speakers(spark, sf):
    m = V.meetings(spark, sf).select("meeting_id", (F.col("meeting_id") * 10 + 1).alias("source_id"), (F.col("meeting_id") * 10).alias("target_id"))
    return speakers.merge_speakers(V.speakers(spark, sf), V.segments(spark, sf), m)[0].select("meeting_id", "speaker_id", "segment_count", "total_speaking_time")


# --- search and vocabulary ------------------------------------------------------------------------------

SEARCH_SQL = rf""", w AS (SELECT *, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '') AS w FROM seg),
h AS (SELECT *, CASE WHEN list_contains(w, '{TERM}') THEN CAST(len(list_filter(w, lambda x: x = '{TERM}')) AS DOUBLE) / len(w) ELSE 0 END AS rank FROM w WHERE list_contains(w, '{TERM}') OR text ILIKE '%{TERM}%'),
hits AS (SELECT h.meeting_id, m.title, h.ord, h.start_time, h.end_time, h.text, p.display_name AS speaker_name, h.rank, m.created_at FROM h JOIN mtg m USING (meeting_id) LEFT JOIN spk p USING (meeting_id, speaker_id)
  ORDER BY h.rank DESC, m.created_at DESC, h.meeting_id, h.ord LIMIT 100)"""


def _hits(spark, sf):
    return search.search(V.segments(spark, sf), V.meetings(spark, sf), V.speakers(spark, sf), TERM)


@query(SEARCH_SQL + " SELECT meeting_id, title, ord, text, speaker_name, round(rank, 9) AS rank FROM hits")
def search_segments(spark, sf):
    return _hits(spark, sf).select("meeting_id", "title", "ord", "text", "speaker_name", F.round("rank", 9).alias("rank"))


@query(SEARCH_SQL + " SELECT meeting_id, count(*) AS hits, string_agg(CAST(ord AS VARCHAR), ',' ORDER BY rank DESC, ord) AS ords FROM hits GROUP BY 1")
def search_grouped(spark, sf):
    return search.grouped(_hits(spark, sf)).select("meeting_id", F.size("segments").cast("long").alias("hits"), F.array_join(F.transform("segments", lambda s: s["ord"].cast("string")), ",").alias("ords"))


@query(SEARCH_SQL + " SELECT meeting_id, ord, row_number() OVER (PARTITION BY meeting_id ORDER BY rank DESC, ord) AS place FROM hits QUALIFY place <= 5")
def search_top5(spark, sf):
    return search.top_per_meeting(_hits(spark, sf)).select("meeting_id", "ord", F.col("place").cast("long").alias("place"))


@query(SEARCH_SQL + " SELECT count(*) AS hits, count(DISTINCT meeting_id) AS meetings FROM hits")
def search_totals(spark, sf):
    return search.totals(_hits(spark, sf))


def _terms(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", F.explode(X.tokens("text")).alias("term"))
    return d.groupBy("term").agg(F.count("*").alias("frequency"), F.min("doc_id").alias("source_meeting_id"))


TERM_SQL = r"""WITH t AS (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '')) AS term FROM documents), v AS (SELECT term, count(*) AS frequency FROM t GROUP BY 1)"""


@query(TERM_SQL + " SELECT term, frequency FROM v ORDER BY frequency DESC, term LIMIT 200", views=False)
def vocab_top(spark, sf):
    return vocabulary.top_terms(_terms(spark, sf)).select("term", "frequency")


@query(TERM_SQL + " SELECT string_agg(term, ', ' ORDER BY frequency DESC, term) AS text FROM (SELECT * FROM v WHERE frequency >= 2 ORDER BY frequency DESC, term LIMIT 50)", views=False)
def vocab_suggest(spark, sf):
    return vocabulary.suggested(_terms(spark, sf))


# --- renderers ------------------------------------------------------------------------------------------

NAME_SQL = """, n AS (SELECT s.*, coalesce(p.display_name, p.label, 'Unknown') AS name FROM seg s LEFT JOIN spk p USING (meeting_id, speaker_id)),
x AS (SELECT *, row_number() OVER w AS k, row_number() OVER w = 1 OR name <> lag(name) OVER w AS turn, CAST(floor(start_time) AS BIGINT) AS si, CAST(floor(end_time) AS BIGINT) AS ei FROM n WINDOW w AS (PARTITION BY meeting_id ORDER BY ord))"""


def _clock_sql(t: str, i: str, sep: str) -> str:
    two = lambda e: f"lpad(CAST({e} AS VARCHAR), 2, '0')"
    return f"{two(f'{i} // 3600')} || ':' || {two(f'({i} % 3600) // 60')} || ':' || {two(f'{i} % 60')} || '{sep}' || lpad(CAST(CAST(floor(({t} - {i}) * 1000) AS BIGINT) AS VARCHAR), 3, '0')"


SHORT_SQL = "CASE WHEN {i} >= 3600 THEN ({i} // 3600) || ':' || lpad(CAST(({i} % 3600) // 60 AS VARCHAR), 2, '0') ELSE CAST(({i} % 3600) // 60 AS VARCHAR) END || ':' || lpad(CAST({i} % 60 AS VARCHAR), 2, '0')"


@query(NAME_SQL + f" SELECT meeting_id, chr(65279) || string_agg(k || chr(10) || {_clock_sql('start_time', 'si', ',')} || ' --> ' || {_clock_sql('end_time', 'ei', ',')} || chr(10) || '[' || name || '] ' || text || chr(10), chr(10) ORDER BY ord) AS content FROM x GROUP BY 1")
def export_srt(spark, sf):
    return render.srt(V.segments(spark, sf), V.speakers(spark, sf))


@query(NAME_SQL + f" SELECT meeting_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({_clock_sql('start_time', 'si', '.')} || ' --> ' || {_clock_sql('end_time', 'ei', '.')} || chr(10) || '<v ' || name || '>' || text || chr(10), chr(10) ORDER BY ord) AS content FROM x GROUP BY 1")
def export_vtt(spark, sf):
    return render.vtt(V.segments(spark, sf), V.speakers(spark, sf))


@query(NAME_SQL + " SELECT meeting_id, string_agg(CASE WHEN turn THEN CASE WHEN k > 1 THEN chr(10) ELSE '' END || name || ':' || chr(10) ELSE '' END || '  ' || text, chr(10) ORDER BY ord) AS content FROM x GROUP BY 1")
def export_txt(spark, sf):
    return render.txt(V.segments(spark, sf), V.speakers(spark, sf))


@query(NAME_SQL + f""", b AS (SELECT meeting_id, string_agg(CASE WHEN turn THEN chr(10) || '### ' || name || ' [' || {SHORT_SQL.format(i='si')} || ']' || chr(10) || chr(10) ELSE '' END || text, chr(10) ORDER BY ord) AS body FROM x GROUP BY 1),
d AS (SELECT *, CAST(floor(duration) AS BIGINT) AS i FROM mtg)
SELECT meeting_id, '# ' || title || chr(10) || chr(10) || '**Duration:** ' || {SHORT_SQL.format(i='i')} || chr(10) || chr(10) || body AS content FROM d JOIN b USING (meeting_id)""")
def export_md(spark, sf):
    return render.markdown(V.meetings(spark, sf), V.segments(spark, sf), V.speakers(spark, sf))


@query(NAME_SQL + f""", d AS (SELECT *, CAST(floor(duration) AS BIGINT) AS i FROM mtg), e AS (
SELECT meeting_id, -2 AS ord, 0 AS k, 'heading' AS kind, 1 AS level, title AS text FROM mtg UNION ALL SELECT meeting_id, -1, 0, 'note', 0, 'Duration: ' || {SHORT_SQL.format(i='i')} FROM d
UNION ALL SELECT meeting_id, ord, 0, 'heading', 3, name || ' [' || {SHORT_SQL.format(i='si')} || ']' FROM x WHERE turn UNION ALL SELECT meeting_id, ord, 1, 'paragraph', 0, text FROM x)
SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY ord, k) - 1 AS block, kind, level, text, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS markup_text FROM e""")
def export_blocks(spark, sf):
    return render.document_blocks(V.meetings(spark, sf), V.segments(spark, sf), V.speakers(spark, sf)).withColumn("block", F.col("block").cast("long"))


@query(f"""WITH t AS (SELECT o_orderkey AS k, CAST(o_totalprice AS DOUBLE) / 16 AS t FROM orders), i AS (SELECT *, CAST(floor(t) AS BIGINT) AS i FROM t)
SELECT k, {_clock_sql('t', 'i', ',')} AS srt, {SHORT_SQL.format(i='i')} AS short, CASE WHEN i >= 60 THEN (i // 60) || 'm ' || (i % 60) || 's' ELSE i || 's' END AS spoken, (i // 60) || ':' || lpad(CAST(i % 60 AS VARCHAR), 2, '0') AS minutes,
  CAST(i % 3600 AS DOUBLE) AS parsed FROM i""", views=False)
def timestamps(spark, sf):
    t = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") / 16).alias("t"))
    whole = F.floor("t") % 3600
    again = X.parse_time(F.format_string("%02d:%02d,0", F.floor(whole / 60).cast("int"), (whole % 60).cast("int")))
    return t.select("k", X.srt_time("t").alias("srt"), X.short_time("t").alias("short"), X.duration_text("t").alias("spoken"), X.minutes_time("t").alias("minutes"), again.alias("parsed"))


@query(r"""WITH s AS (SELECT p_partkey AS k, p_name || ' /' || p_type || '?.v' || p_size || '.mp4' AS n FROM part)
SELECT k, regexp_replace(regexp_replace(regexp_replace(n, '["\\/:<>|?*\x00-\x1f]', '_', 'g'), '^[. ]+', ''), '[. ]+$', '') AS safe, regexp_replace(n, '\.[^/.]+$', '') AS title,
  regexp_replace(regexp_replace(regexp_replace(lower(n), '[^a-z0-9-]', '-', 'g'), '^-+', ''), '-+$', '') AS slug, substring(n, 1, 3) || '**********' || right(n, 3) AS masked FROM s""", views=False)
def file_names(spark, sf):
    n = V.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.concat("p_name", F.lit(" /"), "p_type", F.lit("?.v"), F.col("p_size"), F.lit(".mp4")).alias("n"))
    return n.select("k", X.safe_filename("n").alias("safe"), X.title_of("n").alias("title"), X.slug("n").alias("slug"), X.masked("n").alias("masked"))


# --- state changes --------------------------------------------------------------------------------------

JOBS_SQL = """WITH j AS (SELECT o_orderkey AS job_id, o_custkey AS meeting_id, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'pending' ELSE 'completed' END AS status, o_orderdate AS created_at FROM orders),
m AS (SELECT c_custkey AS meeting_id, CASE c_custkey % 4 WHEN 0 THEN 'processing' WHEN 1 THEN 'finalizing' ELSE 'completed' END AS status FROM customer)"""


def _jobs(spark, sf):
    s = F.col("o_orderstatus")
    return V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("meeting_id"), F.when(s == "O", "running").when(s == "P", "pending").otherwise("completed").alias("status"), F.col("o_orderdate").alias("created_at"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("timestamp").alias("completed_at"))


def _job_meetings(spark, sf):
    k = F.col("c_custkey")
    return V.table(spark, sf, "customer").select(k.alias("meeting_id"), F.when(k % 4 == 0, "processing").when(k % 4 == 1, "finalizing").otherwise("completed").alias("status"))


@query(JOBS_SQL + " SELECT job_id, CASE WHEN status IN ('running', 'pending') THEN 'failed' ELSE status END AS status, status IN ('running', 'pending') AS failed_now FROM j", views=False)
def stale_jobs(spark, sf):
    j, _ = mutate.recover_stale(_jobs(spark, sf), _job_meetings(spark, sf), F.lit("2024-01-01").cast("timestamp"))
    return j.select("job_id", "status", F.col("error").isNotNull().alias("failed_now"))


@query(JOBS_SQL + " SELECT meeting_id, CASE WHEN status IN ('processing', 'finalizing') AND meeting_id IN (SELECT meeting_id FROM j WHERE status IN ('running', 'pending')) THEN 'failed' ELSE status END AS status FROM m", views=False)
def stale_meetings(spark, sf):
    return mutate.recover_stale(_jobs(spark, sf), _job_meetings(spark, sf), F.lit("2024-01-01").cast("timestamp"))[1].select("meeting_id", "status")


@query(JOBS_SQL + " SELECT meeting_id, job_id, created_at FROM j WHERE status IN ('running', 'pending') QUALIFY row_number() OVER (PARTITION BY meeting_id ORDER BY created_at DESC, job_id DESC) = 1", views=False)
def active_jobs(spark, sf):
    return mutate.active_job(_jobs(spark, sf))


@query(JOBS_SQL + " SELECT meeting_id, CASE WHEN meeting_id % 3 = 0 AND status NOT IN ('processing', 'finalizing') THEN 'processing' ELSE status END AS status, meeting_id % 3 = 0 AND status NOT IN ('processing', 'finalizing') AS started FROM m", views=False)
def start_processing(spark, sf):
    m = _job_meetings(spark, sf)
    return mutate.start_processing(m, m.where("meeting_id % 3 = 0")).select("meeting_id", "status", "started")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS name FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)", views=False)
def orphan_folders(spark, sf):
    f = V.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("name"))
    return mutate.orphans(f, V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("meeting_id")))


@query("SELECT 'segments' AS name, meeting_id, ord AS k, md5(text) AS held FROM seg WHERE meeting_id % 3 <> 0 UNION ALL SELECT 'speakers', meeting_id, speaker_id, label FROM spk WHERE meeting_id % 3 <> 0 UNION ALL SELECT 'meetings', meeting_id, 0, title FROM mtg WHERE meeting_id % 3 <> 0")
def cascade_delete(spark, sf):
    t = {"meetings": V.meetings(spark, sf), "segments": V.segments(spark, sf), "speakers": V.speakers(spark, sf)}
    out = mutate.delete_meetings(t, t["meetings"].where("meeting_id % 3 = 0"))
    shown = {"segments": ("ord", F.md5("text")), "speakers": ("speaker_id", F.col("label")), "meetings": (F.lit(0), F.col("title"))}
    rows = [out[n].select(F.lit(n).alias("name"), "meeting_id", (F.col(k) if isinstance(k, str) else k).cast("long").alias("k"), held.alias("held")) for n, (k, held) in shown.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("SELECT o_orderkey AS result_id, CASE WHEN o_custkey % 5 = 0 THEN 'Deleted action' ELSE c_name END AS action_name FROM orders JOIN customer ON c_custkey = o_custkey", views=False)
def action_names(spark, sf):
    r = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("result_id"), F.col("o_custkey").alias("action_id"), F.col("o_orderdate").alias("created_at"))
    a = V.table(spark, sf, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("action_id"), F.col("c_name").alias("name"))
    return mutate.named_results(r, a).select("result_id", "action_name")


@query("SELECT meeting_id, ord, CASE WHEN is_edited AND meeting_id % 4 <> 0 THEN 'fixed ' || ord ELSE text END AS text FROM seg")
def edit_texts(spark, sf):
    s, m = V.segments(spark, sf), V.meetings(spark, sf).withColumn("is_encrypted", F.col("meeting_id") % 4 == 0)
    edits = s.where("is_edited").select("meeting_id", "ord", F.concat(F.lit("fixed "), "ord").alias("text"))
    return mutate.edit_texts(s, edits, m).select("meeting_id", "ord", "text")


@query("SELECT meeting_id, ord, text FROM seg")
def encrypt_roundtrip(spark, sf):
    key = learned.recording_key("secret", b"0123456789abcdef")
    s = mutate.crypt_texts(V.segments(spark, sf), ["text"], lambda c: learned.encrypted(c, key))
    return mutate.crypt_texts(s, ["text"], lambda c: learned.decrypted(c, key)).select("meeting_id", "ord", "text")


@query("""SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY r, i) - 1 AS ord, k AS insight_type, 'open' AS status, CASE WHEN i = 1 THEN '' ELSE k || i || ' of ' || meeting_id END AS content, CASE WHEN r = 1 THEN 'Ann ' || meeting_id END AS assignee, CAST(i * 2 AS DOUBLE) AS source_start_time FROM mtg, (VALUES (0, 'decision'), (1, 'action_item'), (2, 'open_question')) v(r, k), range(0, 4) g(i) WHERE i <= (meeting_id + r) % 4""")
def insight_rows(spark, sf):
    kinds = [("decisions", "decision"), ("action_items", "action_item"), ("open_questions", "open_question")]

    def items(r, k):
        content = lambda i: F.when(i != 1, F.concat(F.lit(k), i.cast("string"), F.lit(" of "), F.col("meeting_id").cast("string")))
        return F.transform(F.sequence(F.lit(0).cast("long"), (F.col("meeting_id") + r) % 4), lambda i: F.struct(content(i).alias("content"), F.concat(F.lit("Ann "), F.col("meeting_id").cast("string")).alias("assignee"), (i * 2.0).alias("timestamp")))

    a = V.meetings(spark, sf).select("meeting_id", F.to_json(F.struct(*(items(r, k).alias(n) for r, (n, k) in enumerate(kinds)))).alias("answer"))
    return chunks.insight_rows(a).withColumn("ord", F.col("ord").cast("long"))


@query(CHUNK_SQL.replace("SELECT r.meeting_id, r.chunk, string_agg", ", c AS (SELECT r.meeting_id, r.chunk, string_agg") + """), a AS (SELECT *, chunk % 3 <> 2 AS ongoing FROM c)
SELECT meeting_id, chunk FROM (SELECT *, coalesce(bool_and(ongoing) OVER (PARTITION BY meeting_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS go FROM a) WHERE go AND chunk < 20""")
def intro_chunks(spark, sf):
    c = chunks.time_chunks(V.segments(spark, sf))
    return chunks.until_intro_ends(c, c.select("meeting_id", "chunk", (F.col("chunk") % 3 != 2).alias("ongoing"))).select("meeting_id", "chunk")


# --- live ---------------------------------------------------------------------------------------------


@query("SELECT event_id AS arrival, value * 20 >= 500 AS loud, CASE WHEN event_id % 13 = 0 THEN true ELSE false END AS leaked FROM events", views=False)
def chunk_gates(spark, sf):
    return V.live_chunks(spark, sf).select("arrival", (F.col("loudness") >= live.SILENCE).alias("loud"), X.is_hallucination("text").alias("leaked"))


@query("""SELECT l_orderkey AS k, round(sqrt(avg(l_quantity * l_quantity)), 6) AS rms FROM lineitem GROUP BY 1""", views=False)
def rms_level(spark, sf):
    g = V.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list("l_quantity")).alias("x"))
    return g.select("k", F.round(X.rms("x"), 6).alias("rms"))


@query("SELECT time_bucket(INTERVAL 4 SECONDS, ts) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2", views=False)
def live_windows(spark, sf):
    return live.windows(V.table(spark, sf, "events")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("mean_value", 6).alias("mean_value"))


# The other modules of this folder register theirs.
from parlance.plans import changes, indexed, intake, sealed, streams, texts, work  # noqa: E402, F401
