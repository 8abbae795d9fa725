"""Queries over sources: transcripts, turns, uploads, probes, presets, preferences, listings, vectors, audio bounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance import schemas
from parlance.functions import exprs as X
from parlance.functions import learned
from parlance.operators import models
from parlance.plans.registry import query
from parlance.sources import readers
from parlance.sources import views as V
from parlance.streaming import live


@query("""SELECT meeting_id AS file, ord, CAST(floor(start_time) AS DOUBLE) % 3600 AS start, CAST(floor(end_time) AS DOUBLE) % 3600 + 0.5 AS "end", trim(text) AS text, CASE WHEN ord % 4 <> 0 THEN 0.25 + CAST(ord % 3 AS DOUBLE) / 8 END AS confidence FROM seg WHERE trim(text) <> ''""")
def transcript_rows(spark, sf):
    """Speech-to-text files: both forms of time, special tokens and zero probabilities left out."""
    s = V.segments(spark, sf)
    clock = lambda t: (F.floor(F.floor(t) % 3600 / 60).cast("int"), (F.floor(t) % 60).cast("int"))
    times = F.struct(F.format_string("00:%02d:%02d,000", *clock("start_time")).alias("from"), F.format_string("%02d:%02d.5", *clock("end_time")).alias("to"))
    token = lambda i, p: F.struct(i.cast("long").alias("id"), p.alias("p"))
    p = 0.25 + (F.col("ord") % 3) / 8.0
    plain = F.when(F.col("ord") % 4 != 0, 7).otherwise(50257)
    tokens = F.array(token(plain, p - 0.125), token(plain, p + 0.125), token(F.lit(50258), F.lit(1.0)), token(F.lit(9), F.lit(0.0)))
    item = F.struct("ord", F.struct(F.concat(F.lit("  "), "text", F.lit(" ")).alias("text"), times.alias("timestamps"), tokens.alias("tokens")).alias("t"))
    raw = s.groupBy(F.col("meeting_id").alias("file")).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]).alias("transcription"))
    return readers.heard(raw).withColumn("ord", F.col("ord").cast("long"))


@query("""SELECT meeting_id, ord, substring(text, 1, 500) AS whole, nullif(concat_ws(' ', nullif(substring(text, 1, 300), ''), CASE WHEN ord % 2 = 0 THEN right(text || text, 200) END), '') AS chunk FROM seg""")
def transcription_prompts(spark, sf):
    context = F.when(F.col("ord") % 2 == 0, F.concat("text", "text")).otherwise("")
    return V.segments(spark, sf).select("meeting_id", "ord", readers.vocabulary_prompt("text").alias("whole"), readers.vocabulary_prompt("text", context).alias("chunk"))


@query("SELECT meeting_id, di, round_even(ds / 7, 3) AS ds, round_even(de / 7, 3) AS de, lab FROM diar")
def turn_rows(spark, sf):
    t = V.turns(spark, sf).withColumns({"ds": F.col("ds") / 7, "de": F.col("de") / 7})
    return readers.turn_table(t)


@query("""SELECT 'heard' AS kind, meeting_id, ord, start_time, end_time, text, confidence FROM seg UNION ALL SELECT 'turn', meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY di) - 1, ds, de, lab, NULL FROM diar""")
def stored_columns(spark, sf):
    """Transcripts and turns out of the nested columns of the recordings."""
    s = V.segments(spark, sf).groupBy("meeting_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(F.col("start_time").alias("start"), F.col("end_time").alias("end"), "text", "confidence").alias("t")))), lambda x: x["t"]).alias("raw_transcription"))
    t = V.turns(spark, sf).groupBy("meeting_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("di", F.struct(F.col("ds").alias("start"), F.col("de").alias("end"), F.col("lab").alias("speaker")).alias("t")))), lambda x: x["t"]).alias("raw_diarization"))
    m = s.join(t, "meeting_id", "left")
    heard = readers.stored_transcript(m).select(F.lit("heard").alias("kind"), "meeting_id", "ord", "start_time", "end_time", "text", "confidence")
    turns = readers.stored_turns(m).select(F.lit("turn").alias("kind"), "meeting_id", F.col("di").alias("ord"), F.col("ds").alias("start_time"), F.col("de").alias("end_time"), F.col("lab").alias("text"), F.lit(None).cast("double").alias("confidence"))
    return heard.unionByName(turns)


UPLOADS_SQL = r"""WITH u AS (SELECT p_partkey AS k, CASE p_partkey % 7 WHEN 0 THEN '   ' ELSE '  ' || p_name END AS title, 'dir/' || p_brand || ' x' || CASE p_partkey % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.MP4' WHEN 2 THEN '.wav' WHEN 3 THEN '' ELSE '.m4a' END AS name,
  CASE WHEN p_partkey % 11 = 0 THEN 5368709121 ELSE p_size * 1000 END AS size, CASE p_partkey % 3 WHEN 0 THEN p_size % 4 END AS lo, CASE p_partkey % 4 WHEN 0 THEN 2 END AS hi, CASE p_partkey % 2 WHEN 0 THEN p_type ELSE ' ' END AS vocabulary FROM part)
SELECT k, trim(title) AS title, regexp_replace(split_part(name, '/', 2), '[^A-Za-z0-9_.\-]', '_', 'g') AS name, lower(regexp_extract(name, '(\.[^./\\]+)$', 1)) AS extension, coalesce(nullif(trim(vocabulary), ''), 'house words') AS vocabulary,
  CASE WHEN trim(title) = '' THEN 'title is required' WHEN lower(regexp_extract(name, '(\.[^./\\]+)$', 1)) NOT IN ('.mp4', '.wav', '.m4a') THEN 'unsupported type ' || lower(regexp_extract(name, '(\.[^./\\]+)$', 1))
    WHEN lo < 1 OR hi < 1 THEN 'speaker counts must be at least 1' WHEN lo > hi THEN 'min_speakers exceeds max_speakers' WHEN size > 5368709120 THEN 'file too large' END AS error FROM u"""


@query(UPLOADS_SQL, views=False)
def upload_checks(spark, sf):
    k = F.col("p_partkey")
    ending = F.element_at(F.array(*map(F.lit, (".txt", ".MP4", ".wav", "", ".m4a"))), (k % 5 + 1).cast("int"))
    u = V.table(spark, sf, "part").select(
        k.alias("k"), F.when(k % 7 == 0, "   ").otherwise(F.concat(F.lit("  "), "p_name")).alias("title"), F.concat(F.lit("dir/"), "p_brand", F.lit(" x"), ending).alias("name"),
        F.when(k % 11 == 0, F.lit(5368709121)).otherwise(F.col("p_size") * 1000).alias("size"), F.when(k % 3 == 0, F.col("p_size") % 4).alias("min_speakers"), F.when(k % 4 == 0, 2).alias("max_speakers"),
        F.when(k % 2 == 0, F.col("p_type")).otherwise(" ").alias("vocabulary"),
    )
    return readers.checked_uploads(u, "house words", "k").select("k", "title", "name", "extension", "vocabulary", "error")


@query("""SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE o_totalprice END AS duration FROM orders""", views=False)
def probe_durations(spark, sf):
    o = V.table(spark, sf, "orders")
    good = F.concat(F.lit('{"format": {"duration": "'), F.col("o_totalprice").cast("string"), F.lit('"}}'))
    probe = F.when(F.col("o_orderkey") % 4 == 0, "not json").when(F.col("o_orderkey") % 4 == 1, '{"format": {"duration": "N/A"}}').otherwise(good)
    return readers.media_duration(o.select(F.col("o_orderkey").alias("k"), probe.alias("probe"))).select("k", "duration")


@query("""WITH f AS (SELECT n_nationkey AS k, lower(n_name) || '.json' AS file, CASE n_nationkey % 4 WHEN 0 THEN '{bad' WHEN 1 THEN '{"id": "shared", "type": "llm"}' ELSE '{"type": "whisper", "k": ' || n_nationkey || '}' END AS body FROM nation),
j AS (SELECT CASE WHEN k % 4 = 1 THEN 'shared' ELSE regexp_replace(file, '\\.json$', '') END AS id, file, body, CASE WHEN k % 4 = 1 THEN 'llm' ELSE 'whisper' END AS type FROM f WHERE k % 4 <> 0)
SELECT id, type, body FROM j QUALIFY row_number() OVER (PARTITION BY id ORDER BY file DESC) = 1""", views=False)
def preset_files(spark, sf):
    n = V.table(spark, sf, "nation")
    k = F.col("n_nationkey")
    body = F.when(k % 4 == 0, "{bad").when(k % 4 == 1, '{"id": "shared", "type": "llm"}').otherwise(F.concat(F.lit('{"type": "whisper", "k": '), k.cast("string"), F.lit("}")))
    return readers.preset_rows(n.select(F.concat(F.lower("n_name"), F.lit(".json")).alias("file"), body.alias("body")))


@query(r"""WITH n AS (SELECT regexp_replace(regexp_replace(regexp_replace(lower(p_type || ' #' || p_partkey), '[^a-z0-9-]', '-', 'g'), '^-+', ''), '-+$', '') AS id, p_type || ' #' || p_partkey AS name FROM part)
SELECT id || '.json' AS file, to_json(struct_pack(id := id, name := name, "type" := 'llm'))::VARCHAR AS body FROM n""", views=False)
def preset_writes(spark, sf):
    return readers.preset_texts(V.table(spark, sf, "part").select(F.concat("p_type", F.lit(" #"), "p_partkey").alias("name"), F.lit("llm").alias("type")))


@query("""WITH u AS (SELECT c_custkey AS owner, c_custkey % 3 AS kind, c_name AS n FROM customer), r AS (
SELECT owner, 'default_vocabulary' AS key, CASE kind WHEN 1 THEN n ELSE '' END AS value FROM u UNION ALL SELECT owner, 'speaker_profiles_enabled', CASE kind WHEN 1 THEN 'true' ELSE 'false' END FROM u
UNION ALL SELECT owner, 'hf_auth_token', '' FROM u UNION ALL SELECT owner, 'llm_api_key', CASE kind WHEN 1 THEN n ELSE '' END FROM u UNION ALL SELECT owner, 'theme', n FROM u WHERE kind = 1)
SELECT *, CASE WHEN key IN ('hf_auth_token', 'llm_api_key') AND length(value) > 6 THEN substring(value, 1, 3) || '**********' || right(value, 3) WHEN key IN ('hf_auth_token', 'llm_api_key') AND value <> '' THEN '**********' ELSE value END AS shown FROM r""", views=False)
def preference_rows(spark, sf):
    c = V.table(spark, sf, "customer")
    n = F.col("c_name")
    given = F.to_json(F.struct(n.alias("default_vocabulary"), F.lit("true").alias("speaker_profiles_enabled"), n.alias("llm_api_key"), n.alias("theme")))
    return readers.merged_preferences(c.select(F.col("c_custkey").alias("owner"), F.when(F.col("c_custkey") % 3 == 1, given).when(F.col("c_custkey") % 3 == 2, "{bad").alias("body")))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS name FROM orders WHERE o_orderkey % 3 <> 0", views=False)
def storage_listing(spark, sf):
    o = V.table(spark, sf, "orders").select(F.concat(F.lit("s3://bucket/meetings/"), F.col("o_orderkey"), F.lit("/")).alias("path"), (F.col("o_orderkey") % 3 != 0).alias("is_directory"))
    return readers.listed(o)


@query("SELECT vec_id, 4 * len(embedding) AS bytes, round(list_sum(list_transform(embedding, lambda x, i: i * CAST(x AS DOUBLE))), 9) AS digest FROM embeddings WHERE embedding IS NOT NULL", views=False)
def vector_blobs(spark, sf):
    """Vectors as stored bytes and read back: every component counts by its place."""
    e = V.table(spark, sf, "embeddings").where("embedding is not null").withColumn("blob", readers.vector_blob("embedding"))
    back = F.transform(readers.blob_vector("blob"), lambda x, i: (i + 1) * x.cast("double"))
    return e.select("vec_id", F.octet_length("blob").cast("long").alias("bytes"), F.round(F.aggregate(back, F.lit(0.0), lambda a, x: a + x), 9).alias("digest"))


@query("""WITH t AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity / 8 AS a, l_quantity / 8 + l_linenumber AS b, CAST(l_quantity * 4000 AS BIGINT) AS size FROM lineitem),
x AS (SELECT *, least(CAST(floor(b * 16000) AS BIGINT) * 2, size) AS last FROM t)
SELECT k, n, size / 32000.0::DOUBLE AS seconds, least(CAST(floor(a * 16000) AS BIGINT) * 2, last) AS first, last FROM x""", views=False)
def pcm_positions(spark, sf):
    t = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), (F.col("l_quantity") / 8).alias("a"), (F.col("l_quantity") / 8 + F.col("l_linenumber")).alias("b"), (F.col("l_quantity") * 4000).cast("long").alias("size"))
    return t.select("k", "n", live.pcm_seconds("size").alias("seconds"), live.pcm_bounds("a", "b", "size").alias("x")).select("k", "n", "seconds", F.col("x.first"), F.col("x.last"))


@query("SELECT doc_id, md5(substring(hex(encode(text)), 1 + 4 * (doc_id % 5) * 1600, 6400)) AS slice FROM documents WHERE text IS NOT NULL", views=False)
def audio_slices(spark, sf):
    """Slices of a byte column at sample positions (the bytes of texts stand for audio)."""
    d = V.table(spark, sf, "documents").where("text is not null")
    d = d.select("doc_id", F.col("text").cast("binary").alias("audio"), ((F.col("doc_id") % 5) / 10.0).alias("a"), ((F.col("doc_id") % 5) / 10.0 + 0.1).alias("b"))
    return live.pcm_slice(d, "audio", "a", "b").select("doc_id", F.md5(F.hex("slice")).alias("slice"))


@query("""SELECT l_orderkey AS k, avg(l_quantity) / 128 AS level FROM lineitem GROUP BY 1""", views=False)
def input_levels(spark, sf):
    g = V.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list("l_quantity")).alias("x"))
    return g.select("k", live.input_level("x").alias("level"))


@query("""WITH j AS (SELECT o_orderkey AS job_id, CASE o_orderkey % 5 WHEN 0 THEN NULL ELSE o_custkey END AS meeting_id, CASE o_orderkey % 3 WHEN 0 THEN 'process_meeting' WHEN 1 THEN 'rediarize' ELSE 'dance' END AS job_type, CASE o_orderkey % 4 WHEN 0 THEN 'ended' ELSE 'running' END AS status FROM orders)
SELECT job_id, concat_ws('; ', CASE WHEN meeting_id IS NULL THEN 'meeting_id is null' END, CASE WHEN job_type = 'dance' THEN 'job_type: dance' END, CASE WHEN status = 'ended' THEN 'status: ended' END) AS reasons FROM j WHERE meeting_id IS NULL OR job_type = 'dance' OR status = 'ended'""", views=False)
def request_checks(spark, sf):
    k = F.col("o_orderkey")
    j = V.table(spark, sf, "orders").select(k.cast("string").alias("job_id"), F.when(k % 5 != 0, F.col("o_custkey").cast("string")).alias("meeting_id"), F.when(k % 3 == 0, "process_meeting").when(k % 3 == 1, "rediarize").otherwise("dance").alias("job_type"), F.when(k % 4 == 0, "ended").otherwise("running").alias("status"), F.lit(0.0).alias("progress"), F.col("o_orderdate").alias("created_at"))
    found = schemas.violations(schemas.conform(j, "jobs"), "jobs")
    return found.select(F.col("job_id").cast("long").alias("job_id"), F.array_join("reasons", "; ").alias("reasons"))


@query("""SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS kept, CASE WHEN o_orderkey % 2 = 0 THEN 1 END AS newest FROM orders""", views=False)
def schema_evolution(spark, sf):
    """Old files without a column beside new ones with it: missing values are null, unknown columns go."""
    o = V.table(spark, sf, "orders")
    old = o.where("o_orderkey % 2 <> 0").select(F.col("o_orderkey").cast("string").alias("term"), F.lit("x").alias("colour"))
    new = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("string").alias("term"), F.lit(1).alias("frequency"))
    both = schemas.conform(old, "vocabulary_entries").unionByName(schemas.conform(new, "vocabulary_entries"))
    return both.select(F.col("term").cast("long").alias("k"), F.col("frequency").isNotNull().alias("kept"), F.col("frequency").cast("int").alias("newest"))


@query("""WITH p AS (SELECT c_custkey AS k, c_name AS a, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN 'other' END AS b, substring(c_name, 1, CAST(c_custkey % 6 AS INTEGER)) AS s FROM customer) SELECT k, coalesce(a = b, false) AS repeated, length(s) >= 4 AS long_enough FROM p""", views=False)
def password_checks(spark, sf):
    k = F.col("c_custkey")
    c = V.table(spark, sf, "customer").select(k.alias("k"), F.col("c_name").alias("a"), F.when(k % 3 == 0, F.col("c_name")).when(k % 3 == 1, "other").alias("b"), F.substring(F.col("c_name"), F.lit(1), (k % 6).cast("int")).alias("s"))
    return c.select("k", learned.acceptable_password("a", "b").alias("repeated"), learned.acceptable_password("s", "s").alias("long_enough"))


@query("""SELECT * FROM (SELECT r_name || '/' || t.task AS owner, t.task, CASE WHEN r_regionkey % 2 = 0 AND t.task = 'actions' THEN 'own-' || r_regionkey ELSE t.preset END AS preset_id, CASE WHEN r_regionkey % 2 = 0 AND t.task = 'actions' THEN NULL WHEN t.preset LIKE 'whisper%' THEN 'whisper' ELSE 'llm' END AS type
FROM region, (VALUES ('actions', 'gemini-flash-lite'), ('analysis', 'gemini-flash-lite'), ('live', 'gemini-flash-lite'), ('transcription', 'whisper-large-v3-turbo'), ('live_transcription', 'whisper-small')) t(task, preset)) WHERE owner IS NOT NULL""", views=False)
def preset_resolution(spark, sf):
    """Every owner's preset per task: the stored one, else the default; the preset's type, if it is known."""
    r = V.table(spark, sf, "region")
    stored = r.where("r_regionkey % 2 = 0").select(F.col("r_name").alias("owner"), F.lit("actions").alias("task"), F.concat(F.lit("own-"), "r_regionkey").alias("preset_id"))
    known = spark.createDataFrame([("gemini-flash-lite", "llm"), ("whisper-small", "whisper"), ("whisper-large-v3-turbo", "whisper")], "id string, type string")
    found = models.preset_for_owner(r.select(F.col("r_name").alias("owner")), stored, known)
    return found.select(F.concat_ws("/", "owner", "task").alias("owner"), "task", "preset_id", "type")


@query("""WITH f AS (SELECT p_partkey, p_type || '-' || p_partkey % 40 AS id, CASE p_size % 3 WHEN 0 THEN 'llm' WHEN 1 THEN 'whisper' END AS type, p_partkey || '.json' AS file FROM part WHERE p_size % 7 <> 0)
SELECT id, type FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file DESC) AS n FROM f) WHERE n = 1 AND type = 'whisper'""", views=False)
def presets_by_type(spark, sf):
    """Presets of one type, read from files of which some are broken and some share an id."""
    p = V.table(spark, sf, "part")
    id_ = F.concat(F.col("p_type"), F.lit("-"), F.col("p_partkey") % 40)
    body = F.when(F.col("p_size") % 7 != 0, F.to_json(F.struct(id_.alias("id"), F.when(F.col("p_size") % 3 == 0, "llm").when(F.col("p_size") % 3 == 1, "whisper").alias("type")))).otherwise("{bad")
    return models.presets_of_type(readers.preset_rows(p.select(F.concat("p_partkey", F.lit(".json")).alias("file"), body.alias("body"))), "whisper").select("id", "type")


@query("""WITH t(i, task) AS (VALUES (0, 'actions'), (1, 'live'), (2, 'analysis')), s AS (SELECT c_custkey AS owner, task, 'preset-' || (c_custkey + i) % 9 AS preset_id FROM customer, t WHERE (c_custkey + i) % 4 <> 0),
c AS (SELECT o_custkey AS owner, CASE max(o_orderkey) % 3 WHEN 0 THEN 'live' WHEN 1 THEN 'transcription' ELSE 'unknown' END AS task, 'new-' || max(o_orderkey) % 5 AS preset_id FROM orders GROUP BY 1),
a AS (SELECT owner, task, coalesce(c.preset_id, s.preset_id) AS preset_id FROM s FULL JOIN (SELECT * FROM c WHERE task <> 'unknown') c USING (owner, task))
SELECT * FROM a WHERE preset_id NOT IN ('preset-4', 'new-1')""", views=False)
def preset_assignments(spark, sf):
    """Every customer's presets by task after changes by their last order, once two presets are deleted."""
    n = F.col("c_custkey") + F.col("i")
    tasks = F.posexplode(F.array(F.lit("actions"), F.lit("live"), F.lit("analysis"))).alias("i", "task")
    stored = V.table(spark, sf, "customer").select("c_custkey", tasks).where(n % 4 != 0).select(F.col("c_custkey").alias("owner"), "task", F.concat(F.lit("preset-"), n % 9).alias("preset_id"))
    last = V.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("owner")).agg(F.max("o_orderkey").alias("k"))
    task = F.when(F.col("k") % 3 == 0, "live").when(F.col("k") % 3 == 1, "transcription").otherwise("unknown")
    changed = models.changed_assignments(stored, last.select("owner", task.alias("task"), F.concat(F.lit("new-"), F.col("k") % 5).alias("preset_id")))
    return models.without_presets(changed, spark.createDataFrame([("preset-4",), ("new-1",)], "id string"))


@query("""WITH d(name, kind, dflt) AS (VALUES ('llm_base_url', 't', 'http://localhost:11434/v1'), ('live_chunk_seconds', 'f', '4.0'), ('max_upload_bytes', 'i', 'MAX'), ('profile_threshold', 'f', '0.55'), ('polish_minimum_seconds', 'f', '60.0')),
g AS (SELECT c_custkey AS owner, CASE c_custkey % 5 WHEN 0 THEN 'llm_base_url' WHEN 1 THEN 'live_chunk_seconds' WHEN 2 THEN 'max_upload_bytes' WHEN 3 THEN 'profile_threshold' ELSE 'other' END AS name, CASE WHEN c_custkey % 7 = 0 THEN c_name ELSE CAST(c_nationkey AS VARCHAR) END AS given FROM customer)
SELECT o.owner, d.name, CASE WHEN g.given IS NULL THEN dflt WHEN kind = 't' THEN g.given WHEN try_cast(g.given AS BIGINT) IS NULL THEN NULL WHEN kind = 'f' THEN g.given || '.0' ELSE g.given END AS value, g.given IS NULL OR kind = 't' OR try_cast(g.given AS BIGINT) IS NOT NULL AS valid
FROM (SELECT c_custkey AS owner FROM customer) o CROSS JOIN d LEFT JOIN g ON g.owner = o.owner AND g.name = d.name""".replace("'MAX'", f"'{readers.MAX_UPLOAD}'"), views=False)
def settings_rows(spark, sf):
    """Every customer's typed settings: an entry of their own over the defaults, some of the wrong type or of no known name."""
    k = F.col("c_custkey")
    name = F.when(k % 5 == 0, "LLM_Base_Url").when(k % 5 == 1, "live_chunk_seconds").when(k % 5 == 2, "MAX_UPLOAD_BYTES").when(k % 5 == 3, "profile_threshold").otherwise("other")
    value = F.when(k % 7 == 0, F.col("c_name")).otherwise(F.col("c_nationkey").cast("string"))
    return readers.typed_settings(V.table(spark, sf, "customer").select(k.alias("owner"), name.alias("name"), value.alias("value")))


@query("""SELECT p_partkey AS k, CASE WHEN p_size > 0 THEN printf('%.1fs', CAST(p_size AS DOUBLE) / 8) END AS seconds, printf('%.0f', CAST(p_size AS DOUBLE) * 3) AS whole, CAST(floor(p_retailprice / 60) AS BIGINT) AS minutes, printf('%.1f MB', (p_partkey * 12347 + 11) / 1048576.0) AS megabytes FROM part""", views=False)
def formats(spark, sf):
    p = V.table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("k"), X.seconds_text(F.col("p_size") / 8.0).alias("seconds"), X.whole_seconds(F.col("p_size") * 3.0).alias("whole"), X.whole_minutes("p_retailprice").alias("minutes"), X.megabytes(F.col("p_partkey") * 12347 + 11).alias("megabytes"))


@query("SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS stamp FROM orders", views=False)
def dates(spark, sf):
    return V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), X.day_text("o_orderdate").alias("day"), X.stamp_text("o_orderdate").alias("stamp"))
