"""Queries over state changes: entities, speakers, utterances, vocabulary, insights, live messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance import schemas
from parlance.functions import exprs as X
from parlance.functions import learned
from parlance.operators import chunks, jobs, mutate, speakers, vocabulary
from parlance.plans.registry import query, told_apart
from parlance.sources import views as V
from parlance.streaming import live


@query("""SELECT c_custkey AS action_id, CASE WHEN c_custkey % 3 = 0 THEN 'new ' || c_name ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN 'p' || c_custkey WHEN c_custkey % 5 = 1 THEN 'patched' ELSE c_mktsegment END AS prompt FROM customer WHERE c_custkey % 7 <> 0
UNION ALL SELECT -c_custkey - 1, 'made', 'x' FROM customer WHERE c_custkey % 4 = 0""", views=False)
def entity_changes(spark, sf):
    """Actions created, replaced, patched and deleted."""
    c = V.table(spark, sf, "customer")
    k = F.col("c_custkey")
    old = c.select(k.alias("action_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("prompt"))
    new = c.where(k % 3 == 0).select(k.alias("action_id"), F.concat(F.lit("new "), "c_name").alias("name"), F.concat(F.lit("p"), k).alias("prompt")).unionByName(c.where(k % 4 == 0).select((-k - 1).alias("action_id"), F.lit("made").alias("name"), F.lit("x").alias("prompt")))
    patched = mutate.patch(old, c.where((k % 5 == 1) & (k % 3 != 0)).select(k.alias("action_id"), F.lit(None).cast("string").alias("name"), F.lit("patched").alias("prompt")), "action_id")
    return mutate.remove(mutate.upsert(patched, new, "action_id"), c.where(k % 7 == 0).select(k.alias("action_id")), "action_id")


@query("""SELECT meeting_id, speaker_id, CASE WHEN speaker_id % 3 = 0 THEN 'Named ' || speaker_id ELSE display_name END AS display_name, CASE WHEN speaker_id % 3 <= 1 THEN '#000' END AS color, CASE WHEN speaker_id % 3 = 0 THEN 'manual' END AS identified_by FROM spk""")
def rename_speakers(spark, sf):
    p = V.speakers(spark, sf).withColumns({"color": F.lit(None).cast("string"), "identified_by": F.lit(None).cast("string")})
    k = F.col("speaker_id") % 3
    changes = p.where(k <= 1).select("speaker_id", F.when(k == 0, F.concat(F.lit("Named "), "speaker_id")).alias("display_name"), F.lit("#000").alias("color"))
    return mutate.rename_speakers(p, changes).select("meeting_id", "speaker_id", "display_name", "color", "identified_by")


@query("""SELECT meeting_id, ord, CASE WHEN ord % 4 = 0 THEN meeting_id * 10 + 2 WHEN ord % 4 = 1 THEN NULL ELSE speaker_id END AS speaker_id FROM seg""")
def move_segments(spark, sf):
    s = V.segments(spark, sf)
    return mutate.move_segments(s, s.where("ord % 4 < 2").select("meeting_id", "ord", F.when(F.col("ord") % 4 == 0, F.col("meeting_id") * 10 + 2).alias("speaker_id"))).select("meeting_id", "ord", "speaker_id")


@query("""SELECT c_custkey AS k, c_name AS name, 'own' AS prompt FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT NULL, 'Default ' || n_nationkey, 'default' FROM nation UNION ALL SELECT NULL, c_name, 'default' FROM customer WHERE c_custkey % 2 <> 0 AND c_custkey % 5 = 1""", views=False)
def seed_actions(spark, sf):
    c, n = V.table(spark, sf, "customer"), V.table(spark, sf, "nation")
    own = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.lit("own").alias("prompt"))
    defaults = n.select(F.concat(F.lit("Default "), "n_nationkey").alias("name"), F.lit("default").alias("prompt")).unionByName(c.where("c_custkey % 5 = 1").select(F.col("c_name").alias("name"), F.lit("default").alias("prompt")))
    return mutate.seed(own, defaults)


@query("""WITH o AS (SELECT p_brand AS term, count(*) AS frequency, min(p_partkey) AS source FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), n AS (SELECT CASE p_partkey % 3 WHEN 0 THEN p_brand ELSE p_type END AS term, count(*) AS frequency, min(p_partkey) AS source FROM part GROUP BY 1)
SELECT term, coalesce(o.frequency, 0) + coalesce(n.frequency, 0) AS frequency, CASE WHEN o.term IS NULL THEN n.source ELSE o.source END AS source_meeting_id FROM o FULL JOIN n USING (term)""", views=False)
def vocabulary_merge(spark, sf):
    p = V.table(spark, sf, "part")
    count = lambda df, term: df.groupBy(term.alias("term")).agg(F.count("*").alias("frequency"), F.min("p_partkey").alias("source_meeting_id"))
    return vocabulary.merge_terms(count(p.where("p_partkey % 2 = 0"), F.col("p_brand")), count(p, F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.col("p_type"))))


@query(r""", e AS (SELECT meeting_id, ord, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '') AS w FROM seg WHERE meeting_id % 4 <> 0), """ + told_apart("e", "meeting_id, ord", 0, 3) + r""", n AS (
SELECT term, count(*) AS frequency, min(meeting_id) AS source FROM (SELECT meeting_id, 'Qx' || ord % 3 AS term FROM good UNION ALL SELECT meeting_id, 'Qy Zoë' FROM good) GROUP BY 1), o AS (SELECT 'Qx0' AS term, 5 AS frequency, -1 AS source UNION ALL SELECT 'kept', 2, -2)
SELECT term, coalesce(o.frequency, 0) + coalesce(n.frequency, 0) AS frequency, CASE WHEN o.term IS NULL THEN n.source ELSE o.source END AS source_meeting_id FROM o FULL JOIN n USING (term)""")
def edit_learning(spark, sf):
    """Edits that put a word before and two after texts of any length; encrypted recordings teach nothing."""
    s = V.segments(spark, sf).withColumn("original_text", F.col("text"))
    m = V.meetings(spark, sf).withColumn("is_encrypted", F.col("meeting_id") % 4 == 0)
    edits = s.select("meeting_id", "ord", F.concat(F.lit("Qx"), F.col("ord") % 3, F.lit(" "), "text", F.lit(" Qy Zoë")).alias("text"))
    entries = spark.createDataFrame([("Qx0", 5, -1), ("kept", 2, -2)], "term string, frequency long, source_meeting_id long")
    return jobs.edit_and_learn(s, edits, m, entries)[1]


@query("SELECT o_orderkey AS insight_id, CASE o_orderstatus WHEN 'F' THEN 'open' ELSE 'completed' END AS status FROM orders", views=False)
def toggle_insights(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "open").otherwise("dismissed")
    return V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("insight_id"), mutate.toggle_insight(status).alias("status"))


@query("""SELECT meeting_id, speaker_id, CASE WHEN speaker_id % 4 = 0 THEN NULL WHEN speaker_id % 4 = 1 THEN 'Live ' || speaker_id ELSE display_name END AS display_name FROM spk""")
def live_patch(spark, sf):
    """Updates of a live client win where their id is known, even with a null."""
    p = V.speakers(spark, sf)
    k = F.col("speaker_id") % 4
    updates = p.where(k <= 1).select("speaker_id", F.when(k == 1, F.concat(F.lit("Live "), "speaker_id")).alias("display_name"))
    return mutate.patch(p, updates, "speaker_id", keep_null=False).select("meeting_id", "speaker_id", "display_name")


@query("""SELECT meeting_id, label, CASE WHEN speaker_id % 3 = 1 THEN 'Ann ' || meeting_id ELSE display_name END AS display_name, CASE WHEN speaker_id % 3 = 1 THEN 'polish_llm' END AS identified_by, CASE WHEN speaker_id % 3 = 1 THEN CAST(0.7 AS DOUBLE) END AS confidence FROM spk""")
def polish_names(spark, sf):
    p = V.speakers(spark, sf).withColumns({"identified_by": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    answers = p.select("meeting_id", "label", F.when(F.col("speaker_id") % 3 == 1, F.concat(F.lit("Ann "), "meeting_id")).when(F.col("speaker_id") % 3 == 2, "").alias("name"))
    return speakers.polish_names(p, answers).select("meeting_id", "label", "display_name", "identified_by", "confidence")


@query("SELECT p.meeting_id, p.speaker_id, count(s.ord) AS n FROM spk p LEFT JOIN seg s ON s.meeting_id = p.meeting_id AND s.speaker_id = p.speaker_id AND s.ord % 3 <> 0 GROUP BY 1, 2")
def remaining_rows(spark, sf):
    return jobs.remaining(V.segments(spark, sf).where("ord % 3 <> 0"), V.speakers(spark, sf))


@query("""WITH t AS (SELECT o_custkey AS owner, list('a' || o_orderkey % 9 ORDER BY o_orderkey) AS s, list('a' || o_orderkey % 9 ORDER BY o_orderkey) FILTER (o_orderkey % 4 = 0) AS e FROM orders GROUP BY 1)
SELECT owner, array_to_string(list_sort(list_filter(list_distinct(list_append(s, 'base')), lambda x: NOT list_contains(coalesce(e, []), x))), ',') AS running FROM t""", views=False)
def running_actions(spark, sf):
    name = F.concat(F.lit("a"), F.col("o_orderkey") % 9)
    t = V.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("owner")).agg(F.collect_list(name).alias("s"), F.collect_list(F.when(F.col("o_orderkey") % 4 == 0, name)).alias("e"))
    return t.select("owner", F.array_join(F.array_sort(mutate.with_running(F.array(F.lit("base")), F.col("s"), F.col("e"))), ",").alias("running"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, lead(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) OVER (ORDER BY vec_id) AS w FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] * 0.7::DOUBLE + w[i] * 0.3::DOUBLE) * i)), 6) AS digest FROM e WHERE w IS NOT NULL""", views=False)
def centroid_updates(spark, sf):
    """A centroid moved towards a new vector, digested over all components."""
    e = V.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    moved = e.join(n, "vec_id").select("vec_id", X.ema("v", "w").alias("m"))
    return moved.select("vec_id", F.round(F.aggregate(F.transform("m", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 6).alias("digest"))


@query("""SELECT c_custkey AS k, true AS opened, false AS opened_by_other, c_custkey % 2 = 0 AS opened_damaged FROM customer""", views=False)
def password_tokens(spark, sf):
    """Verification tokens under the full number of rounds: the right key opens them, another or damage does not."""
    key, other = learned.recording_key("secret", b"0123456789abcdef"), learned.recording_key("secrets", b"0123456789abcdef")
    c = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), learned.verify_token(key).alias("token"))
    damaged = F.when(F.col("k") % 2 == 0, F.col("token")).otherwise(F.translate(F.col("token"), "ABCDabcd", "BCDAbcda"))
    return c.select("k", learned.opens("token", key).alias("opened"), learned.opens("token", other).alias("opened_by_other"), learned.opens(damaged, key).alias("opened_damaged"))


# --- live ---------------------------------------------------------------------------------------------


@query("""SELECT event_id AS arrival FROM events WHERE event_id % 9 IN (0, 1, 2, 3, 4, 5)""", views=False)
def relayed_messages(spark, sf):
    kinds = F.array(*map(F.lit, [*live.RELAYED, "live_segment", "pong", "speaker_reassignment"]))
    m = V.table(spark, sf, "events").select(F.col("event_id").alias("arrival"), F.to_json(F.struct(F.element_at(kinds, (F.col("event_id") % 9 + 1).cast("int")).alias("type"))).alias("value"))
    return live.relayed(m).select("arrival")


@query("SELECT user_id AS recording, count(*) FILTER (event_id % 17 <> 0) * CAST(4 AS DOUBLE) AS duration FROM events GROUP BY 1", views=False)
def live_durations(spark, sf):
    c = V.table(spark, sf, "events").select(F.col("user_id").alias("recording"), F.when(F.col("event_id") % 17 != 0, 4.0).alias("seconds"))
    return jobs.live_duration(c)


@query("""SELECT meeting_id, CASE WHEN meeting_id % 3 = 0 THEN 'finalizing' ELSE 'recording' END AS status, CASE WHEN meeting_id % 3 = 0 THEN 'stopped' ELSE 'recording' END AS recording_status, CASE WHEN meeting_id % 3 = 0 THEN 'finalize_live' END AS job FROM mtg""")
def stop_commands(spark, sf):
    m = V.meetings(spark, sf).withColumns({"status": F.lit("recording"), "recording_status": F.lit("recording")})
    k = F.col("meeting_id") % 3
    sent = m.select("meeting_id", F.when(k == 0, '{"type": "stop_recording"}').when(k == 1, '{"type": "ping"}').otherwise("{bad").alias("body"))
    after, made = jobs.stopped(m, sent.unionByName(sent).unionByName(sent.select((-F.col("meeting_id") - 1).alias("meeting_id"), "body")))
    return after.join(made.select("meeting_id", F.col("job_type").alias("job")), "meeting_id", "left").select("meeting_id", "status", "recording_status", "job")


COLOURS = "(['" + "', '".join(schemas.PALETTE) + "'])"


@query(f""", have AS (SELECT meeting_id, count(*) AS n FROM spk WHERE speaker_id % 10 = 1 GROUP BY 1), heard AS (SELECT meeting_id, 'SPEAKER_0' || spk AS label, min(ord) AS ord FROM seg GROUP BY 1, 2),
fresh AS (SELECT h.meeting_id, h.label, coalesce(v.n, 0) + row_number() OVER (PARTITION BY h.meeting_id ORDER BY h.ord, h.label) - 1 AS i FROM heard h LEFT JOIN have v USING (meeting_id) WHERE NOT EXISTS (SELECT 1 FROM spk p WHERE p.meeting_id = h.meeting_id AND p.label = h.label AND p.speaker_id % 10 = 1))
SELECT meeting_id, label, display_name, 'old' AS color FROM spk WHERE speaker_id % 10 = 1 UNION ALL SELECT meeting_id, label, label, {COLOURS}[CAST(i % 10 + 1 AS INTEGER)] FROM fresh""")
def live_speakers(spark, sf):
    old = V.speakers(spark, sf).where("speaker_id % 10 = 1").select("meeting_id", "label", F.col("speaker_id").cast("string").alias("speaker_id"), "display_name", F.lit("old").alias("color"))
    heard = V.segments(spark, sf).select("meeting_id", F.concat(F.lit("SPEAKER_0"), "spk").alias("label"), "ord")
    return jobs.get_or_create(old, heard).select("meeting_id", "label", "display_name", "color")


@query("""WITH m AS (SELECT user_id AS recording, event_id // 3 AS arrival, event_id, CASE event_type WHEN 'error' THEN 'polish_complete' WHEN 'click' THEN 'progress' ELSE 'live_segment' END AS kind FROM events), l AS (SELECT recording, max(arrival) AS a FROM m WHERE kind = 'polish_complete' GROUP BY 1)
SELECT m.recording, event_id FROM m LEFT JOIN l USING (recording) WHERE kind <> 'progress' AND (a IS NULL OR arrival = a OR (arrival > a AND kind = 'live_segment'))""", views=False)
def client_lists(spark, sf):
    t = F.col("event_type")
    m = V.table(spark, sf, "events").select(F.col("user_id").alias("recording"), F.floor(F.col("event_id") / 3).alias("arrival"), "event_id", F.when(t == "error", "polish_complete").when(t == "click", "progress").otherwise("live_segment").alias("kind"))
    return jobs.client_rows(m).select("recording", "event_id")


LIVE_SQL = r"""WITH RECURSIVE c AS (SELECT user_id AS recording, event_id AS arrival, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, value * 20 AS loudness, CASE WHEN event_id % 7 = 0 THEN CAST(1.5 AS DOUBLE) ELSE CAST(3.5 AS DOUBLE) END AS stop,
  trim(CASE WHEN event_id % 13 = 0 THEN '<|x|>' ELSE event_type || ' ' || props END) AS said, list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM events v LEFT JOIN embeddings e ON e.vec_id = v.event_id % (SELECT max(vec_id) + 1 FROM embeddings)),
g AS (SELECT *, loudness >= 500 AND NOT contains(said, '<|') AND NOT contains(said, '|>') AND length(said) > 2 AS voiced, (k - 1) * CAST(4 AS DOUBLE) AS clk, list_filter(regexp_split_to_array(said, '\s+'), lambda x: x <> '') AS w FROM c),
v AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY arrival) AS n FROM g WHERE voiced),
s AS (SELECT recording, n, arrival, clk, stop, said, w, [e] AS centroids, 1 AS label, CAST([] AS VARCHAR[]) AS before, w AS words FROM v WHERE n = 1 AND stop >= 2 AND e IS NOT NULL AND len(e) > 0
  UNION ALL SELECT recording, n, arrival, clk, stop, said, w, CAST([] AS DOUBLE[][]), 1, CAST([] AS VARCHAR[]), w FROM v WHERE n = 1 AND NOT (stop >= 2 AND e IS NOT NULL AND len(e) > 0)
  UNION ALL
  SELECT x.recording, x.n, x.arrival, x.clk, x.stop, x.said, x.w,
    CASE WHEN NOT x.full THEN x.centroids WHEN x.best IS NOT NULL THEN list_transform(x.centroids, lambda c, i: CASE WHEN i = x.best THEN list_transform(c, lambda y, j: y * 0.7::DOUBLE + x.e[j] * 0.3::DOUBLE) ELSE c END) ELSE list_append(x.centroids, x.e) END,
    CASE WHEN NOT x.full THEN greatest(1, len(x.centroids)) WHEN x.best IS NOT NULL THEN x.best ELSE len(x.centroids) + 1 END, x.words, list_concat(x.words, x.w)[-60:]
  FROM (SELECT y.*, CASE WHEN y.full AND list_max(y.sims) >= 0.45 THEN list_position(y.sims, list_max(y.sims)) END AS best FROM (
    SELECT v.recording, v.n, v.arrival, v.clk, v.stop, v.said, v.w, v.e, s.centroids, s.words, v.stop >= 2 AND v.e IS NOT NULL AND len(v.e) > 0 AS full, list_transform(s.centroids, lambda c: list_cosine_similarity(c, v.e)) AS sims FROM s JOIN v ON v.recording = s.recording AND v.n = s.n + 1) y) x)
SELECT recording, arrival, 'segment' AS kind, CAST(n AS BIGINT) AS ord, round(clk, 3) AS start_time, round(clk + stop, 3) AS end_time, said AS text, 'Speaker ' || label AS speaker_label, CASE WHEN len(before) > 0 THEN array_to_string(before[-30:], ' ') END AS prompt, clk + 4 AS clock FROM s"""
POLISH_SQL = """ UNION ALL SELECT recording, arrival, 'polish', p.i, NULL, NULL, NULL, NULL, NULL, clk + 4 FROM g JOIN (SELECT i, CASE WHEN i <= 5 THEN i * 60 ELSE (i - 4) * 300 END AS t FROM (SELECT unnest(range(1, 7 + CAST((SELECT max(k) FROM c) // 15 AS BIGINT))) AS i)) p ON clk + 4 >= p.t AND clk < p.t"""


@query(LIVE_SQL + POLISH_SQL, views=False)
def live_assign(spark, sf):
    """Chunks of live recordings folded in order: clock, gate, speakers by centroid, prompts, polish marks."""
    return live.live_batch(V.live_chunks(spark, sf))


@query("SELECT l_quantity * 30 AS t, l_linenumber - 1 AS count, l_quantity * 30 >= 60 AND l_quantity * 30 >= CASE WHEN l_linenumber - 1 < 5 THEN l_linenumber * 60 ELSE (l_linenumber - 4) * 300 END AS due FROM lineitem", views=False)
def polish_schedule(spark, sf):
    l = V.table(spark, sf, "lineitem").select((F.col("l_quantity") * 30).alias("t"), (F.col("l_linenumber") - 1).alias("count"))
    return l.withColumn("due", chunks.polish_due("t", "count"))
