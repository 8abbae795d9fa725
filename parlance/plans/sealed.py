"""Queries over authenticated tokens, mergeable summaries and audio samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import office, tokens
from parlance.operators import summaries
from parlance.plans.registry import query
from parlance.sources import audio
from parlance.sources import views as V


@query("""SELECT meeting_id, ord, text AS opened, CASE WHEN ord % 3 = 0 THEN NULL ELSE text END AS opened_changed, CASE WHEN ord % 2 = 0 THEN text END AS opened_in_time, 4 * ceil((57 + (octet_length(encode(text)) // 16 + 1) * 16) / 3.0)::BIGINT AS size FROM seg""", views=True)
def sealed_texts(spark, sf):
    """Utterances sealed with a key per recording: opened again, refused where a byte has changed or the time is over."""
    s = V.segments(spark, sf).withColumn("key", F.unhex(F.sha2(F.col("meeting_id").cast("string").cast("binary"), 256)))
    at = F.lit(1_700_000_000) + F.col("ord")
    vector = F.unhex(F.md5(F.concat_ws("/", "meeting_id", "ord").cast("binary")))
    t = s.withColumn("token", tokens.sealed(F.col("text"), F.col("key"), at, vector))
    place = F.length("token") - 60
    last = F.substring("token", place, F.lit(1))
    changed = F.when(F.col("ord") % 3 == 0, F.concat(F.substring("token", F.lit(1), place - 1), F.when(last == "A", "B").otherwise("A"), F.substring("token", place + 1, F.lit(60)))).otherwise(F.col("token"))
    now = at + F.when(F.col("ord") % 2 == 0, 60).otherwise(61)
    return t.select("meeting_id", "ord", tokens.unsealed(F.col("token"), F.col("key")).alias("opened"), tokens.unsealed(changed, F.col("key")).alias("opened_changed"), tokens.unsealed(F.col("token"), F.col("key"), now, 60).alias("opened_in_time"), F.length("token").cast("long").alias("size"))


def _daily(spark, sf):
    e = V.table(spark, sf, "events").select(F.to_date("ts").alias("day"), (F.col("user_id") % 10).alias("owner"), "event_type", "user_id", "value")
    return summaries.stored(e, ["day", "owner", "event_type"], "user_id", "value")


@query("""WITH e AS (SELECT CAST(ts AS DATE) AS day, user_id % 10 AS owner, event_type, value FROM events)
SELECT day, owner, event_type, grouping_id(day, owner, event_type) AS level, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY GROUPING SETS ((day, owner), (owner, event_type), (event_type), (day), ())""", views=False)
def summary_sets(spark, sf):
    """Several groupings at once from the stored daily summaries."""
    out = summaries.in_sets(_daily(spark, sf), [["day", "owner"], ["owner", "event_type"], ["event_type"], ["day"], []])
    return out.select("day", "owner", "event_type", "level", "n", F.round("total", 4).alias("total"))


@query("""WITH e AS (SELECT user_id % 10 AS owner, user_id, value FROM events), x AS (SELECT owner, count(*) AS n, count(DISTINCT user_id) AS people, list_sort(list(value)) AS v FROM e GROUP BY 1)
SELECT owner, n, people, true AS people_near, [true, true, true]::VARCHAR AS ranks_near FROM x""", views=False)
def summary_estimates(spark, sf):
    """Merged sketches against exact figures: people within 5 %, quantiles within 3 % of their rank."""
    e = V.table(spark, sf, "events").select((F.col("user_id") % 10).alias("owner"), "user_id", "value")
    exact = e.groupBy("owner").agg(F.count_distinct("user_id").alias("exact"))
    m = summaries.merged(_daily(spark, sf), "owner").join(exact, "owner")
    cuts = m.select("owner", F.posexplode("quantiles").alias("i", "cut"))
    ranks = e.join(F.broadcast(cuts), "owner").groupBy("owner", "i").agg(F.avg((F.col("value") < F.col("cut")).cast("int")).alias("below"), F.avg((F.col("value") <= F.col("cut")).cast("int")).alias("upto"))
    want = F.element_at(F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)), F.col("i") + 1)
    near = ranks.select("owner", "i", ((F.col("below") - 0.03 <= want) & (F.col("upto") + 0.03 >= want)).alias("near")).groupBy("owner").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "near"))), lambda s: s["near"]).alias("r"))
    text = F.concat(F.lit("["), F.array_join(F.transform("r", lambda b: b.cast("string")), ", "), F.lit("]"))
    return m.join(near, "owner").select("owner", "n", F.col("exact").alias("people"), (F.abs(F.col("people") / F.col("exact") - 1) <= 0.05).alias("people_near"), text.alias("ranks_near"))


@query("""WITH d AS (SELECT doc_id, hex(encode(CASE WHEN octet_length(encode(text)) % 2 = 0 THEN text ELSE text || ' ' END)) AS h FROM documents WHERE text IS NOT NULL AND text <> ''),
p AS (SELECT doc_id, list_transform(range(0, len(h) // 4), lambda i: (strpos('0123456789ABCDEF', h[4*i+3]) - 1) * 4096 + (strpos('0123456789ABCDEF', h[4*i+4]) - 1) * 256 + (strpos('0123456789ABCDEF', h[4*i+1]) - 1) * 16 + strpos('0123456789ABCDEF', h[4*i+2]) - 1) AS u FROM d)
SELECT doc_id, len(u) / CAST(16000 AS DOUBLE) AS seconds, round(sqrt(list_avg(list_transform(u, lambda x: CASE WHEN x >= 32768 THEN x - 65536 ELSE x END * CAST(CASE WHEN x >= 32768 THEN x - 65536 ELSE x END AS DOUBLE)))), 3) AS rms FROM p""", views=False)
def audio_levels(spark, sf):
    """Length and level of audio files read back as samples (the bytes of texts stand for samples)."""
    even = F.when(F.octet_length("text") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" ")))
    files = V.table(spark, sf, "documents").where("text is not null and text <> ''").select("doc_id", office.wav_file(even.cast("binary")).alias("content"))
    found = audio.levels(audio.samples(files, keys=("doc_id",), seconds=0.5), "doc_id")
    return found.select("doc_id", "seconds", F.round("rms", 3).alias("rms"))
