"""Queries that run as streams, replayed from files with a restart from the checkpoint between slices, and queries over committed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import mutate
from parlance.plans.catalogue import JOBS_SQL, _job_meetings
from parlance.plans.changes import LIVE_SQL, POLISH_SQL
from parlance.plans.registry import query
from parlance.sources import views as V
from parlance.sources.committed import KeyedTable
from parlance.sources.folders import shared_folder
from parlance.streaming import live
from parlance.streaming.replay import replay

LIVE_KEYS = ["recording", "arrival", "kind", "ord"]


@query(LIVE_SQL + POLISH_SQL, views=False)
def live_stream_assign(spark, sf):
    """As ``live_assign``, by a stream with keyed state; it stops in the middle and goes on from its checkpoint."""
    return replay(V.live_chunks(spark, sf), "arrival", live.live_stream, LIVE_KEYS)


_HEAD, _TAIL = LIVE_SQL.split("\nSELECT recording, arrival, 'segment'")
STOP_SQL = (
    _HEAD.replace(
        "FROM events v",
        "FROM (SELECT user_id * 1000000 + part AS user_id, event_id, event_type, value, props FROM ends WHERE event_id % 29 <> 0) v",
    ).replace("WITH RECURSIVE c AS", "WITH RECURSIVE ends AS (SELECT *, coalesce(count(*) FILTER (event_id % 29 = 0) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM events), c AS")
    + f", live_rows AS (SELECT recording, arrival, 'segment'{_TAIL}{POLISH_SQL})"
    + """, totals AS (SELECT recording, count(*) AS chunks, count(*) FILTER (voiced) AS n FROM g GROUP BY 1)
SELECT recording // 1000000 AS recording, * EXCLUDE (recording) FROM live_rows
UNION ALL SELECT user_id, event_id, 'stopped', coalesce(t.n, 0), NULL, NULL, NULL, NULL, NULL, coalesce(t.chunks, 0) * CAST(4 AS DOUBLE) FROM ends LEFT JOIN totals t ON t.recording = user_id * 1000000 + part WHERE event_id % 29 = 0"""
)


@query(STOP_SQL, views=False)
def live_stream_stops(spark, sf):
    """Recordings that end and begin anew: a stop gives its row and clears the recording's state."""
    return replay(V.live_chunks(spark, sf).withColumn("stop", F.col("arrival") % 29 == 0), "arrival", live.live_stream, LIVE_KEYS)


@query(STOP_SQL, views=False)
def live_stops(spark, sf):
    """The same folded in one batch."""
    return live.live_batch(V.live_chunks(spark, sf).withColumn("stop", F.col("arrival") % 29 == 0))


@query("SELECT 'meeting:' || user_id AS key, event_id AS arrival, 'progress' AS type, CAST(floor(value) AS BIGINT) AS progress FROM events WHERE event_id % 9 = 4", views=False)
def relayed_stream(spark, sf):
    """Messages of many kinds published to channels; a live client's relay passes its kinds on, each exactly once."""
    kinds = F.array(*map(F.lit, [*live.RELAYED, "live_segment", "pong", "speaker_reassignment"]))
    m = V.table(spark, sf, "events").select("event_id", F.col("user_id").alias("meeting_id"), F.element_at(kinds, (F.col("event_id") % 9 + 1).cast("int")).alias("type"), F.col("value").cast("long").alias("progress"))

    def relay(messages):
        from parlance.operators import render

        sent = render.events(messages.withColumn("arrival", F.col("event_id")).drop("event_id"))
        own = live.relayed(sent).withColumn("m", F.from_json("value", "arrival long, type string, progress long"))
        return own.where("m.type = 'progress'").select("key", "m.arrival", "m.type", "m.progress")

    return replay(m, "event_id", relay, ["arrival"])


SESSION_SQL = """WITH first AS (SELECT * FROM events WHERE event_id % 10 <> 0), wm AS (SELECT max(ts) - INTERVAL 10 MINUTES AS mark FROM first),
a AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL {gap} THEN 1 ELSE 0 END AS new FROM first WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a), c AS (SELECT *, max(ts) OVER (PARTITION BY user_id, s) + INTERVAL {gap} AS ends FROM b),
late AS (SELECT user_id, ts, value FROM events, wm WHERE event_id % 10 = 0 AND ts + INTERVAL {gap} > mark),
rest AS (SELECT user_id, ts, value FROM c, wm WHERE ends > mark UNION ALL SELECT * FROM late),
d AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL {gap} THEN 1 ELSE 0 END AS new FROM rest WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
e AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM d)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL {gap} AS session_end, count(*) AS n, round(sum(value), 4) AS total FROM c, wm WHERE ends <= mark GROUP BY user_id, s
UNION ALL SELECT user_id, min(ts), max(ts) + INTERVAL {gap}, count(*), round(sum(value), 4) FROM e GROUP BY user_id, s"""


@query(SESSION_SQL.format(gap="2 HOURS"), views=False)
def session_stream(spark, sf):
    """Sessions of users over two slices; a tenth of the events comes in the second, and what is too late is dropped."""
    e = V.table(spark, sf, "events").select("user_id", "ts", "value", (F.col("event_id") % 10 == 0).cast("int").alias("slice"))
    # A last row far ahead moves the watermark beyond all sessions.
    ahead = e.agg(F.lit(None).cast("bigint").alias("user_id"), (F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit(0.0).alias("value"), F.lit(2).alias("slice"))
    found = replay(e.unionByName(ahead), "slice", lambda s: live.sessions(s, "2 hours"), ["user_id", "session_start"], cuts=[0, 1])
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return found.where("user_id is not null").select("user_id", ntz("session_start"), ntz("session_end"), "n", F.round("total", 4).alias("total"))


@query("SELECT event_id, user_id, value FROM events", views=False)
def redelivered_stream(spark, sf):
    """Messages of which a third comes a second time, after a restart: each counts once."""
    e = V.table(spark, sf, "events").select("event_id", "user_id", "value", "ts", F.lit(0).alias("slice"))
    again = e.where("event_id % 3 = 0").withColumn("slice", F.lit(1))
    return replay(e.unionByName(again), "slice", lambda s: live.delivered_once(s, "event_id").select("event_id", "user_id", "value"), ["event_id"], cuts=[0])


@query("""SELECT c.user_id AS recording, c.event_id AS chunk_id, t.event_id AS transcript_id FROM events c JOIN events t ON t.user_id = c.user_id AND c.event_id % 2 = 0 AND t.event_id % 2 = 1 AND t.ts >= c.ts AND t.ts < c.ts + INTERVAL 12 HOURS""", views=False)
def transcribed_stream(spark, sf):
    """Two streams joined by recording and time: chunks and the transcripts that follow them."""
    e = V.table(spark, sf, "events").select("event_id", F.col("user_id").alias("recording"), "ts")

    def joined(s):
        chunks = s.where("event_id % 2 = 0").withColumnRenamed("event_id", "chunk_id")
        return live.transcribed(chunks, s.where("event_id % 2 = 1").withColumnRenamed("event_id", "transcript_id"), "12 HOURS").select("recording", "chunk_id", "transcript_id")

    return replay(e.withColumn("second", F.unix_seconds(F.col("ts").cast("timestamp"))), "second", joined, ["chunk_id", "transcript_id"])


# --- committed tables ---------------------------------------------------------------------------------


@query(JOBS_SQL + """, a AS (SELECT *, meeting_id % 3 = 0 AND status NOT IN ('processing', 'finalizing') AS first FROM m),
b AS (SELECT *, meeting_id % 2 = 0 AND NOT first AND status NOT IN ('processing', 'finalizing') AS second FROM a)
SELECT meeting_id, CASE WHEN first OR second THEN 'processing' ELSE status END AS status, first AS by_first, CASE WHEN meeting_id % 2 = 0 THEN second END AS by_second FROM b""", views=False)
def committed_starts(spark, sf):
    """Two writers start recordings one after the other: the second gets the busy answer for what the first has started."""
    m = _job_meetings(spark, sf)
    table = KeyedTable(spark, shared_folder(spark, "starts"), "meeting_id")
    table.merge(m)
    first = mutate.start_committed(table, m.where("meeting_id % 3 = 0")).withColumnRenamed("started", "by_first")
    second = mutate.start_committed(table, m.where("meeting_id % 2 = 0")).withColumnRenamed("started", "by_second")
    out = table.read().join(first, "meeting_id", "left").join(second, "meeting_id", "left")
    return out.withColumn("by_first", F.coalesce("by_first", F.lit(False)))


@query(""" SELECT meeting_id, ord, text, 1 AS pass FROM seg WHERE meeting_id % 4 <> 0 UNION ALL SELECT meeting_id, ord, 'again ' || ord, 2 FROM seg WHERE meeting_id % 4 = 0 AND ord % 3 <> 1""")
def committed_recordings(spark, sf):
    """A quarter of the recordings processed again, with fewer utterances: all their rows are replaced in one version."""
    s = V.segments(spark, sf).select("meeting_id", "ord", "text", F.lit(1).alias("pass"))
    table = KeyedTable(spark, shared_folder(spark, "recordings"), "meeting_id", "ord")
    table.merge(s)
    again = s.where("meeting_id % 4 = 0 and ord % 3 <> 1").withColumns({"text": F.concat(F.lit("again "), "ord"), "pass": F.lit(2)})
    mutate.replace_recordings(table, again)
    table.compact()
    return table.read()


@query("SELECT user_id AS recording, event_type, max(event_id) AS arrival, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2", views=False)
def latest_state(spark, sf):
    """The latest value of every channel by a sequence number, though a part of the rows is written late and twice."""
    e = V.table(spark, sf, "events").select(F.col("user_id").alias("recording"), "event_type", F.col("event_id").alias("arrival"), "value")
    table = KeyedTable(spark, shared_folder(spark, "latest"), "recording", "event_type", order="arrival", fold=3)
    late = e.where("arrival % 7 = 3")
    for batch, rows in enumerate([e.where("arrival % 7 <> 3"), late, late, e.where("arrival % 5 = 0")]):
        table.sink("events")(rows, min(batch, 2))
    return table.read()
