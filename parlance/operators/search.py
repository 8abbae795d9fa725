"""Ranked search over utterances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import exprs as X


def search(segments: DataFrame, meetings: DataFrame, speakers: DataFrame, q: str, limit: int = 100) -> DataFrame:
    """The ``limit`` best hits: all query words present, or the query as a substring (% and _ are wildcards).

    Rank: share of the utterance's words that are query words (0 for substring hits alone). Order: rank,
    newer recordings, place in the recording. Utterances without a speaker stay; encrypted ones are not
    searched where ``is_encrypted`` is there.
    """
    terms = F.array_distinct(X.tokens(F.lit(q)))
    s = segments.withColumn("_w", X.tokens("text"))
    every = (F.size(terms) > 0) & F.forall(terms, lambda t: F.array_contains(F.col("_w"), t))
    rank = F.when(every, F.size(F.filter("_w", lambda w: F.array_contains(terms, w))) / F.size("_w")).otherwise(F.lit(0.0))
    hits = s.withColumn("rank", rank).where(every | F.col("text").ilike(f"%{q}%")).drop("_w")
    m = meetings.where(~F.coalesce("is_encrypted", F.lit(False))) if "is_encrypted" in meetings.columns else meetings
    out = hits.join(m.select("meeting_id", "title", "created_at"), "meeting_id").join(speakers.select("meeting_id", "speaker_id", F.col("display_name").alias("speaker_name")), ["meeting_id", "speaker_id"], "left")
    cols = ["meeting_id", "title", "ord", "start_time", "end_time", "text", "speaker_name", "rank", "created_at"]
    return out.select(*cols).orderBy(F.desc("rank"), F.desc("created_at"), "meeting_id", "ord").limit(limit)


def grouped(hits: DataFrame) -> DataFrame:
    """Hits by recording, recordings and hits in order of rank."""
    w = Window.orderBy(F.desc("rank"), F.desc("created_at"), "meeting_id", "ord")  # at most ``limit`` rows
    h = hits.withColumn("pos", F.row_number().over(w))
    g = h.groupBy("meeting_id", "title").agg(F.min("pos").alias("first"), F.array_sort(F.collect_list(F.struct("pos", "ord", "start_time", "end_time", "text", "speaker_name"))).alias("segments"))
    return g.orderBy("first")


def top_per_meeting(hits: DataFrame, n: int = 5) -> DataFrame:
    w = Window.partitionBy("meeting_id").orderBy(F.desc("rank"), "ord")
    return hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def totals(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count("*").alias("hits"), F.count_distinct("meeting_id").alias("meetings"))
