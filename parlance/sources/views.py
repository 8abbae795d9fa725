"""Driver tables, and the transcript views derived from them. ``CTE`` says the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances: one per conversation turn, times in sixteenths of a second."""
    w = Window.partitionBy("meeting_id").orderBy("ord")
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("meeting_id"), F.col("turn").alias("ord"), "text", (F.length("text") / 16.0).alias("dur"))
    spk = F.floor(F.col("ord") / 2) % 3
    return t.select(
        "meeting_id", "ord", "text", F.coalesce(F.sum(F.col("dur") + 0.5).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("start_time"), "dur", spk.alias("spk"),
    ).select(
        "meeting_id", "ord", "text", "start_time", (F.col("start_time") + F.col("dur")).alias("end_time"), "spk",
        F.when((F.col("meeting_id") + F.col("ord")) % 11 != 0, F.col("meeting_id") * 10 + F.col("spk")).alias("speaker_id"),
        F.when(F.col("ord") % 5 != 4, ((F.col("meeting_id") * 7 + F.col("ord") * 3) % 16) / 16.0).alias("confidence"),
        ((F.col("meeting_id") + F.col("ord")) % 9 == 0).alias("is_edited"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker turns that drift against the utterances, with holes."""
    return segments(spark, sf_dir).where("ord % 4 <> 3").select(
        "meeting_id", F.col("ord").alias("di"), (F.col("start_time") + 0.25 * ((F.col("ord") % 3) - 1)).alias("ds"), (F.col("end_time") + 0.5 * (F.col("ord") % 2)).alias("de"), F.concat(F.lit("SPEAKER_0"), F.col("spk")).alias("lab")
    )


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).groupBy("meeting_id").agg((F.max("end_time") + 4.0).alias("duration")).select(
        "meeting_id", F.concat(F.lit("Meeting "), F.col("meeting_id")).alias("title"), "duration", F.timestamp_seconds(F.lit(1704067200) + F.col("meeting_id") * 3600).alias("created_at")
    )


def speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    said = F.col("speaker_id").isNotNull()
    return s.groupBy("meeting_id", "spk").agg(
        F.coalesce(F.sum(F.when(said, F.col("end_time") - F.col("start_time"))), F.lit(0.0)).alias("total_speaking_time"), F.count(F.when(said, 1)).alias("segment_count")
    ).select(
        "meeting_id", (F.col("meeting_id") * 10 + F.col("spk")).alias("speaker_id"), F.concat(F.lit("SPEAKER_0"), F.col("spk")).alias("label"),
        F.when(F.col("spk") != 2, F.concat(F.lit("Person "), F.col("meeting_id") * 10 + F.col("spk"))).alias("display_name"), "total_speaking_time", "segment_count",
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored voices: per label the mean vector of the even vec_ids."""
    e = table(spark, sf_dir, "embeddings").where("vec_id % 2 = 0").select("label", F.posexplode("embedding").alias("i", "x"))
    means = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding")).select(F.col("label").alias("profile_id"), F.concat(F.lit("Voice "), F.col("label")).alias("name"), "embedding")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 2 = 1").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: how many ids the vectors span, to deal them out to other tables."""
    return table(spark, sf_dir, "embeddings").agg((F.coalesce(F.max("vec_id"), F.lit(0)) + 1).alias("vectors"))


def live_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live chunks of a recording (user) in arrival order (event_id): 4 seconds each, one utterance."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")  # the fold widens single vectors; columns stay narrow
    v = table(spark, sf_dir, "events").crossJoin(F.broadcast(vectors(spark, sf_dir)))  # one row
    return v.withColumn("vec_id", F.col("event_id") % F.col("vectors")).join(e, "vec_id", "left").select(
        F.col("user_id").alias("recording"), F.col("event_id").alias("arrival"), F.lit(4.0).alias("seconds"), (F.col("value") * 20).alias("loudness"),
        F.lit(0.0).alias("start"), F.when(F.col("event_id") % 7 == 0, 1.5).otherwise(3.5).alias("end"), F.when(F.col("event_id") % 13 == 0, F.lit("<|x|>")).otherwise(F.concat_ws(" ", "event_type", "props")).alias("text"), "embedding",
    )


#: The same views in SQL; a query that uses them starts with ``WITH {CTE}``.
CTE = """
seg0 AS (
  SELECT conv_id AS meeting_id, turn AS ord, text, CAST(length(text) AS DOUBLE) / 16 AS dur, (turn // 2) % 3 AS spk FROM conversations
), seg1 AS (
  SELECT *, coalesce(sum(dur + 0.5) OVER (PARTITION BY meeting_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_time FROM seg0
), seg AS (
  SELECT meeting_id, ord, text, start_time, start_time + dur AS end_time, spk,
    CASE WHEN (meeting_id + ord) % 11 <> 0 THEN meeting_id * 10 + spk END AS speaker_id,
    CASE WHEN ord % 5 <> 4 THEN CAST((meeting_id * 7 + ord * 3) % 16 AS DOUBLE) / 16 END AS confidence,
    (meeting_id + ord) % 9 = 0 AS is_edited FROM seg1
), diar AS (
  SELECT meeting_id, ord AS di, start_time + CAST(0.25 AS DOUBLE) * ((ord % 3) - 1) AS ds, end_time + CAST(0.5 AS DOUBLE) * (ord % 2) AS de, 'SPEAKER_0' || spk AS lab FROM seg WHERE ord % 4 <> 3
), mtg AS (
  SELECT meeting_id, 'Meeting ' || meeting_id AS title, max(end_time) + 4 AS duration, TIMESTAMP '2024-01-01' + to_hours(meeting_id) AS created_at FROM seg GROUP BY meeting_id
), spk AS (
  SELECT meeting_id, meeting_id * 10 + spk AS speaker_id, 'SPEAKER_0' || spk AS label, CASE WHEN spk <> 2 THEN 'Person ' || (meeting_id * 10 + spk) END AS display_name,
    coalesce(sum(CASE WHEN speaker_id IS NOT NULL THEN end_time - start_time END), 0) AS total_speaking_time, count(speaker_id) AS segment_count
  FROM seg GROUP BY meeting_id, spk
)
"""
