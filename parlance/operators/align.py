"""Interval operators: alignment by overlap, nearest in time, match within a tolerance, containment.

Overlap, tolerance and containment are equi-joins on (recording, time bucket), so the cost follows the
number of rows that are close in time, not the product of a recording's rows, and a long recording spreads
over many tasks. Rows that meet in several buckets give the same candidate twice, which the extremes below
ignore. The nearest in time is found by ordered scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import exprs as X

BUCKET = 60.0


def align(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """Every utterance with the speaker of the turn that overlaps it most.

    Of equal overlaps the first turn (by ``di``) wins; without any, the first turn that contains the
    midpoint; else UNKNOWN. Every utterance yields one row.
    """
    s = segments.withColumn("bucket", F.explode_outer(X.buckets("start_time", "end_time", BUCKET)))
    t = turns.withColumn("bucket", F.explode(X.buckets("ds", "de", BUCKET)))
    both, ov, mid = s.join(t, ["meeting_id", "bucket"], "left"), X.overlap("start_time", "end_time", "ds", "de"), (F.col("start_time") + F.col("end_time")) / 2
    carried = [c for c in segments.columns if c not in ("meeting_id", "ord")]
    out = both.groupBy("meeting_id", "ord").agg(
        *(F.first(c).alias(c) for c in carried),
        X.largest_first(ov, F.col("di"), F.col("lab"), when=ov > 0)["lab"].alias("_most"),
        X.smallest_first(F.col("di"), F.col("lab"), when=(F.col("ds") <= mid) & (mid <= F.col("de")))["lab"].alias("_at"),
    )
    return out.withColumn("speaker", F.coalesce(F.nullif(F.coalesce("_most", "_at"), F.lit("")), F.lit("UNKNOWN"))).drop("_most", "_at")


def nearest_reassign(segments: DataFrame, keep: int = 2) -> DataFrame:
    """``new_speaker_id``: utterances of speakers with fewer than ``keep`` go to the nearest larger speaker.

    Distance is between midpoints. Ties go to the speaker who appeared first, then to the earlier
    utterance. Utterances without a speaker count as a group, which never receives. The nearest before and
    the nearest after come from two ordered scans, so a recording costs a sort, not pairs.
    """
    w = Window.partitionBy("meeting_id", "speaker_id")
    s = segments.select("meeting_id", "ord", "speaker_id", X.midpoint("start_time", "end_time").alias("mid")).withColumns({"n": F.count("*").over(w), "first_ord": F.min("ord").over(w)})
    # A speaker who is large, at this midpoint; of several at one midpoint the first.
    at = F.min(F.when((F.col("n") >= keep) & F.col("speaker_id").isNotNull(), F.struct("first_ord", "ord", "speaker_id", "mid"))).over(Window.partitionBy("meeting_id", "mid"))
    scan = Window.partitionBy("meeting_id").orderBy("mid")
    s = s.withColumn("at", at).withColumns({
        "back": F.last("at", ignorenulls=True).over(scan.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
        "ahead": F.first("at", ignorenulls=True).over(scan.rangeBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    near = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("mid") - F.col(f"{c}.mid")).alias("d"), F.col(f"{c}.first_ord"), F.col(f"{c}.ord"), F.col(f"{c}.speaker_id").alias("to")))
    best = s.where(F.col("n") < keep).select("meeting_id", "ord", F.least(near("back"), near("ahead"))["to"].alias("to"))
    return segments.join(best, ["meeting_id", "ord"], "left").withColumn("new_speaker_id", F.coalesce("to", "speaker_id")).drop("to")


def preserve_edits(new: DataFrame, old: DataFrame, tolerance: float = 1.5) -> DataFrame:
    """New utterances with the text of the first edited old one whose both ends lie within the tolerance."""
    edited = old.where("is_edited").select("meeting_id", F.col("ord").alias("e_ord"), F.col("start_time").alias("e_start"), F.col("end_time").alias("e_end"), F.col("text").alias("e_text"), F.floor(F.col("start_time") / tolerance).alias("bucket"))
    at = F.floor(F.col("start_time") / tolerance)
    near = new.select("meeting_id", "ord", "start_time", "end_time", F.explode(F.array(at - 1, at, at + 1)).alias("bucket")).join(edited, ["meeting_id", "bucket"])
    near = near.where((F.abs(F.col("start_time") - F.col("e_start")) < tolerance) & (F.abs(F.col("end_time") - F.col("e_end")) < tolerance))
    hit = near.groupBy("meeting_id", "ord").agg(X.smallest_first(F.col("e_ord"), F.col("e_text")).alias("hit"))
    out = new.drop("is_edited", "original_text").join(hit, ["meeting_id", "ord"], "left")
    return out.withColumns({"original_text": F.col("text"), "text": F.when(F.col("hit").isNotNull(), F.col("hit.e_text")).otherwise(F.col("text")), "is_edited": F.col("hit").isNotNull()}).drop("hit")


def at_position(segments: DataFrame, positions: DataFrame) -> DataFrame:
    """The utterance that holds a position (start <= t < end), the first by ``ord``; null without one."""
    p = positions.withColumn("bucket", F.floor(F.col("t") / BUCKET))
    s = segments.select("meeting_id", "ord", "start_time", "end_time", F.explode(X.buckets("start_time", "end_time", BUCKET)).alias("bucket"))
    both = p.join(s, ["meeting_id", "bucket"], "left")
    return both.groupBy("meeting_id", "t").agg(F.min(F.when((F.col("start_time") <= F.col("t")) & (F.col("t") < F.col("end_time")), F.col("ord"))).alias("ord"))
