"""Speakers: naming, numbering, colours, voice profiles, merging, statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance import schemas
from parlance.functions import exprs as X

MAX_PROFILES = 10_000


def speaker_stats(segments: DataFrame, key: str = "speaker_id") -> DataFrame:
    return segments.groupBy("meeting_id", key).agg(F.count("*").alias("segment_count"), F.coalesce(F.sum(F.col("end_time") - F.col("start_time")), F.lit(0.0)).alias("total_speaking_time"))


def refreshed(speakers: DataFrame, segments: DataFrame) -> DataFrame:
    """Stored statistics recomputed; speakers without utterances get zeros."""
    return speakers.drop("segment_count", "total_speaking_time").join(speaker_stats(segments), ["meeting_id", "speaker_id"], "left").fillna({"segment_count": 0, "total_speaking_time": 0.0})


def name_speakers(labels: DataFrame, named: DataFrame) -> DataFrame:
    """All speakers of a recording: (meeting_id, label, display_name, identified_by, confidence, color).

    ``named`` are those found by name (labels that no turn has included); other labels become
    "Participant N", numbered by label after the named ones. Colours go by sorted label. UNKNOWN, if
    present in ``labels``, comes last with its own colour.
    """
    known = labels.select("meeting_id", "label").distinct()
    plain = known.where(F.col("label") != schemas.UNKNOWN_LABEL)
    before = named.groupBy("meeting_id").agg(F.count("*").alias("offset"))
    w = Window.partitionBy("meeting_id").orderBy("label")
    rest = plain.join(named.select("meeting_id", "label"), ["meeting_id", "label"], "left_anti").join(before, "meeting_id", "left").withColumn("n", F.row_number().over(w))
    numbered = rest.select("meeting_id", "label", F.format_string("Participant %d", F.col("n") + F.coalesce("offset", F.lit(0))).alias("display_name"), F.lit(None).cast("string").alias("identified_by"), F.lit(None).cast("double").alias("confidence"))
    everyone = named.select("meeting_id", "label", "display_name", "identified_by", "confidence").unionByName(numbered)
    palette = F.array(*map(F.lit, schemas.PALETTE))
    coloured = everyone.withColumn("color", F.element_at(palette, ((F.row_number().over(w) - 1) % len(schemas.PALETTE) + 1).cast("int")))
    unknown = known.where(F.col("label") == schemas.UNKNOWN_LABEL).select("meeting_id", "label", F.lit(schemas.UNKNOWN_NAME).alias("display_name"), F.lit(None).cast("string").alias("identified_by"), F.lit(None).cast("double").alias("confidence"), F.lit(schemas.UNKNOWN_COLOR).alias("color"))
    return coloured.unionByName(unknown)


def intro_names(answers: DataFrame) -> DataFrame:
    """Names out of a model's answers (meeting_id, label, name): blank ones are dropped, the last of a label wins."""
    ok = answers.where("coalesce(label, '') <> '' AND coalesce(name, '') <> ''")
    return ok.groupBy("meeting_id", "label").agg(F.max(F.struct("pos", "name"))["name"].alias("display_name")).select("meeting_id", "label", "display_name", F.lit("intro_llm").alias("identified_by"), F.lit(0.8).alias("confidence"))


def polish_names(speakers: DataFrame, answers: DataFrame) -> DataFrame:
    """Names of a polish pass laid over the speakers by label."""
    found = answers.select("meeting_id", "label", F.col("name").alias("_name"))
    hit = F.coalesce(F.col("_name"), F.lit("")) != ""
    return speakers.join(found, ["meeting_id", "label"], "left").withColumns({"display_name": F.when(hit, F.col("_name")).otherwise(F.col("display_name")), "identified_by": F.when(hit, F.lit("polish_llm")).otherwise(F.col("identified_by")), "confidence": F.when(hit, F.lit(0.7)).otherwise(F.col("confidence"))}).drop("_name")


def longest_turn(turns: DataFrame, least: float = 2.0) -> DataFrame:
    """Per label the longest turn (the first of equals), if it lasts at least ``least`` seconds."""
    best = turns.groupBy("meeting_id", "lab").agg(X.largest_first(F.col("de") - F.col("ds"), F.col("di"), F.col("ds"), F.col("de")).alias("t"))
    return best.where(F.col("t.key") >= least).select("meeting_id", F.col("lab").alias("label"), "t.ds", "t.de", F.least(F.col("t.key"), F.lit(15.0)).alias("clip"))


def _nearest(sent):
    """The most similar voice of a sent block (ids, names, unit vectors) as a column function."""

    @F.pandas_udf("s double, id string, name string")
    def nearest(e: pd.Series) -> pd.DataFrame:
        ids, names, unit = sent.value
        found = pd.DataFrame({"s": np.full(len(e), np.nan), "id": None, "name": None}, dtype=object)
        rows = [i for i, x in enumerate(e) if x is not None and len(x) == unit.shape[1]] if len(ids) else []
        if rows:
            x = np.stack([np.asarray(e.iloc[i], dtype=np.float64) for i in rows])
            n = np.linalg.norm(x, axis=1, keepdims=True)
            score = np.divide(x, n, out=np.zeros_like(x), where=n > 0) @ unit.T
            # Equal voices may differ in the last place of the product: within it the least id counts.
            at = (score >= score.max(axis=1, keepdims=True) - 1e-15).argmax(axis=1)
            best = score[np.arange(len(rows)), at]
            found.loc[rows, "s"], found.loc[rows, "id"], found.loc[rows, "name"] = best, [ids[k] for k in at], [names[k] for k in at]
        return found.astype({"s": float})

    return nearest


def match_profiles(probes: DataFrame, profiles: DataFrame, threshold: float = 0.55, block: int = MAX_PROFILES) -> DataFrame:
    """Probes with the most similar profile: name, similarity; nulls below the threshold.

    The profiles are normalised once and travel as one matrix of at most about ``block`` voices, one after the
    other where a user has more; a batch of probes is scored by one product. Of equal similarities the least
    profile_id wins. Probes without a vector, or of another length than all voices, match none.
    """
    spark = probes.sparkSession
    blocks = max(1, -(-profiles.count() // block))
    own = profiles.where("embedding is not null").select(F.col("profile_id").cast("string").alias("id"), "name", "embedding")
    out = probes.withColumn("_best", F.lit(None).cast("struct<s:double,id:string,name:string>"))
    for b in range(blocks):
        part = own.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b) if blocks > 1 else own
        voices = sorted((r.id, r.name, list(r.embedding)) for r in part.collect())  # a block
        size = len(voices[0][2]) if voices else 0
        voices = [v for v in voices if len(v[2]) == size]
        matrix = np.array([v[2] for v in voices], dtype=np.float64).reshape(len(voices), size)
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        sent = spark.sparkContext.broadcast(([v[0] for v in voices], [v[1] for v in voices], np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)))

        x, a = _nearest(sent)("embedding"), F.col("_best")
        out = out.withColumn("_new", x)
        x = F.col("_new")
        better = a.isNull() | a["s"].isNull() | (x["s"] > a["s"]) | ((x["s"] == a["s"]) & (x["id"] < a["id"]))
        out = out.withColumn("_best", F.when(x["id"].isNotNull() & better, x).otherwise(a)).drop("_new")
    ok = (F.col("_best.s") > 0) & (F.col("_best.s") >= threshold)
    return out.withColumns({"profile": F.when(ok, F.col("_best.name")), "similarity": F.when(ok, F.col("_best.s"))}).drop("_best")


def profile_update(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert profiles by name: a known name takes the running mean of its vector, a new one starts at 1."""
    n = new.select("name", F.col("embedding").alias("_new"))
    return old.join(n, "name", "full").select(
        "name",
        F.when(F.col("embedding").isNull(), F.col("_new")).when(F.col("_new").isNull(), F.col("embedding")).otherwise(X.running_mean("embedding", "sample_count", "_new")).alias("embedding"),
        F.when(F.col("_new").isNull(), F.col("sample_count")).otherwise(F.coalesce("sample_count", F.lit(0.0)) + 1).alias("sample_count"),
    )


def merge_speakers(speakers: DataFrame, segments: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(speakers, segments) after ``merges(meeting_id, source_id, target_id)``; only within a recording."""
    own = speakers.select("meeting_id", "speaker_id")
    ok = merges.join(own.withColumnRenamed("speaker_id", "source_id"), ["meeting_id", "source_id"], "left_semi").join(own.withColumnRenamed("speaker_id", "target_id"), ["meeting_id", "target_id"], "left_semi").where("source_id <> target_id")
    moved = segments.join(ok.select("meeting_id", F.col("source_id").alias("speaker_id"), "target_id"), ["meeting_id", "speaker_id"], "left").withColumn("speaker_id", F.coalesce("target_id", "speaker_id")).drop("target_id")
    left = speakers.join(ok.select("meeting_id", F.col("source_id").alias("speaker_id")), ["meeting_id", "speaker_id"], "left_anti")
    fresh = left.join(ok.select("meeting_id", F.col("target_id").alias("speaker_id")).distinct(), ["meeting_id", "speaker_id"], "left_semi").select("meeting_id", "speaker_id")
    stats = moved.join(fresh, ["meeting_id", "speaker_id"], "left_semi").groupBy("meeting_id", "speaker_id").agg(F.count("*").alias("n"), F.sum(F.col("end_time") - F.col("start_time")).alias("t"))
    changed = left.join(fresh.withColumn("_f", F.lit(True)), ["meeting_id", "speaker_id"], "left").join(stats, ["meeting_id", "speaker_id"], "left")
    changed = changed.withColumns({"segment_count": F.when(F.col("_f"), F.coalesce("n", F.lit(0))).otherwise(F.col("segment_count")), "total_speaking_time": F.when(F.col("_f"), F.coalesce("t", F.lit(0.0))).otherwise(F.col("total_speaking_time"))}).drop("n", "t", "_f")
    return changed, moved


def clip_budget(segments: DataFrame, budget: float = 30.0) -> DataFrame:
    """Clips per speaker in order until the budget is full; the last one is cut."""
    w = Window.partitionBy("meeting_id", "speaker_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    s = segments.where("speaker_id is not null").withColumn("before", F.coalesce(F.sum(F.col("end_time") - F.col("start_time")).over(w), F.lit(0.0)))
    return s.where(F.col("before") < budget).select("meeting_id", "speaker_id", "ord", "start_time", F.least(F.col("end_time") - F.col("start_time"), budget - F.col("before")).alias("clip"))
