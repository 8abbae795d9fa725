"""Vocabulary learned from corrections, and its lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.learned import learned_terms


def learn(edits: DataFrame) -> DataFrame:
    """Terms of edits (meeting_id, old_text, new_text): term, frequency, first source by meeting_id.

    Only edits whose trimmed texts differ go through Python.
    """
    changed = edits.where("old_text is not null AND new_text is not null AND trim(old_text) <> trim(new_text)")
    terms = changed.select("meeting_id", F.explode(learned_terms("old_text", "new_text")).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("frequency"), F.min("meeting_id").alias("source_meeting_id"))


def merge_terms(old: DataFrame, learned: DataFrame) -> DataFrame:
    n = learned.select("term", F.col("frequency").alias("_f"), F.col("source_meeting_id").alias("_s"))
    return old.join(n, "term", "full").select("term", (F.coalesce("frequency", F.lit(0)) + F.coalesce("_f", F.lit(0))).alias("frequency"), F.when(F.col("frequency").isNull(), F.col("_s")).otherwise(F.col("source_meeting_id")).alias("source_meeting_id"))


def top_terms(entries: DataFrame, limit: int = 200) -> DataFrame:
    return entries.orderBy(F.desc("frequency"), "term").limit(limit)


def suggested(entries: DataFrame, limit: int = 50, least: int = 2) -> DataFrame:
    """One row: the terms as a prompt text."""
    best = top_terms(entries.where(F.col("frequency") >= least), limit)
    return best.agg(F.array_sort(F.collect_list(F.struct((-F.col("frequency")).alias("f"), "term"))).alias("t")).select(F.array_join(F.transform("t", lambda x: x["term"]), ", ").alias("text"))
