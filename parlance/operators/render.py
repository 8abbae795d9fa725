"""Renderers: a recording's utterances as subtitle, text, JSON and Markdown documents, and as block rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import exprs as X
from parlance.operators.analytics import with_speaker

BOM = "﻿"


def _joined(rows: DataFrame, piece: Column, sep: str) -> DataFrame:
    g = rows.select("meeting_id", F.struct("ord", piece.alias("p")).alias("s")).groupBy("meeting_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return g.select("meeting_id", F.array_join(F.transform("s", lambda x: x["p"]), sep).alias("body"))


def _marked(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """With the number of the row, and whether the shown name differs from the row before."""
    w = Window.partitionBy("meeting_id").orderBy("ord")
    s = with_speaker(segments, speakers)
    n = F.row_number().over(w)
    return s.withColumns({"n": n, "turn": (n == 1) | (F.col("speaker_name") != F.lag("speaker_name").over(w))})


def srt(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    piece = F.concat_ws("\n", F.col("n").cast("string"), F.concat(X.srt_time("start_time"), F.lit(" --> "), X.srt_time("end_time")), F.concat(F.lit("["), "speaker_name", F.lit("] "), "text"), F.lit(""))
    return _joined(_marked(segments, speakers), piece, "\n").select("meeting_id", F.concat(F.lit(BOM), "body").alias("content"))


def vtt(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    piece = F.concat_ws("\n", F.concat(X.vtt_time("start_time"), F.lit(" --> "), X.vtt_time("end_time")), F.concat(F.lit("<v "), "speaker_name", F.lit(">"), "text"), F.lit(""))
    return _joined(_marked(segments, speakers), piece, "\n").select("meeting_id", F.concat(F.lit("WEBVTT\n\n"), "body").alias("content"))


def txt(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    head = F.when(F.col("turn"), F.concat(F.when(F.col("n") > 1, "\n").otherwise(""), "speaker_name", F.lit(":\n"))).otherwise("")
    return _joined(_marked(segments, speakers), F.concat(head, F.lit("  "), "text"), "\n").withColumnRenamed("body", "content")


def markdown(meetings: DataFrame, segments: DataFrame, speakers: DataFrame) -> DataFrame:
    head = F.when(F.col("turn"), F.concat(F.lit("\n### "), "speaker_name", F.lit(" ["), X.short_time("start_time"), F.lit("]\n\n"))).otherwise("")
    body = _joined(_marked(segments, speakers), F.concat(head, "text"), "\n")
    length = F.when(F.coalesce("duration", F.lit(0.0)) != 0, F.concat(F.lit("\n**Duration:** "), X.short_time("duration"), F.lit("\n"))).otherwise("")
    m = meetings.select("meeting_id", F.concat(F.lit("# "), "title", F.lit("\n"), length).alias("top"))
    return m.join(body, "meeting_id", "left").select("meeting_id", F.concat_ws("\n", "top", "body").alias("content"))


def json_document(meetings: DataFrame, segments: DataFrame, speakers: DataFrame) -> DataFrame:
    s = with_speaker(segments, speakers)
    row = F.struct(F.col("start_time").alias("start"), F.col("end_time").alias("end"), F.col("speaker_name").alias("speaker"), F.col("text"))
    g = s.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("ord", row.alias("r")))).alias("s"))
    m = meetings.join(g, "meeting_id", "left")
    none = F.array().cast("array<struct<start:double,end:double,speaker:string,text:string>>")
    return m.select("meeting_id", F.to_json(F.struct(F.struct("title", "duration").alias("meeting"), F.coalesce(F.transform("s", lambda x: x["r"]), none).alias("segments"))).alias("content"))


def document_blocks(meetings: DataFrame, segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """Ordered blocks of a word-processor or page document: (meeting_id, block, kind, level, text, markup_text)."""
    s = _marked(segments, speakers)
    top = meetings.select("meeting_id", F.lit(-2).cast("long").alias("ord"), F.lit(0).alias("k"), F.lit("heading").alias("kind"), F.lit(1).alias("level"), F.col("title").alias("text"))
    length = meetings.where("coalesce(duration, 0) <> 0").select("meeting_id", F.lit(-1).cast("long"), F.lit(0), F.lit("note"), F.lit(0), F.concat(F.lit("Duration: "), X.short_time("duration")))
    heads = s.where("turn").select("meeting_id", "ord", F.lit(0), F.lit("heading"), F.lit(3), F.concat("speaker_name", F.lit(" ["), X.short_time("start_time"), F.lit("]")))
    lines = s.select("meeting_id", "ord", F.lit(1), F.lit("paragraph"), F.lit(0), "text")
    every = top.union(length).union(heads).union(lines)
    w = Window.partitionBy("meeting_id").orderBy("ord", "k")
    return every.select("meeting_id", (F.row_number().over(w) - 1).alias("block"), "kind", "level", "text", X.escaped("text").alias("markup_text"))


def _with_result(results: DataFrame) -> DataFrame:
    """Results that hold a text, with names for an action or a recording that is gone; the others have no document."""
    return results.where(F.coalesce("result_text", F.lit("")) != "").withColumns({"action_name": F.coalesce("action_name", F.lit("Action")), "title": F.coalesce("title", F.lit("Meeting"))})


def action_document(results: DataFrame) -> DataFrame:
    """Action results (action_name, title, result_text) as Markdown: action, recording, a rule, the text."""
    return _with_result(results).withColumn("content", F.concat(F.lit("# "), "action_name", F.lit("\n\n**Meeting:** "), "title", F.lit("\n\n---\n\n"), "result_text"))


def action_file_blocks(results: DataFrame) -> DataFrame:
    """Block rows of an action result's files (result_id, block, kind, level, text): two lines on top, then its lines by heading marks; blank lines go."""
    r = _with_result(results)
    top = F.array(F.struct(F.lit("heading").alias("kind"), F.lit(1).alias("level"), F.col("action_name").alias("text")), F.struct(F.lit("note").alias("kind"), F.lit(0).alias("level"), F.concat(F.lit("Meeting: "), "title").alias("text")))
    head = r.select("result_id", F.posexplode(top).alias("block", "b")).select("result_id", (F.col("block") - 2).alias("block"), "b.*")
    lines = action_blocks(r).where(~F.col("text").rlike(r"^\s*\z") | (F.col("level") > 0))
    return head.unionByName(lines.select("result_id", "block", F.when(F.col("level") > 0, "heading").otherwise("paragraph").alias("kind"), "level", "text"))


def action_blocks(results: DataFrame) -> DataFrame:
    line = F.col("line")
    mark = F.regexp_extract(line, r"^(#{1,3}) ", 1)
    rows = results.select("result_id", F.posexplode(F.split(F.coalesce("result_text", F.lit("")), "\n")).alias("block", "line"))
    return rows.select("result_id", "block", F.length(mark).alias("level"), F.when(F.length(mark) > 0, F.substring(line, F.length(mark) + 2, F.length(line))).otherwise(line).alias("text"))


def signed(protocols: DataFrame) -> DataFrame:
    """Block rows of the signature lines that close a protocol."""
    rows = protocols.select("meeting_id", F.posexplode(F.array(F.lit("Chairperson"), F.lit("Reviewer"))).alias("n", "role"))
    return rows.select("meeting_id", "n", F.lit("signature").alias("kind"), F.concat(F.repeat(F.lit("_"), 30), F.lit("\n"), "role").alias("text"))


def protocol_filename(name) -> Column:
    """As a document's name, but leading and trailing dots and spaces stay."""
    return F.coalesce(F.nullif(F.regexp_replace(X.col(name), X.ILLEGAL, "_"), F.lit("")), F.lit("export"))


def events(progress: DataFrame) -> DataFrame:
    """Progress rows as messages for a channel: key ``meeting:<id>``, JSON value."""
    body = [c for c in progress.columns if c != "meeting_id"]
    return progress.select(F.concat(F.lit("meeting:"), F.col("meeting_id").cast("string")).alias("key"), F.to_json(F.struct(*body)).alias("value"))


def write_recordings(df: DataFrame, path: str, buckets: int = 64) -> None:
    """Replace the written recordings' buckets: Parquet partitioned by recording bucket, others untouched."""
    out = df.withColumn("bucket", F.pmod(F.xxhash64("meeting_id"), F.lit(buckets)))
    out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
