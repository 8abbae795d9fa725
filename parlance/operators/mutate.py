"""State changes as pure functions: old tables and a change give new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.sources.committed import Conflict, KeyedTable

#: Error of a job that a restart interrupted; fixed value.
INTERRUPTED = "Task interrupted by server restart. Please retry."
CHILDREN = ("segments", "speakers", "jobs", "action_results", "meeting_insights")


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``new`` replace or join those of ``old`` with equal keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def remove(old: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def patch(old: DataFrame, changes: DataFrame, *keys: str, keep_null: bool = True) -> DataFrame:
    """Columns of ``changes`` laid over rows with equal keys; with ``keep_null`` a null there keeps the old value."""
    cols = [c for c in changes.columns if c not in keys]
    c = changes.select(*keys, *(F.col(x).alias(f"_{x}") for x in cols), F.lit(True).alias("_hit"))
    value = {x: F.coalesce(f"_{x}", x) if keep_null else F.when(F.col("_hit"), F.col(f"_{x}")).otherwise(F.col(x)) for x in cols}
    return old.join(c, list(keys), "left").withColumns(value).select(*old.columns)


def delete_meetings(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Recordings and all their children removed; learned words stay, without their source."""
    out = dict(tables)
    for name in ("meetings", *CHILDREN):
        if name in out:
            out[name] = remove(out[name], gone, "meeting_id")
    if "vocabulary_entries" in out:
        g = gone.select(F.col("meeting_id").alias("_g")).distinct()
        v = out["vocabulary_entries"]
        out["vocabulary_entries"] = v.join(g, v.source_meeting_id == g._g, "left").withColumn("source_meeting_id", F.when(F.col("_g").isNull(), F.col("source_meeting_id"))).drop("_g")
    return out


def rename_speakers(speakers: DataFrame, changes: DataFrame) -> DataFrame:
    """A new display name makes the identification manual; a colour may change alone."""
    c = changes.withColumn("identified_by", F.when(F.col("display_name").isNotNull(), "manual"))
    return patch(speakers, c, "speaker_id")


def edit_texts(segments: DataFrame, edits: DataFrame, meetings: DataFrame) -> DataFrame:
    """New texts set is_edited; utterances of encrypted recordings stay as they are."""
    locked = meetings.where(F.col("is_encrypted").eqNullSafe(True)).select("meeting_id")
    ok = edits.join(locked, "meeting_id", "left_anti").select("meeting_id", "ord", "text", F.lit(True).alias("is_edited"))
    return patch(segments, ok, "meeting_id", "ord")


def move_segments(segments: DataFrame, moves: DataFrame) -> DataFrame:
    """Utterances to other speakers; stored statistics are not touched."""
    return patch(segments, moves.select("meeting_id", "ord", "speaker_id"), "meeting_id", "ord", keep_null=False)


def start_processing(meetings: DataFrame, wanted: DataFrame, busy: tuple[str, ...] = ("processing", "finalizing")) -> DataFrame:
    """Compare and set: wanted recordings that are not busy become processing; ``started`` tells which."""
    w = wanted.select("meeting_id").distinct().withColumn("_w", F.lit(True))
    ok = F.coalesce("_w", F.lit(False)) & ~F.col("status").isin(*busy)
    return meetings.join(w, "meeting_id", "left").withColumns({"started": ok, "status": F.when(ok, "processing").otherwise(F.col("status"))}).drop("_w")


def recover_stale(jobs: DataFrame, meetings: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Jobs left running or pending fail, and so do their recordings that were processing or finalizing."""
    stale = F.col("status").isin("running", "pending")
    hit = jobs.where(stale).select("meeting_id").distinct().withColumn("_s", F.lit(True))
    j = jobs.withColumns({"error": F.when(stale, INTERRUPTED).otherwise(F.col("error")), "completed_at": F.when(stale, now).otherwise(F.col("completed_at")), "status": F.when(stale, "failed").otherwise(F.col("status"))})
    m = meetings.join(hit, "meeting_id", "left").withColumn("status", F.when(F.col("_s") & F.col("status").isin("processing", "finalizing"), "failed").otherwise(F.col("status"))).drop("_s")
    return j, m


def orphans(folders: DataFrame, meetings: DataFrame) -> DataFrame:
    return folders.join(meetings.select(F.col("meeting_id").cast("string").alias("name")), "name", "left_anti")


def seed(actions: DataFrame, defaults: DataFrame) -> DataFrame:
    """Default actions that are missing by name are added."""
    return actions.unionByName(defaults.join(actions.select("name"), "name", "left_anti"), allowMissingColumns=True)


def named_results(results: DataFrame, actions: DataFrame) -> DataFrame:
    """Action results with the action's name, newest first."""
    a = actions.select("action_id", F.col("name").alias("action_name"))
    return results.join(a, "action_id", "left").withColumn("action_name", F.coalesce("action_name", F.lit("Deleted action"))).orderBy(F.desc("created_at"), "result_id")


def placed(rows: DataFrame, within: str, *by) -> DataFrame:
    """Rows with their place, from 1, in the order ``by`` within a group."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(within).orderBy(*by)))


def with_running(running: Column, started: Column, ended: Column) -> Column:
    """Running actions after those that started and ended: a set, in order of arrival."""
    return F.array_except(F.array_union(running, started), ended)


def active_job(jobs: DataFrame) -> DataFrame:
    """Per recording the newest job that runs or waits."""
    j = jobs.where(F.col("status").isin("running", "pending"))
    return j.groupBy("meeting_id").agg(F.max(F.struct("created_at", "job_id")).alias("j")).select("meeting_id", "j.job_id", "j.created_at")


def toggle_insight(status: Column) -> Column:
    return F.when(status == "completed", "open").otherwise("completed")


def append_polish(meetings: DataFrame, passes: DataFrame) -> DataFrame:
    """Polish passes (meeting_id, p) appended to the recordings' history."""
    m = meetings.join(passes, "meeting_id", "left")
    return m.withColumn("polish_history", F.when(F.col("p").isNull(), F.col("polish_history")).otherwise(F.array_append(F.coalesce("polish_history", F.array().cast(m.schema["polish_history"].dataType)), F.col("p")))).drop("p")


def crypt_texts(df: DataFrame, columns: list[str], how) -> DataFrame:
    """Text columns through ``how`` (a column function); nulls stay."""
    return df.withColumns({c: how(F.col(c)) for c in columns})


def start_committed(table: KeyedTable, wanted: DataFrame, busy: tuple[str, ...] = ("processing", "finalizing")) -> DataFrame:
    """Compare and set on a committed table: (meeting_id, started) of the wanted recordings that are there.

    The change is committed on top of the version it was decided on. Where another writer was first, it is
    decided anew on that writer's version, so of two that want a recording one starts it and the other gets False.
    """
    while True:
        version = table.version()
        asked = start_processing(table.read(version), wanted, busy).join(wanted.select("meeting_id").distinct(), "meeting_id", "left_semi")
        if asked.where("started").isEmpty():
            return asked.select("meeting_id", "started")
        try:
            table.merge(asked.where("started").drop("started"), expected=version)
            return asked.select("meeting_id", "started")
        except Conflict:
            continue


def replace_recordings(table: KeyedTable, rows: DataFrame, by: str = "meeting_id") -> int:
    """All rows of the recordings in ``rows`` replaced by these, in one version."""
    while True:
        version = table.version()
        old = table.read(version).select(by, *(k for k in table.keys if k != by)).join(rows.select(by).distinct(), by, "left_semi")
        try:
            return table.merge(rows, gone=old.join(rows.select(*table.keys), table.keys, "left_anti"), expected=version)
        except Conflict:
            continue
