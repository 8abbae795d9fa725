"""Typed data model: one StructType per table, enumerations and fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, LongType, StringType, StructField, StructType, TimestampType

_TYPES = {"s": StringType(), "d": DoubleType(), "i": LongType(), "b": BooleanType(), "t": TimestampType(), "v": ArrayType(FloatType())}


def _table(spec: str) -> StructType:
    """``name:type`` per column; a trailing ``?`` marks a nullable one."""
    fields = []
    for part in spec.split():
        name, kind = part.split(":")
        fields.append(StructField(name, _TYPES[kind[0]], kind.endswith("?")))
    return StructType(fields)


SPAN = StructType([StructField("start", DoubleType()), StructField("end", DoubleType())])
TURN = StructType([*SPAN.fields, StructField("speaker", StringType())])
HEARD = StructType([*SPAN.fields, StructField("text", StringType()), StructField("confidence", DoubleType())])
CHUNK = StructType([StructField("text", StringType()), StructField("start_time", DoubleType()), StructField("end_time", DoubleType())])
POLISH = StructType([StructField("pass", LongType()), StructField("duration_seconds", DoubleType()), StructField("speaker_count", LongType()), StructField("names_found", LongType()), StructField("merged_segments", LongType()), StructField("timestamp", TimestampType())])
TOKEN = StructType([StructField("id", LongType()), StructField("p", DoubleType())])
TRANSCRIPT_FILE = StructType([
    StructField("transcription", ArrayType(StructType([
        StructField("text", StringType()),
        StructField("timestamps", StructType([StructField("from", StringType()), StructField("to", StringType())])),
        StructField("tokens", ArrayType(TOKEN)),
    ]))),
])

TABLES: dict[str, StructType] = {
    "meetings": StructType([
        *_table("meeting_id:s title:s status:s original_filename:s? audio_filepath:s? duration:d? whisper_model:s? min_speakers:i? max_speakers:i? intro_end_time:d?").fields,
        StructField("raw_diarization", ArrayType(TURN)), StructField("raw_transcription", ArrayType(HEARD)),
        *_table("mode:s recording_status:s?").fields, StructField("polish_history", ArrayType(POLISH)),
        *_table("vocabulary:s? protocol_text:s? is_encrypted:b encryption_salt:s? encryption_verify:s? created_at:t updated_at:t").fields,
    ]),
    "speakers": _table("speaker_id:s meeting_id:s label:s display_name:s? color:s identified_by:s? confidence:d? total_speaking_time:d segment_count:i"),
    "segments": _table("segment_id:s meeting_id:s speaker_id:s? start_time:d end_time:d text:s original_text:s? ord:i is_edited:b confidence:d?"),
    "jobs": _table("job_id:s meeting_id:s job_type:s status:s celery_task_id:s? progress:d current_step:s? total_steps:i? result:s? error:s? started_at:t? completed_at:t? created_at:t"),
    "actions": _table("action_id:s name:s prompt:s is_default:b created_at:t"),
    "action_results": _table("result_id:s action_id:s meeting_id:s status:s result_text:s? error:s? celery_task_id:s? is_encrypted:b created_at:t completed_at:t?"),
    "meeting_insights": _table("insight_id:s meeting_id:s insight_type:s status:s content:s assignee:s? source_start_time:d? source_end_time:d? ord:i created_at:t"),
    "speaker_profiles": _table("profile_id:s name:s embedding:v sample_count:d notes:s? created_at:t updated_at:t"),
    "vocabulary_entries": _table("term:s frequency:i source_meeting_id:s? created_at:t updated_at:t"),
}

#: Values of the string-typed enumerations; fixed values.
ENUMS = {
    ("meetings", "status"): ["uploading", "uploaded", "processing", "recording", "finalizing", "completed", "failed"],
    ("meetings", "mode"): ["upload", "live"],
    ("meetings", "recording_status"): ["recording", "stopped", "finalizing", "complete"],
    ("jobs", "job_type"): ["process_meeting", "polish_pass", "finalize_live", "rediarize", "reidentify", "extract_insights"],
    ("jobs", "status"): ["pending", "running", "completed", "failed", "cancelled"],
    ("action_results", "status"): ["pending", "running", "completed", "failed"],
    ("meeting_insights", "insight_type"): ["decision", "action_item", "open_question"],
    ("meeting_insights", "status"): ["open", "completed", "dismissed"],
}

#: Speaker colours in palette order, and the colour of the unknown speaker; fixed values.
PALETTE = ["#6366f1", "#ec4899", "#10b981", "#f59e0b", "#3b82f6", "#ef4444", "#8b5cf6", "#14b8a6", "#f97316", "#06b6d4"]
UNKNOWN_COLOR, UNKNOWN_LABEL, UNKNOWN_NAME = "#9ca3af", "UNKNOWN", "Unknown"

#: Introduction phrases; fixed values.
INTRO_PATTERNS = [
    r"jag heter\s+(\w+)", r"mitt namn [aä]r\s+(\w+)", r"jag [aä]r\s+(\w+)", r"my name is\s+(\w+)", r"i am\s+(\w+)", r"this is\s+(\w+)",
    r"hej.{0,20}jag heter", r"hej.{0,20}mitt namn", r"hi.{0,20}my name is", r"hello.{0,20}i am",
]

#: Preference defaults, and the keys shown masked; fixed values.
PREFERENCE_DEFAULTS = {"default_vocabulary": "", "speaker_profiles_enabled": "false", "hf_auth_token": "", "llm_api_key": ""}
SECRET_KEYS = ["hf_auth_token", "llm_api_key"]


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with a table's columns in order and type: missing ones null, others dropped (schema evolution)."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[table].fields))


def violations(df: DataFrame, table: str) -> DataFrame:
    """Rows that break the table's nullability or enumerations, with the reasons."""
    checks = [F.when(F.col(f.name).isNull(), F.lit(f"{f.name} is null")) for f in TABLES[table].fields if not f.nullable]
    checks += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(values), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for (t, c), values in ENUMS.items() if t == table]
    return df.withColumn("reasons", F.array_compact(F.array(*checks))).where(F.size("reasons") > 0)
