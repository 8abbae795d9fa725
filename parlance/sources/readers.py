"""File sources: transcripts, turns, presets, preferences, uploads, probes, storage folders, stored JSON columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

from parlance import schemas
from parlance.functions import exprs as X

#: Media types taken for upload, and limits; fixed values.
MEDIA = [".mp4", ".mkv", ".avi", ".mov", ".webm", ".mp3", ".wav", ".m4a", ".ogg", ".flac", ".aac", ".wma"]
MAX_UPLOAD, MAX_TITLE, MAX_VOCABULARY, PROMPT, CHUNK_PROMPT, CONTEXT_PROMPT = 5 * 1024**3, 500, 2000, 500, 300, 200


def transcript_files(spark: SparkSession, path: str) -> DataFrame:
    """Utterances of speech-to-text JSON files: file, ord, start, end, text, confidence."""
    raw = spark.read.schema(schemas.TRANSCRIPT_FILE).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_name"))
    return heard(raw)


def heard(raw: DataFrame, key: str = "file") -> DataFrame:
    item = raw.select(key, F.posexplode("transcription").alias("ord", "t"))
    return item.select(
        key, "ord", X.parse_time(F.col("t.timestamps.from")).alias("start"), X.parse_time(F.col("t.timestamps.to")).alias("end"), F.trim("t.text").alias("text"), X.mean_token_probability(F.col("t.tokens")).alias("confidence")
    ).where("text <> ''")


def vocabulary_prompt(vocabulary, context=None):
    """Prompt of a transcription call: the whole file's, or with ``context`` a live chunk's."""
    v = X.col(vocabulary)
    if context is None:
        return F.substring(v, 1, PROMPT)
    parts = F.array_compact(F.array(F.nullif(F.substring(v, 1, CHUNK_PROMPT), F.lit("")), F.nullif(F.right(X.col(context), F.lit(CONTEXT_PROMPT)), F.lit(""))))
    return F.nullif(F.array_join(parts, " "), F.lit(""))


def turn_table(df: DataFrame) -> DataFrame:
    """Diarization turns rounded to milliseconds, numbered in input order by start."""
    return df.select("meeting_id", "di", F.bround("ds", 3).alias("ds"), F.bround("de", 3).alias("de"), "lab")


def stored_transcript(meetings: DataFrame) -> DataFrame:
    """Utterances kept in a recording's raw_transcription; a recording without any yields no rows."""
    return meetings.select("meeting_id", F.posexplode("raw_transcription").alias("ord", "t")).select("meeting_id", F.col("ord").cast("long").alias("ord"), F.col("t.start").alias("start_time"), F.col("t.end").alias("end_time"), "t.text", "t.confidence")


def stored_turns(meetings: DataFrame) -> DataFrame:
    return meetings.select("meeting_id", F.posexplode("raw_diarization").alias("di", "t")).select("meeting_id", F.col("di").cast("long").alias("di"), F.col("t.start").alias("ds"), F.col("t.end").alias("de"), F.col("t.speaker").alias("lab"))


def media_duration(df: DataFrame, probe: str = "probe") -> DataFrame:
    """Duration out of a media probe's JSON answer."""
    return df.withColumn("duration", F.get_json_object(probe, "$.format.duration").try_cast("double"))


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded files as rows (path, size, name, extension); the content is not read."""
    f = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))
    return f.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))


def checked_uploads(df: DataFrame, default_vocabulary: str = "", *keys: str) -> DataFrame:
    """Requests (title, name, size, min_speakers, max_speakers, vocabulary) with cleaned values and ``error``."""
    title, ext = F.substring(F.trim("title"), 1, MAX_TITLE), F.lower(F.regexp_extract("name", r"(\.[^./\\]+)$", 1))
    vocabulary = F.coalesce(F.nullif(F.substring(F.trim("vocabulary"), 1, MAX_VOCABULARY), F.lit("")), F.nullif(F.lit(default_vocabulary), F.lit("")))
    error = (
        F.when(F.coalesce(title, F.lit("")) == "", "title is required")
        .when(~ext.isin(MEDIA), F.concat(F.lit("unsupported type "), ext))
        .when((F.col("min_speakers") < 1) | (F.col("max_speakers") < 1), "speaker counts must be at least 1")
        .when(F.col("min_speakers") > F.col("max_speakers"), "min_speakers exceeds max_speakers")
        .when(F.col("size") > MAX_UPLOAD, "file too large")
    )
    return df.select(*keys, title.alias("title"), X.upload_filename("name").alias("name"), ext.alias("extension"), "size", "min_speakers", "max_speakers", vocabulary.alias("vocabulary"), error.alias("error"))


def presets(spark: SparkSession, path: str) -> DataFrame:
    """Preset files of a folder: (id, type, body)."""
    return preset_rows(spark.read.text(path, wholetext=True).select(F.col("value").alias("body"), F.col("_metadata.file_name").alias("file")))


def preset_rows(files: DataFrame) -> DataFrame:
    """Presets of ``files(file, body)``: unreadable ones are skipped, the id defaults to the file's name, a later file of an id wins."""
    j = files.where(F.col("file").endswith(".json") & F.try_parse_json("body").isNotNull())
    j = j.withColumn("id", F.coalesce(F.get_json_object("body", "$.id"), F.regexp_replace("file", r"\.json$", "")))
    return j.groupBy("id").agg(F.max(F.struct("file", "body"))["body"].alias("body")).select("id", F.get_json_object("body", "$.type").alias("type"), "body")


def preset_texts(presets: DataFrame) -> DataFrame:
    """(file, body) to be written of presets (name, type, ...): the id is a slug of the name, which names the file too."""
    id_ = X.slug("name")
    return presets.select(F.concat(id_, F.lit(".json")).alias("file"), F.to_json(F.struct(id_.alias("id"), *presets.columns)).alias("body"))


def preferences(spark: SparkSession, stored: str | None) -> DataFrame:
    """Stored preferences (JSON text) over the defaults, secrets masked in ``shown``; bad JSON gives the defaults."""
    return merged_preferences(spark.createDataFrame([(0, stored)], "owner int, body string")).drop("owner")


def merged_preferences(stored: DataFrame) -> DataFrame:
    """(owner, key, value, shown) of ``stored(owner, body)``; unknown keys are kept."""
    given = F.coalesce(F.from_json("body", "map<string,string>"), F.create_map().cast("map<string,string>"))
    defaults = F.create_map(*(F.lit(x) for kv in schemas.PREFERENCE_DEFAULTS.items() for x in kv))
    keys = F.array_union(F.map_keys(defaults), F.map_keys("given"))
    rows = stored.select("owner", given.alias("given")).select("owner", F.explode(F.transform(keys, lambda k: F.struct(k.alias("key"), F.coalesce(F.element_at(F.col("given"), k), F.element_at(defaults, k)).alias("value")))).alias("p"))
    return rows.select("owner", "p.*").withColumn("shown", F.when(F.col("key").isin(schemas.SECRET_KEYS), X.masked("value")).otherwise(F.col("value")))


#: Typed settings and their defaults; the names are ours.
SETTINGS = {"llm_base_url": "http://localhost:11434/v1", "live_chunk_seconds": 4.0, "max_upload_bytes": MAX_UPLOAD, "profile_threshold": 0.55, "polish_minimum_seconds": 60.0}


def settings(spark: SparkSession, prefix: str = "parlance.") -> dict[str, object]:
    """Settings from the session's ``parlance.*`` entries over the defaults, each in its default's type."""
    held = ((name, default, spark.conf.get(prefix + name, None)) for name, default in SETTINGS.items())
    return {name: default if given is None else type(default)(given) for name, default, given in held}


def typed_settings(stored: DataFrame) -> DataFrame:
    """(owner, name, value, valid) of every owner of ``stored(owner, name, value)`` and every setting: the stored text in its default's type, else the default.

    Names are told apart without case; names that no setting has are left out. A text that is not of the type
    makes the setting invalid, with a null value. Of repeated entries the greatest text counts.
    """
    known = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(str(d)).alias("default"), F.lit(type(d).__name__).alias("type")) for n, d in SETTINGS.items()))
    given = stored.groupBy("owner", F.lower("name").alias("name")).agg(F.max("value").alias("given"))
    every = stored.select("owner").distinct().select("owner", F.explode(known).alias("s")).select("owner", "s.*")
    text = F.coalesce("given", "default")
    value = F.when(F.col("type") == "int", text.try_cast("bigint").cast("string")).when(F.col("type") == "float", text.try_cast("double").cast("string")).otherwise(text)
    return every.join(given, ["owner", "name"], "left").select("owner", "name", value.alias("value"), value.isNotNull().alias("valid"))


def listed(entries: DataFrame) -> DataFrame:
    """Folder names of a storage listing ``entries(path, is_directory)``; files do not count."""
    return entries.where("is_directory").select(F.regexp_extract("path", r"([^/]+)/*$", 1).alias("name"))


def storage_folders(spark: SparkSession, path: str) -> DataFrame:
    """The folders below a path of any file system that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return listed(spark.createDataFrame([(f.getPath().toString(), f.isDirectory()) for f in found], "path string, is_directory boolean"))


@F.pandas_udf(BinaryType())
def vector_blob(vectors: pd.Series) -> pd.Series:
    """Vectors as little-endian 32-bit floats."""
    return vectors.map(lambda v: np.asarray(v, dtype="<f4").tobytes(), na_action="ignore")


@F.pandas_udf(ArrayType(FloatType()))
def blob_vector(blobs: pd.Series) -> pd.Series:
    """Vectors of blobs; bytes beyond whole floats are left out."""
    return blobs.map(lambda b: np.frombuffer(bytes(b)[: len(b) // 4 * 4], dtype="<f4"), na_action="ignore")


def folders(spark: SparkSession, names: list[str]) -> DataFrame:
    """A storage listing (folder names) as rows."""
    return spark.createDataFrame([(n,) for n in names], "name string")
