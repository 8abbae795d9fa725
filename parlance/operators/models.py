"""Model boundaries: every model is an injected function or a table of its answers.

``run_model`` is the one place where a model is called: rows in, an answer column out, batch by batch
over Arrow. In tests the function is a lookup; in deployment it calls a service. Equal inputs of a batch are
asked once, some calls run side by side, each has a time limit and is tried again after a wait. A call that
fails to the end gives a null answer, which every consumer treats as "no answer". Answers can be kept by a hash
of the inputs (``FolderAnswers``), so a task that Spark runs again asks only what has no answer yet.
"""

from __future__ import annotations

import hashlib
import json
import os
import queue
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import exprs as X
from parlance.functions import learned
from parlance.sources.folders import shared_folder

#: Seconds that a call may take, and chunks that an introduction is looked for in; fixed values.
CALL_SECONDS, MOST_CHUNKS = 120.0, 20

#: Preset of each task where no setting is stored; fixed values.
TASK_DEFAULTS = {"actions": "gemini-flash-lite", "analysis": "gemini-flash-lite", "live": "gemini-flash-lite", "transcription": "whisper-large-v3-turbo", "live_transcription": "whisper-small"}


class FolderAnswers:
    """Answers by a hash of their inputs: one small file each in a mounted shared folder, put in place whole."""

    def __init__(self, folder: str, name: str = ""):
        self.folder, self.name = folder.removeprefix("file://"), name

    def place(self, inputs: tuple) -> str:
        key = hashlib.sha256(json.dumps([self.name, *inputs], default=str, ensure_ascii=False).encode()).hexdigest()
        return f"{self.folder}/{key[:2]}/{key}"

    def get(self, inputs: tuple) -> str | None:
        try:
            with open(self.place(inputs), encoding="utf-8") as f:
                return f.read()
        except FileNotFoundError:
            return None

    def put(self, inputs: tuple, answer: str) -> None:
        path = self.place(inputs)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        own = f"{path}.{uuid.uuid4().hex}"
        with open(own, "w", encoding="utf-8") as f:
            f.write(answer)
        os.replace(own, path)


def within(seconds: float, call: Callable[[], str | None]) -> str | None:
    """The call's result, or ``TimeoutError`` after so many seconds; its thread is left behind then."""
    box: queue.SimpleQueue = queue.SimpleQueue()

    def run() -> None:
        try:
            box.put((True, call()))
        except BaseException as e:  # handed to the caller
            box.put((False, e))

    threading.Thread(target=run, daemon=True).start()
    try:
        good, value = box.get(timeout=seconds)
    except queue.Empty:
        raise TimeoutError(f"no answer within {seconds} s") from None
    if not good:
        raise value
    return value


def ask(model: Callable[..., str | None], inputs: tuple, seconds: float, tries: int, wait: float, answers: FolderAnswers | None) -> str | None:
    """One answer: the kept one, else by calls with a limit, each further one after twice the wait; None if all fail."""
    if answers is not None and (kept := answers.get(inputs)) is not None:
        return kept
    for attempt in range(tries):
        if attempt:
            time.sleep(wait * 2 ** (attempt - 1))
        try:
            answer = within(seconds, lambda: model(*inputs))
        except Exception:  # a model's failure is data
            continue
        if answers is not None and answer is not None:
            answers.put(inputs, answer)
        return answer
    return None


def run_model(df: DataFrame, inputs: list[str], model: Callable[..., str | None], output: str = "answer", at_once: int = 8, seconds: float = CALL_SECONDS, tries: int = 2, wait: float = 0.1, answers: FolderAnswers | None = None) -> DataFrame:
    """``df`` with the model's answer to ``inputs``; ``at_once`` calls of a task run side by side."""

    @F.pandas_udf("string")
    def call(rows: pd.DataFrame) -> pd.Series:
        asked = [tuple(v) for v in rows[inputs].itertuples(index=False)]
        distinct = list(dict.fromkeys(asked))
        with ThreadPoolExecutor(max(1, min(at_once, len(distinct)))) as pool:
            found = dict(zip(distinct, pool.map(lambda v: ask(model, v, seconds, tries, wait, answers), distinct), strict=True))
        return pd.Series([found[v] for v in asked], dtype=object)

    return df.withColumn(output, call(F.struct(*inputs)))


def answers_by_key(df: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    """Precomputed answers joined by key; rows without one keep a null."""
    return df.join(table, list(keys), "left")


def assignments(settings: DataFrame) -> DataFrame:
    """Preset of every task: the stored one (task, preset_id), else the default."""
    spark = settings.sparkSession
    d = spark.createDataFrame(list(TASK_DEFAULTS.items()), "task string, default string")
    return d.join(settings, "task", "left").select("task", F.coalesce("preset_id", "default").alias("preset_id"))


def preset_for_task(settings: DataFrame, presets: DataFrame) -> DataFrame:
    return assignments(settings).join(presets.withColumnRenamed("id", "preset_id"), "preset_id", "left")


def presets_of_type(presets: DataFrame, kind: str | None = None) -> DataFrame:
    """Presets (id, type, ...) of one type, or all of them."""
    return presets if kind is None else presets.where(F.col("type") == kind)


def changed_assignments(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Stored (owner, task, preset_id) after ``changes`` of the same columns; a change of an unknown task counts for nothing."""
    c = changes.where(F.col("task").isin(*TASK_DEFAULTS)).select("owner", "task", F.col("preset_id").alias("_new"))
    both = stored.join(c, ["owner", "task"], "full")
    return both.select("owner", "task", F.coalesce("_new", "preset_id").alias("preset_id"))


def without_presets(stored: DataFrame, gone: DataFrame) -> DataFrame:
    """Stored assignments once presets ``gone(id)`` are deleted: their tasks go back to the defaults."""
    return stored.join(gone.select(F.col("id").alias("preset_id")).distinct(), "preset_id", "left_anti").select(stored.columns)


def preset_for_owner(owners: DataFrame, stored: DataFrame, presets: DataFrame) -> DataFrame:
    """(owner, task, preset_id, type) for every task of every owner: the stored preset, else the default."""
    tasks = F.array(*(F.struct(F.lit(t).alias("task"), F.lit(p).alias("default")) for t, p in TASK_DEFAULTS.items()))
    every = owners.select("owner", F.explode(tasks).alias("t")).select("owner", "t.*")
    found = every.join(stored, ["owner", "task"], "left").withColumn("preset_id", F.coalesce("preset_id", "default"))
    return found.join(presets.select(F.col("id").alias("preset_id"), "type"), "preset_id", "left").select("owner", "task", "preset_id", "type")


def chunk_prompt(chunks: DataFrame) -> DataFrame:
    """Prompt of the introduction analysis, per chunk."""
    return chunks.withColumn("prompt", F.format_string("[%ss - %ss]\n%s", X.whole_seconds("start_time"), X.whole_seconds("end_time"), "text"))


def conversation(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """Each chunk's prompt with the prompts and answers before it; a chunk without an answer leaves only its prompt."""
    c = chunk_prompt(chunks).join(answers.select("meeting_id", "chunk", "answer"), ["meeting_id", "chunk"], "left")
    turn = F.concat_ws("\n", "prompt", "answer")
    before = Window.partitionBy("meeting_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return c.withColumn("history", F.array_join(F.collect_list(turn).over(before), "\n")).select("meeting_id", "chunk", "prompt", "history")


def intro_result(answers: DataFrame) -> DataFrame:
    """Introduction analysis of a recording, from its answered chunks in order: last count, all names, end."""
    a = answers.select("meeting_id", "chunk", "end_time", F.from_json("answer", "speaker_count int, names array<string>, intro_ongoing boolean").alias("a")).where("a is not null")
    g = a.groupBy("meeting_id").agg(F.max(F.when(F.col("a.speaker_count").isNotNull(), F.struct("chunk", "a.speaker_count")))["speaker_count"].alias("speaker_count"), F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "a.names"))), lambda x: F.coalesce(x["names"], F.array().cast("array<string>"))))).alias("names"), F.min(F.when(F.coalesce("a.intro_ongoing", F.lit(True)) == F.lit(False), F.struct("chunk", "end_time")))["end_time"].alias("intro_end_time"))
    return g


def intro_rounds(chunks: DataFrame, model: Callable[..., str | None], limit: int = MOST_CHUNKS, **calls) -> DataFrame:
    """The introduction analysis as a conversation in rounds: (meeting_id, speaker_count, names, intro_end_time, asked).

    Round k asks the model about chunk k of every recording whose introduction goes on, with the prompts and
    answers before it (``model(history, prompt)``). What has been said is stored before the next round; a
    recording leaves with the first answer that says the introduction is over, with its last chunk, or after
    ``limit`` chunks. Count and names are those of the latest answer that gives them, the end is the end of
    the latest answered chunk. A call that fails leaves the prompt in the history and the rest as it was.
    ``calls``: limits of ``run_model``. Recordings without chunks have no row.
    """
    spark = chunks.sparkSession
    folder = shared_folder(spark, "rounds")
    chunk_prompt(chunks.where(F.col("chunk") < limit)).select("meeting_id", "chunk", "end_time", "prompt").repartition("chunk").write.partitionBy("chunk").parquet(f"{folder}/chunks")
    prompts = spark.read.schema("meeting_id {}, end_time double, prompt string, chunk int".format(dict(chunks.dtypes)["meeting_id"])).parquet(f"{folder}/chunks")
    schema = "meeting_id {}, history string, speaker_count int, names array<string>, intro_end_time double, goes_on boolean".format(dict(chunks.dtypes)["meeting_id"])
    kind = "speaker_count int, names array<string>, intro_ongoing boolean"
    held = None
    for k in range(limit):
        now = prompts.where(F.col("chunk") == k).drop("chunk")
        if held is None:
            none = lambda t: F.lit(None).cast(t)
            asked = now.select("meeting_id", "end_time", "prompt", F.lit("").alias("history"), F.lit(0).alias("speaker_count"), F.array().cast("array<string>").alias("names"), none("double").alias("intro_end_time"))
        else:
            asked = now.join(held.where("goes_on").drop("goes_on"), "meeting_id")
        said = run_model(asked, ["history", "prompt"], model, "answer", **calls)
        said = said.withColumn("a", F.from_json(learned.answer_json("answer"), kind))
        done = said.select(
            "meeting_id", F.concat_ws("\n", F.nullif("history", F.lit("")), "prompt", "answer").alias("history"), F.coalesce("a.speaker_count", "speaker_count").alias("speaker_count"), F.coalesce("a.names", "names").alias("names"),
            F.when(F.col("a").isNotNull(), F.col("end_time")).otherwise(F.col("intro_end_time")).alias("intro_end_time"), F.coalesce("a.intro_ongoing", F.lit(True)).alias("goes_on"),
        )
        done.write.parquet(f"{folder}/said/asked={k + 1}")
        held = spark.read.schema(schema).parquet(f"{folder}/said/asked={k + 1}")
        if held.where("goes_on").isEmpty():
            break
    rows = spark.read.schema(schema + ", asked int").parquet(f"{folder}/said")
    best = rows.groupBy("meeting_id").agg(F.max_by(F.struct("speaker_count", "names", "intro_end_time", "asked"), "asked").alias("r"))
    return best.select("meeting_id", "r.speaker_count", "r.names", "r.intro_end_time", "r.asked")
