"""Sequence operators inside a recording: time chunks, runs, clocks, rolling words, numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import exprs as X
from parlance.sources import folders


def time_chunks(segments: DataFrame, seconds: float = 30.0) -> DataFrame:
    """Texts joined into chunks: an utterance that starts ``seconds`` or more after its chunk opens the next.

    The first chunk starts with the first utterance, blank or not; blank ones are skipped. A chunk's start
    depends on the one before, so a recording is folded in order (its utterances only, in the JVM).
    """
    part = "struct<text:string,start_time:double,end_time:double>"
    s = segments.select("meeting_id", F.struct("ord", "start_time", F.coalesce("end_time", "start_time").alias("end_time"), F.trim(F.coalesce("text", F.lit(""))).alias("text")).alias("s"))
    g = s.groupBy("meeting_id").agg(F.array_sort(F.collect_list("s")).alias("all"))
    start = F.struct(F.array().cast(f"array<{part}>").alias("done"), F.array().cast("array<string>").alias("open"), F.col("all")[0]["start_time"].alias("a"), F.col("all")[0]["start_time"].alias("b"))

    def closed(acc):
        return F.array_append(acc["done"], F.struct(F.array_join(acc["open"], " ").alias("text"), acc["a"].alias("start_time"), acc["b"].alias("end_time")))

    def step(acc, x):
        new = (x["start_time"] - acc["a"] >= seconds) & (F.size(acc["open"]) > 0)
        return F.struct(
            F.when(new, closed(acc)).otherwise(acc["done"]).alias("done"), F.when(new, F.array(x["text"])).otherwise(F.array_append(acc["open"], x["text"])).alias("open"),
            F.when(new, x["start_time"]).otherwise(acc["a"]).alias("a"), x["end_time"].alias("b"),
        )

    said = F.filter("all", lambda x: x["text"] != "")
    chunks = F.aggregate(said, start, step, lambda acc: F.when(F.size(acc["open"]) > 0, closed(acc)).otherwise(acc["done"]))
    return g.select("meeting_id", F.posexplode(chunks).alias("chunk", "c")).select("meeting_id", "chunk", "c.*")


def time_chunks_joined(segments: DataFrame, seconds: float = 30.0) -> DataFrame:
    """As ``time_chunks``, for recordings of any length: no row and no group holds more than a chunk.

    Only an utterance that starts later than all before it can open a chunk (the first one with words aside, which
    is always in the first chunk). Each of these points to the first of them at least ``seconds`` later, found by one
    ordered scan; pointers that double their reach every round mark those that the recording's start leads to. The
    rounds are the logarithm of the most chunks of a recording, each stored in the shared folder; the last, of one
    row a chunk, stays there for the result. Start times are not negative; a null one opens nothing, and a recording
    whose first start is null is one chunk.
    """
    spark = segments.sparkSession
    in_order = Window.partitionBy("meeting_id").orderBy("ord", "start_time", "end_time", "text")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    s = segments.select("meeting_id", "ord", "start_time", F.coalesce("end_time", "start_time").alias("end_time"), F.trim(F.coalesce("text", F.lit(""))).alias("text"))
    said = s.withColumn("opened", F.first("start_time").over(so_far)).where("text <> ''").withColumn("k", F.row_number().over(in_order))
    later = F.when(F.col("k") > 1, F.col("start_time"))
    before = F.max(later).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    said = said.withColumn("opener", later.isNotNull() & (before.isNull() | (later > before)))

    # The least start that counts can differ from the sum by rounding: the scan begins some steps of a double
    # below it and looks at as many records as there are doubles on the way.
    w = Window.partitionBy("meeting_id").orderBy("start_time")
    records = said.where("opener").select("meeting_id", "start_time", F.collect_list("start_time").over(w.rowsBetween(0, 7)).alias("heads"))
    none = F.lit(None).cast("array<double>")
    asked = said.where("opener").select("meeting_id", F.lit(False).alias("root"), F.col("start_time").alias("from"))
    asked = asked.unionByName(said.where("k = 1 and opened is not null").select("meeting_id", F.lit(True).alias("root"), F.col("opened").alias("from")))
    wanted = F.col("from") + F.lit(seconds)
    rows = records.select("meeting_id", F.col("start_time").alias("at"), "heads", F.lit(None).cast("boolean").alias("root"), F.lit(None).cast("double").alias("from"))
    rows = rows.unionByName(asked.select("meeting_id", (wanted - wanted * 2.0**-51).alias("at"), none.alias("heads"), "root", "from"))
    back = Window.partitionBy("meeting_id").orderBy(F.desc("at"), F.col("heads").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = F.last("heads", ignorenulls=True).over(back)
    links = rows.withColumn("ahead", ahead).where("from is not null")
    links = links.withColumn("to", F.get(F.filter("ahead", lambda x: x - F.col("from") >= seconds), F.lit(0))).where("to is not null").select("meeting_id", "root", "from", "to")

    place = folders.shared_folder(spark, "time-chunks")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{place}/{name}")
        return spark.read.parquet(f"{place}/{name}")

    links = stored(links, "links")
    reached, jumps, n = links.where("root").select("meeting_id", F.col("to").alias("start_time")), links.where("not root").drop("root"), 0
    while not jumps.isEmpty():
        n += 1
        further = reached.join(jumps.withColumnRenamed("from", "start_time"), ["meeting_id", "start_time"]).select("meeting_id", F.col("to").alias("start_time"))
        second = jumps.select("meeting_id", F.col("from").alias("to"), F.col("to").alias("end"))
        reached = stored(reached.unionByName(further), f"reached-{n}")
        jumps = stored(jumps.join(second, ["meeting_id", "to"]).select("meeting_id", "from", F.col("end").alias("to")), f"jumps-{n}")
        for name in (f"reached-{n - 1}", f"jumps-{n - 1}") if n > 1 else ("links",):
            folders.remove(spark, f"{place}/{name}")
    hit = reached.select("meeting_id", F.lit(True).alias("opener"), "start_time", F.lit(1).alias("new"))
    rows = said.join(hit, ["meeting_id", "opener", "start_time"], "left").withColumn("chunk", F.coalesce(F.sum("new").over(so_far), F.lit(0)).cast("int"))
    part = F.struct("k", "text", "end_time")
    g = rows.groupBy("meeting_id", "chunk").agg(F.array_sort(F.collect_list(part)).alias("s"), F.max("opened").alias("opened"), F.max(F.when(F.col("new") == 1, F.col("start_time"))).alias("a"))
    start = F.when(F.col("chunk") == 0, F.col("opened")).otherwise(F.col("a"))
    return g.select("meeting_id", "chunk", F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("text"), start.alias("start_time"), F.element_at("s", -1)["end_time"].alias("end_time"))


def until_intro_ends(chunks: DataFrame, answers: DataFrame, most: int = 20) -> DataFrame:
    """Chunks sent to the model: at most ``most``, up to and with the first that is answered "not ongoing".

    ``answers(meeting_id, chunk, ongoing)``; a chunk whose call failed (no answer) does not stop the run.
    """
    w = Window.partitionBy("meeting_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    c = chunks.where(F.col("chunk") < most).join(answers, ["meeting_id", "chunk"], "left")
    return c.withColumn("_go", F.coalesce(F.bool_and(F.coalesce("ongoing", F.lit(True))).over(w), F.lit(True))).where("_go").drop("_go")


def run_groups(segments: DataFrame, by: str = "speaker_id") -> DataFrame:
    """Consecutive utterances of one speaker: run number, first and last, count, text. Null equals null."""
    w = Window.partitionBy("meeting_id").orderBy("ord")
    first = F.row_number().over(w) == 1
    change = F.when(first | ~F.col(by).eqNullSafe(F.lag(by).over(w)), 1).otherwise(0)
    s = segments.withColumn("_c", change).withColumn("run", F.sum("_c").over(w))
    return s.groupBy("meeting_id", "run").agg(F.first(by).alias(by), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.count("*").alias("n"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"))


def clock(chunks: DataFrame) -> DataFrame:
    """Audio time before each live chunk; silent chunks count, failed ones (null seconds) do not."""
    w = Window.partitionBy("recording").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("chunk_start", F.coalesce(F.sum("seconds").over(w), F.lit(0.0)))


def rolling_prompt(segments: DataFrame, last: int = 30) -> DataFrame:
    """The last ``last`` words said before each utterance; blank utterances count for nothing."""
    by = Window.partitionBy("meeting_id").orderBy("ord")
    s = segments.select("meeting_id", "ord", X.words(F.coalesce("text", F.lit(""))).alias("w"))
    # Every utterance that is not blank holds a word, so the last ``last`` of these suffice.
    said = s.where(F.size("w") > 0).withColumn("all", F.flatten(F.collect_list("w").over(by.rowsBetween(1 - last, 0))))
    said = said.select("meeting_id", "ord", F.array_join(F.slice("all", F.greatest(F.lit(1), F.size("all") - last + 1), F.lit(last)), " ").alias("said"))
    own = s.select("meeting_id", "ord").join(said, ["meeting_id", "ord"], "left")
    return own.select("meeting_id", "ord", F.last("said", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("prompt"))


def insight_rows(answers: DataFrame) -> DataFrame:
    """Insights of a model's answer (meeting_id, answer JSON) as one ordered list: decisions, actions, questions."""
    item = "array<struct<content:string,assignee:string,timestamp:double>>"
    kinds = [("decision", "decisions"), ("action_item", "action_items"), ("open_question", "open_questions")]
    parsed = answers.select("meeting_id", F.from_json("answer", f"decisions {item}, action_items {item}, open_questions {item}").alias("a"))
    rows = None
    for rank, (kind, key) in enumerate(kinds):
        part = parsed.select("meeting_id", F.lit(rank).alias("rank"), F.lit(kind).alias("insight_type"), F.posexplode(f"a.{key}").alias("pos", "i"))
        rows = part if rows is None else rows.unionByName(part)
    w = Window.partitionBy("meeting_id").orderBy("rank", "pos")
    assignee = F.when(F.col("insight_type") == "action_item", F.col("i.assignee"))
    return rows.select("meeting_id", (F.row_number().over(w) - 1).alias("ord"), "insight_type", F.lit("open").alias("status"), F.coalesce("i.content", F.lit("")).alias("content"), assignee.alias("assignee"), F.col("i.timestamp").alias("source_start_time"))


def polish_due(t, count):
    """Whether a live recording of ``t`` seconds with ``count`` polish passes is due for one: at 1 to 5 minutes, then every 5."""
    t, count = X.col(t), X.col(count)
    target = F.when(count < 5, (count + 1) * 60).otherwise((count - 3) * 300)
    return (t >= 60) & (t >= target)
