"""Exact dedup (built-in functions only): a tree merge of digest runs.

Each input partition is a run. Round 0 sorts a run by digest and merges its equal neighbours; round r
exchanges and merges ``fan_in`` sorted runs of the round before into one, keyed by (digest,
run / fan_in^r), so partitions meet in rounds of a ``fan_in``-nomial tree and no key ever has more than
``fan_in`` rows after its map-side merge, however many copies exist. Every merge is a sort-based
aggregation (the plans hold SortAggregate over sorted exchanges): a level retains one identifier and the
group's size. Winners then travel down the same tree, so each join key again has at most ``fan_in`` rows
above the leaves, and at a leaf only the rows of one partition.
Verification at every level: the key is SHA-256 with the text's byte length and an independent 64-bit
hash, so entries merge only where all three agree; texts themselves are not shipped to be compared.

Defined results: null text counts as empty; of equal texts the row with the largest doc_id stays (with
``keep='min'`` the smallest); a null doc_id is smaller than any other and, with ``keep='min'``, is taken
only if nothing else is there; of repeated rows exactly one stays; an empty table gives no rows; extra
columns are ignored by ``exact_dedup`` and kept by ``drop_copies``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import fresh, save, text_or_empty

KEY = ["digest", "bytes", "check"]


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    t = text_or_empty(text)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(t, 256).alias("digest"), F.octet_length(t).alias("bytes"), F.xxhash64(t).alias("check"))


def exact_dedup(docs: DataFrame, text: str = "text", keep: str = "max", fan_in: int = 16) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    own = digests(docs, text).withColumns({"row_key": F.monotonically_increasing_id(), "run": F.spark_partition_id()})
    leaves = save(docs.sparkSession, own, "digests")
    runs = (leaves.agg(F.max("run")).first()[0] or 0) + 1
    pick = F.max if keep == "max" else F.min
    first = F.struct((F.col("doc_id").isNotNull() if keep == "max" else F.col("doc_id").isNull()).alias("side"), "doc_id", "row_key")
    level = leaves.withColumns({"best": F.struct(first.alias("rank"), F.col("doc_id").alias("id"), F.col("row_key").alias("row")), "n": F.lit(1).cast("long")})
    level = level.groupBy(*KEY, "run").agg(pick("best").alias("best"), F.sum("n").alias("n"))
    ups = [level]
    while runs > 1:
        up = F.floor(F.col("run") / fan_in).cast("int")
        level = level.groupBy(*KEY, up.alias("run")).agg(pick("best").alias("best"), F.sum("n").alias("n"))
        ups.append(level)
        runs = -(-runs // fan_in)
    top = ups.pop()
    while ups:
        below = ups.pop().select(*KEY, "run").withColumn("up", F.floor(F.col("run") / fan_in).cast("int"))
        top = below.join(top.withColumnRenamed("run", "up"), [*KEY, "up"]).drop("up")
    won = top.select(*KEY, "run", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), F.col("n").alias("group_size"))
    return leaves.join(won, [*KEY, "run"]).select("doc_id", "keep_id", "group_size", (F.col("row_key") == F.col("keep_row")).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, text: str = "text", keep: str = "max") -> DataFrame:
    """The rows that stay, with all their columns, whatever those are called.

    Of rows equal in doc_id and text, one stays; which one's other columns stay with it is not defined.
    """
    spark = docs.sparkSession
    verdict = save(spark, exact_dedup(docs, text, keep), "verdict")
    id_, sha, own_sha = fresh(docs, "keep_id", "keep_sha", "own_sha")
    kept = verdict.where("kept").select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha))
    own = docs.withColumn(own_sha, F.sha2(text_or_empty(text), 256))
    out = own.join(kept, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own_sha) == F.col(sha)), "left_semi")
    again = verdict.where(~F.col("kept") & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    if not again.isEmpty():  # rows repeated with their doc_id: a join by id cannot tell them apart
        out = out.dropDuplicates(["doc_id", own_sha])
    return out.drop(own_sha)
