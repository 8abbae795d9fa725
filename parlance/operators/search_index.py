"""Inverted index over utterances: postings by term with positions, postings by trigram, ranked search from them.

The index is a folder of two Parquet tables, each partitioned by a bucket of its key (``BUCKETS``) and sorted by
key within files: ``terms`` (term, meeting_id, ord, positions) and ``grams`` (gram, meeting_id, block), where a block holds ``BLOCK``
places of a recording, so that a trigram's posting is written once for all of them. Very common keys are spread over ``SPREAD`` files of their bucket. A search reads the buckets of its terms and trigrams only.

Matching follows full-text search with a plain configuration: lower-cased words, positions from 1, all query words
must be there; or the query is a substring (``%`` and ``_`` are wildcards). Rank follows the published formula of
``ts_rank`` with its default weights (a word weighs 0.1): one distinct query word sums 0.1 / k^2 over its k-th
occurrences, divided by pi^2 / 6; several multiply up the pairs of positions, each by its distance. As there, a
word has at most ``MOST`` positions and none beyond ``FARTHEST``; both are fixed by the formula's definition.

Substring hits come from the trigrams of the query's literal runs, checked against the texts; a query without a
run of three characters reads all texts.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import exprs as X

BUCKETS, SPREAD, BLOCK = 64, 4, 16
#: Fixed by the rank's definition: default weight, most positions of a word, farthest position, base distance weight.
WEIGHT, MOST, FARTHEST = 0.1, 256, 16383
ZETA = math.pi**2 / 6


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def term_postings(segments: DataFrame) -> DataFrame:
    """(term, meeting_id, ord, positions): where each word stands in an utterance."""
    # Dealt before the words are taken apart: texts are moved, not a row a word.
    words = segments.repartition("meeting_id", "ord").select("meeting_id", "ord", F.posexplode(X.tokens("text")).alias("p", "term"))
    placed = words.select("meeting_id", "ord", "term", F.least(F.col("p") + 1, F.lit(FARTHEST)).alias("p"))
    return placed.groupBy("meeting_id", "ord", "term").agg(F.slice(F.array_sort(F.collect_list("p")), 1, MOST).alias("positions")).select("term", "meeting_id", "ord", "positions")


def grams_of(text: str | Column) -> Column:
    """Distinct trigrams of the lower-cased text."""
    t = F.lower(F.col(text) if isinstance(text, str) else text)
    # One pass: three characters ahead of every place, then one step. A substring would be counted off from the start.
    return F.array_distinct(F.regexp_extract_all(t, F.lit(r"(?s)(?=(...))."), F.lit(1)))


def _block(ord: str = "ord") -> Column:
    return F.floor(F.col(ord) / BLOCK)


def gram_postings(segments: DataFrame) -> DataFrame:
    """(gram, meeting_id, block): trigrams of the utterances of a block, set apart by a character between them."""
    blocks = segments.where("text is not null").groupBy("meeting_id", _block().alias("block")).agg(F.array_join(F.collect_list("text"), "\0").alias("text"))
    return blocks.select(F.explode(grams_of("text")).alias("gram"), "meeting_id", "block")


def build(segments: DataFrame, folder: str) -> None:
    """Write the index of ``segments(meeting_id, ord, text)``."""
    for key, place, postings in (("term", "ord", term_postings(segments)), ("gram", "block", gram_postings(segments))):
        dealt = postings.withColumns({"bucket": _bucket(key), "_s": F.pmod(F.xxhash64("meeting_id", place), F.lit(SPREAD))})
        dealt.repartition("bucket", "_s").drop("_s").sortWithinPartitions("bucket", key, "meeting_id", place).write.partitionBy("bucket").parquet(f"{folder}/{key}s")


def _keys(spark, keys: Column) -> list[tuple[str, int]]:
    """A query's keys and their buckets, worked out as the index does."""
    found = spark.range(1).select(F.explode(F.array_distinct(keys)).alias("key")).select("key", _bucket("key").alias("bucket"))
    return [(r.key, r.bucket) for r in found.collect()]


def _postings(spark, folder: str, key: str, keys: list[tuple[str, int]]) -> DataFrame:
    """The postings of some keys: their buckets are the only partitions read."""
    rows = spark.read.parquet(f"{folder}/{key}s")
    return rows.where(F.col("bucket").isin(sorted({b for _, b in keys})) & F.col(key).isin([k for k, _ in keys])).drop("bucket")


def pair_weight(distance: Column) -> Column:
    """Weight of a pair of positions at a distance."""
    near = 1.0 / (1.005 + 0.05 * F.exp(distance / 1.5 - 2))
    return F.sqrt(WEIGHT * WEIGHT * F.when(distance > 100, F.lit(1e-30)).otherwise(near))


def rank_of(places: list[Column]) -> Column:
    """Rank from ``places``: one array of positions per distinct query word."""
    terms = len(places)
    if terms == 1:
        counted = F.transform(places[0], lambda p, k: WEIGHT / ((k + 1) * (k + 1)).cast("double"))
        return F.aggregate(counted, F.lit(0.0), lambda a, x: a + x) / ZETA

    def without(rest: Column, own: Column, other: Column) -> Column:
        """``rest`` times what each pair of positions leaves."""
        return F.aggregate(own, rest, lambda a, p: F.aggregate(other, a, lambda b, q: b * (1.0 - pair_weight(F.abs(p - q).cast("double")))))

    rest = F.lit(1.0)
    for i in range(1, terms):
        for k in range(i):
            rest = without(rest, places[i], places[k])
    return 1.0 - rest


def _literal_runs(q: str) -> list[str]:
    """Parts of a pattern that stand in every match as they are."""
    return [r for r in re.split(r"[%_\\]", q) if len(r) >= 3]


def matches(segments: DataFrame, folder: str, q: str) -> DataFrame:
    """(meeting_id, ord, rank) of all hits of ``q``."""
    spark = segments.sparkSession
    terms = sorted(_keys(spark, X.tokens(F.lit(q))))
    runs = _literal_runs(q)
    keys = ["meeting_id", "ord"]
    own = segments.select(*keys, "text")
    if runs:
        grams = _keys(spark, F.flatten(F.array(*(grams_of(F.lit(r)) for r in runs))))
        near = _postings(spark, folder, "gram", grams).groupBy("meeting_id", "block").agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
        own = own.withColumn("block", _block()).join(near, ["meeting_id", "block"], "left_semi")
    hits = own.where(F.col("text").ilike(f"%{q}%")).select(*keys, F.lit(0.0).alias("rank"))
    if terms:
        names = [f"p{i}" for i in range(len(terms))]  # each word's positions in a column of their own
        held = _postings(spark, folder, "term", terms).groupBy(*keys).agg(*(F.max(F.when(F.col("term") == t, F.col("positions"))).alias(n) for n, (t, _) in zip(names, terms, strict=True)))
        held = held.where(" and ".join(f"{n} is not null" for n in names))
        ranked = held.select(*keys, rank_of([F.col(n) for n in names]).alias("rank"))
        hits = hits.unionByName(ranked).groupBy(*keys).agg(F.max("rank").alias("rank"))
    return hits


def search(segments: DataFrame, meetings: DataFrame, speakers: DataFrame, folder: str, q: str, limit: int = 100) -> DataFrame:
    """The ``limit`` best hits, as ``operators.search.search`` gives them, by way of the index.

    Order: rank (to six digits), newer recordings, recording, place in it. Texts and speakers are fetched for
    the ``limit`` hits alone. Encrypted recordings are not searched where ``is_encrypted`` is there.
    """
    m = meetings.where(~F.coalesce("is_encrypted", F.lit(False))) if "is_encrypted" in meetings.columns else meetings
    order = [F.desc("rank"), F.desc("created_at"), F.asc("meeting_id"), F.asc("ord")]
    best = matches(segments, folder, q).withColumn("rank", F.round("rank", 6)).join(m.select("meeting_id", "title", "created_at"), "meeting_id").orderBy(*order).limit(limit)
    own = segments.select("meeting_id", "ord", "start_time", "end_time", "text", "speaker_id").join(F.broadcast(best), ["meeting_id", "ord"])  # ``limit`` rows
    out = own.join(speakers.select("meeting_id", "speaker_id", F.col("display_name").alias("speaker_name")), ["meeting_id", "speaker_id"], "left")
    return out.select("meeting_id", "title", "ord", "start_time", "end_time", "text", "speaker_name", "rank", "created_at").orderBy(*order)
