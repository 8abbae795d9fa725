"""Queries by way of the inverted index, and the same by full scans in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import search_index
from parlance.plans.registry import query
from parlance.sources import views as V
from parlance.sources.folders import shared_folder

WORDS_SQL = r""", w AS (SELECT *, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS w FROM seg)"""


def _places(term: str) -> str:
    return f"list_transform(list_filter(range(1, len(w) + 1), lambda i: w[i] = '{term}'), lambda i: least(i, 16383))[:256]"


def _rank_sql(terms: list[str]) -> str:
    """The rank's formula written out over lists of positions."""
    if len(terms) == 1:
        return f"list_sum(list_transform({_places(terms[0])}, lambda p, k: CAST(0.1 AS DOUBLE) / (k * k))) / (pi() * pi() / 6)"
    near = "1 - sqrt(CAST(0.01 AS DOUBLE) * CASE WHEN abs(p - q) > 100 THEN CAST(1e-30 AS DOUBLE) ELSE 1 / (CAST(1.005 AS DOUBLE) + CAST(0.05 AS DOUBLE) * exp(CAST(abs(p - q) AS DOUBLE) / CAST(1.5 AS DOUBLE) - 2)) END)"
    pairs = [f"list_product(flatten(list_transform({_places(a)}, lambda p: list_transform({_places(b)}, lambda q: {near}))))" for i, a in enumerate(terms) for b in terms[:i]]
    return "1 - " + " * ".join(pairs)


def hits_sql(terms: list[str], pattern: str) -> str:
    every = " AND ".join(f"list_contains(w, '{t}')" for t in terms)
    return f"""{WORDS_SQL}, h AS (SELECT *, round(CASE WHEN {every} THEN {_rank_sql(terms)} ELSE 0 END, 6) AS rank FROM w WHERE ({every}) OR text ILIKE '%{pattern}%'),
hits AS (SELECT h.meeting_id, m.title, h.ord, h.text, p.display_name AS speaker_name, h.rank, m.created_at FROM h JOIN mtg m USING (meeting_id) LEFT JOIN spk p USING (meeting_id, speaker_id) ORDER BY h.rank DESC, m.created_at DESC, h.meeting_id, h.ord LIMIT 100)
SELECT meeting_id, title, ord, text, speaker_name, rank FROM hits"""


def _search(spark, sf, q):
    folder = shared_folder(spark, "index")
    s = V.segments(spark, sf)
    search_index.build(s.select("meeting_id", "ord", "text"), folder)
    found = search_index.search(s, V.meetings(spark, sf), V.speakers(spark, sf), folder, q)
    return found.select("meeting_id", "title", "ord", "text", "speaker_name", "rank")


@query(hits_sql(["the"], "the"))
def indexed_search(spark, sf):
    """One query word: its occurrences, and utterances that hold it within other words."""
    return _search(spark, sf, "the")


@query(hits_sql(["in", "of", "the"], "the of in"))
def indexed_search_words(spark, sf):
    """Three query words: all must be there; near ones rank higher."""
    return _search(spark, sf, "the of in")


@query(hits_sql(["nd", "th_t"], "th_t%nd"))
def indexed_search_pattern(spark, sf):
    """A query with wildcards: the trigrams of its literal runs, checked against the texts."""
    return _search(spark, sf, "th_t%nd")


@query(WORDS_SQL + """, t AS (SELECT meeting_id, ord, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS p FROM w)
SELECT term, count(DISTINCT (meeting_id, ord)) AS utterances, count(*) AS occurrences, CAST(sum(p) AS BIGINT) AS positions FROM t GROUP BY 1""")
def index_terms(spark, sf):
    """The whole index read back: utterances, occurrences and positions of every word."""
    folder = shared_folder(spark, "index")
    search_index.build(V.segments(spark, sf).select("meeting_id", "ord", "text"), folder)
    rows = spark.read.parquet(f"{folder}/terms")
    return rows.groupBy("term").agg(F.count("*").alias("utterances"), F.sum(F.size("positions")).alias("occurrences"), F.sum(F.aggregate("positions", F.lit(0).cast("long"), lambda a, p: a + p)).alias("positions"))
