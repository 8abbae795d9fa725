"""The inverted index against plain loops over all utterances."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from parlance.operators import search_index as SI


def tokens(text):
    return [w for w in re.split(r"[^\w]+", (text or "").lower()) if w]


def plain_rank(words, terms):
    """The published formula, by loops."""
    at = {t: [min(i + 1, 16383) for i, w in enumerate(words) if w == t][:256] for t in terms}
    if len(terms) == 1:
        return sum(0.1 / (k + 1) ** 2 for k in range(len(at[terms[0]]))) / (math.pi**2 / 6)
    res = None
    for i, a in enumerate(terms):
        for b in terms[:i]:
            for p in at[a]:
                for q in at[b]:
                    d = abs(p - q)
                    near = 1e-30 if d > 100 else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2))
                    w = math.sqrt(0.01 * near)
                    res = w if res is None else 1 - (1 - res) * (1 - w)
    return res


def like(text, q):
    out, i = "", 0
    while i < len(q):
        out += ".*" if q[i] == "%" else "." if q[i] == "_" else re.escape(q[i])
        i += 1
    return re.search(out, text, re.I | re.S) is not None


def plain(rows, q):
    terms = sorted(set(tokens(q)))
    out = {}
    for m, o, text in rows:
        words = tokens(text)
        if terms and all(t in words for t in terms):
            out[m, o] = plain_rank(words, terms)
        elif text is not None and like(text, q):
            out[m, o] = 0.0
    return out


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "Delta", "été", "a", "of", "x_y", "alphabet", "100%"]
    rows = [(i // 7, i % 7, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(300)]
    rows += [(90, 0, None), (90, 1, ""), (91, 0, "alpha " * 400 + "beta"), (91, 1, "alpha " + "z " * 17_000 + "beta gamma"), (92, 0, "ALPHA-Beta, gamma."), (92, 1, "al")]
    df = spark.createDataFrame(rows, "meeting_id long, ord long, text string")
    folder = str(tmp_path_factory.mktemp("index"))
    SI.build(df.repartition(3), folder)
    return rows, df, folder


@pytest.mark.parametrize("q", ["alpha", "alpha beta", "beta alpha", "gamma beta alpha", "alpha alpha", "x_y", "l_h", "alp%eta", "été", "ÉTÉ of", "nothing", "a", "%", "pha b", "", "!!", "ab"])
def test_hits_and_ranks_equal_plain_loops(corpus, q):
    rows, df, folder = corpus
    got = {(r.meeting_id, r.ord): r["rank"] for r in SI.matches(df, folder, q).collect()}
    want = plain(rows, q)
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_known_ranks():
    """Values of the formula worked out by hand."""
    assert abs(plain_rank(["a"], ["a"]) - 0.0607927106) < 1e-9
    assert abs(plain_rank(["a", "b"], ["a", "b"]) - 0.0991032) < 1e-6


def test_only_the_terms_buckets_are_read(corpus, spark):
    _, df, folder = corpus
    keys = SI._keys(spark, F.array(F.lit("alpha"), F.lit("beta")))
    plan = SI._postings(spark, folder, "term", keys)._jdf.queryExecution().executedPlan().toString()
    filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters: \[(.*?)\]", plan)
    assert all(str(b) in filters[1] for _, b in keys) and "bucket" in filters[1] and "term" in filters[2]
    read = {r.bucket for r in spark.read.parquet(f"{folder}/terms").where(F.col("term").isin("alpha", "beta")).select("bucket").distinct().collect()}
    assert read == {b for _, b in keys}


def test_search_joins_order_and_limit(corpus, spark):
    rows, df, folder = corpus
    s = df.withColumns({"start_time": F.col("ord") * 1.0, "end_time": F.col("ord") + 1.0, "speaker_id": F.when(F.col("ord") % 2 == 0, F.col("meeting_id"))})
    m = df.select("meeting_id").distinct().withColumns({"title": F.concat(F.lit("M"), "meeting_id"), "created_at": F.timestamp_seconds(F.col("meeting_id") * 60), "is_encrypted": F.col("meeting_id") == 3})
    p = m.select("meeting_id", F.col("meeting_id").alias("speaker_id"), F.lit("Ann").alias("display_name"))
    got = SI.search(s, m, p, folder, "alpha beta", limit=20).collect()
    want = sorted(((-round(r, 6), -k[0], k[1]) for k, r in plain(rows, "alpha beta").items() if k[0] != 3))[:20]
    assert [(-r["rank"], -r.meeting_id, r.ord) for r in got] == want
    assert all((r.speaker_name == "Ann") == (r.ord % 2 == 0) for r in got)


def test_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "meeting_id long, ord long, text string")
    SI.build(spark.createDataFrame([(1, 1, "word")], none.schema), str(tmp_path / "one"))
    assert SI.matches(none, str(tmp_path / "one"), "other words").count() == 0


def test_a_trigram_is_posted_once_a_block(spark, tmp_path):
    """40 utterances of one recording lie in three blocks; words are counted by utterance all the same."""
    df = spark.createDataFrame([(1, o, "Some words 𝄞x") for o in range(40)], "meeting_id long, ord long, text string")
    SI.build(df, str(tmp_path / "i"))
    grams = spark.read.parquet(f"{tmp_path}/i/grams").where("gram = 'wor'").collect()
    assert sorted(r.block for r in grams) == [0, 1, 2]
    assert spark.read.parquet(f"{tmp_path}/i/terms").where("term = 'words'").count() == 40
    assert {(r.meeting_id, r.ord) for r in SI.matches(df, str(tmp_path / "i"), "ds 𝄞x").collect()} == {(1, o) for o in range(40)}


def test_trigrams_count_characters(spark):
    for text in ("ab", "", "abc", "ABCabc", "a𝄞b\nc", "ÅÄÖ x"):
        got = spark.range(1).select(SI.grams_of(F.lit(text)).alias("g")).first().g
        low = text.lower()
        assert sorted(got) == sorted({low[i : i + 3] for i in range(len(low) - 2)})
