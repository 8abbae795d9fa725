"""Edge tables with expected values, and differential tests against the rules as stated here."""

import json
import random
import re
from collections import Counter
from itertools import accumulate, groupby, product

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from parlance import schemas
from parlance.functions import exprs as X
from parlance.functions import learned
from parlance.operators import align, analytics, chunks, models, mutate, render, search, speakers, vocabulary
from parlance.sources import readers
from parlance.streaming import live

SEG = "meeting_id long, ord long, start_time double, end_time double, text string, speaker_id long"


def segs(spark, rows, meeting=1):
    return spark.createDataFrame([(meeting, i, float(a), float(b), t, s) for i, (a, b, t, s) in enumerate(rows)], SEG)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# --- alignment ---------------------------------------------------------------------------------------


def stated_align(segments, turns):
    """The rule as a sort: most overlap then first turn; failing that the first turn around the middle."""

    def label(a, b):
        common = sorted((max(a, s) - min(b, e), i) for i, (s, e, _) in enumerate(turns) if max(a, s) < min(b, e))
        around = [(0, i) for i, (s, e, _) in enumerate(turns) if 2 * s <= a + b <= 2 * e]
        return next((turns[i][2] for _, i in common + around), "") or "UNKNOWN"

    return [label(a, b) for a, b in segments]


def run_align(spark, segments, turns):
    s = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(segments)], "meeting_id long, ord long, start_time double, end_time double")
    t = spark.createDataFrame([(1, i, float(a), float(b), lab) for i, (a, b, lab) in enumerate(turns)], "meeting_id long, di long, ds double, de double, lab string")
    return [r.speaker for r in align.align(s, t).orderBy("ord").collect()]


def test_align_ties_and_fallbacks(spark):
    segments = [(0, 4), (4, 6), (7, 7), (100, 101), (58, 62), (0, 300)]
    turns = [(0, 2, "A"), (2, 4, "B"), (6, 8, "C"), (6, 9, "D"), (50, 59, "E"), (61, 200, "F"), (3, 4, "")]
    assert run_align(spark, segments, turns) == stated_align(segments, turns)
    assert run_align(spark, [(0, 1)], []) == ["UNKNOWN"]


def test_align_random(spark):
    rng = random.Random(3)
    segments = [(a := rng.randint(0, 400) / 2, a + rng.choice([0, 0.5, 1, 4, 70])) for _ in range(150)]
    turns = [(a := rng.randint(0, 400) / 2, a + rng.choice([0, 0.5, 2, 30, 130]), f"S{rng.randint(0, 4)}") for _ in range(60)]
    assert run_align(spark, segments, turns) == stated_align(segments, turns)


def stated_nearest(rows):
    """The rule as a minimum over (distance, first appearance of the speaker, place)."""
    count, mids = Counter(s for *_, s in rows), [(a + b) / 2 for a, b, _ in rows]
    first = {s: i for i, (*_, s) in reversed(list(enumerate(rows)))}
    receivers = [(m, first[s], i, s) for i, ((*_, s), m) in enumerate(zip(rows, mids, strict=True)) if s is not None and count[s] > 1]
    return [min(((abs(m - x), f, i, t) for x, f, i, t in receivers), default=(s,))[-1] if count[s] < 2 else s for (*_, s), m in zip(rows, mids, strict=True)]


def test_nearest_random(spark):
    for seed in range(4):
        rng = random.Random(seed)
        rows = [(a := rng.randint(0, 30), a + rng.randint(0, 4), rng.choice([None, 1, 2, 3, 4, 5, 6, 7, 8])) for _ in range(rng.choice([6, 14]))]
        df = segs(spark, [(a, b, "t", s) for a, b, s in rows])
        assert [r.new_speaker_id for r in align.nearest_reassign(df).orderBy("ord").collect()] == stated_nearest(rows)


def test_preserve_edits(spark):
    old = segs(spark, [(0, 2, "old0", 1), (1.4, 3.4, "old1", 1), (10, 12, "old2", 1), (20, 22, "no", 1)]).withColumn("is_edited", F.col("ord") < 3)
    new = segs(spark, [(1.4, 3.4, "a", 1), (1.5, 3.5, "b", 1), (11.5, 12, "c", 1), (10.1, 13.4, "d", 1), (20, 22, "e", 1)])
    got = align.preserve_edits(new, old).orderBy("ord").collect()
    assert [(r.text, r.is_edited, r.original_text) for r in got] == [("old0", True, "a"), ("old1", True, "b"), ("c", False, "c"), ("old2", True, "d"), ("e", False, "e")]


# --- sequences ----------------------------------------------------------------------------------------


def stated_chunks(rows, seconds=30.0):
    """The rule as a scan: where each utterance's chunk starts; then utterances grouped by that start."""
    said = [(a, b, t.strip()) for a, b, t in rows if t.strip()]
    # The first utterance with words belongs to the chunk that the recording opens with, however late it comes.
    starts = list(accumulate((a for a, *_ in said[1:]), lambda at, a: a if a - at >= seconds else at, initial=rows[0][0]))[: len(said)]
    by = [list(g) for _, g in groupby(zip(starts, said, strict=True), key=lambda x: x[0])]
    return [(" ".join(t for _, (*_, t) in g), g[0][0], g[-1][1][1]) for g in by]


def test_time_chunks(spark):
    rng = random.Random(5)
    for rows in ([(1, 2, " "), (5, 6, "a"), (31, 32, "b"), (61, 90, "c"), (200, 201, "d")], [(0, 1, "")], [(t := i * rng.randint(3, 9), t + 3, rng.choice(["x", "yy ", "  "])) for i in range(60)]):
        got = chunks.time_chunks(segs(spark, [(a, b, t, 1) for a, b, t in rows])).orderBy("chunk").collect()
        assert [(r.text, r.start_time, r.end_time) for r in got] == stated_chunks(rows)


def test_time_chunks_joined(spark):
    """Starts out of order, missing, equal, a rounding step from the limit; recordings without words; several at once."""
    rng = random.Random(11)
    fixed = [
        [(1, 2, " "), (5, 6, "a"), (31, 32, "b"), (61, 90, "c"), (200, 201, "d")],
        [(0, 1, "")],
        [(500, 501, "late first"), (3, 4, "a"), (40, 41, "b")],
        [(0, 1, " "), (90, 91, "a"), (95, 96, "b"), (5, 6, "c"), (130, 131, "d")],
    ]
    drawn = [[(rng.choice([x * 0.1, x * 7.3, 30.0 * (x // 3), 0.1 + 30 * x]), 1.0, rng.choice(["x", "yy ", "  "])) for x in (rng.randint(0, 40) for _ in range(50))] for _ in range(25)]
    rising = [sorted(r) for r in drawn] + [[(round(0.1 + i * 0.1, 1), 1.0, "w") for i in range(1500)]]
    recordings = fixed + drawn + rising
    rows = [(m, i, float(a), float(b), t) for m, r in enumerate(recordings) for i, (a, b, t) in enumerate(r)]
    s = spark.createDataFrame(rows, "meeting_id long, ord long, start_time double, end_time double, text string")
    got = {}
    for r in chunks.time_chunks_joined(s).orderBy("meeting_id", "chunk").collect():
        got.setdefault(r.meeting_id, []).append((r.text, r.start_time, r.end_time))
    assert got == {m: c for m, r in enumerate(recordings) if (c := stated_chunks(r))}


def test_time_chunks_joined_with_nulls(spark):
    rows = [(1, 0, None, None, "a"), (1, 1, 90.0, None, "b"), (2, 0, 0.0, None, "a"), (2, 1, None, 7.0, "b"), (2, 2, 31.0, None, "c"), (2, 3, 32.0, 33.0, None)]
    s = spark.createDataFrame(rows, "meeting_id long, ord long, start_time double, end_time double, text string").withColumn("chunk", F.lit("x"))
    want = [tuple(r) for r in chunks.time_chunks(s).orderBy("meeting_id", "chunk").collect()]
    assert [tuple(r) for r in chunks.time_chunks_joined(s).orderBy("meeting_id", "chunk").collect()] == want == [(1, 0, "a b", None, 90.0), (2, 0, "a b", 0.0, 7.0), (2, 1, "c", 31.0, 31.0)]
    assert chunks.time_chunks_joined(s.where("false")).count() == 0


def test_runs_with_nulls(spark):
    got = chunks.run_groups(segs(spark, [(i, i + 1, "t", s) for i, s in enumerate([None, None, 1, 1, None, 2])])).orderBy("run").collect()
    assert [(r.speaker_id, r.n) for r in got] == [(None, 2), (1, 2), (None, 1), (2, 1)]


def test_until_intro_ends(spark):
    c = spark.createDataFrame([(1, i) for i in range(25)], "meeting_id int, chunk int")
    a = spark.createDataFrame([(1, 0, True), (1, 2, False), (1, 3, True)], "meeting_id int, chunk int, ongoing boolean")
    assert [r.chunk for r in chunks.until_intro_ends(c, a).orderBy("chunk").collect()] == [0, 1, 2]
    assert chunks.until_intro_ends(c, a.limit(0)).count() == 20


@pytest.mark.parametrize(("t", "count", "due"), [(59.9, 0, False), (60, 0, True), (60, 1, False), (300, 4, True), (599, 5, False), (600, 5, True), (600, 6, False), (900, 6, True)])
def test_polish_clock(spark, t, count, due):
    assert one(spark, chunks.polish_due(F.lit(float(t)), F.lit(count))) is due


# --- functions ----------------------------------------------------------------------------------------


def test_clocks(spark):
    want = {0.0: ("00:00:00,000", "0:00", "0s"), 59.9996: ("00:00:59,999", "0:59", "59s"), 3599.999: ("00:59:59,998", "59:59", "59m 59s"), 3600.0: ("01:00:00,000", "1:00:00", "60m 0s"), 36000.0: ("10:00:00,000", "10:00:00", "600m 0s")}
    for t, (srt, short, spoken) in want.items():
        r = spark.range(1).select(X.srt_time(F.lit(t)).alias("a"), X.short_time(F.lit(t)).alias("b"), X.duration_text(F.lit(t)).alias("c")).first()
        assert (r.a, r.b, r.c) == (srt, short, spoken)
    for s, v in {"01:02:03,500": 3723.5, "02:03.25": 123.25, "7.5": 7.5, "x": None, "1:2:3:4": None}.items():
        assert one(spark, X.parse_time(F.lit(s))) == v


def test_megabytes_round_half_to_even(spark):
    """Exact ties of the first decimal, as of .25 and .75, go to the even one."""
    sizes = [int(x * 1048576) for x in (0.25, 0.75, 957.25, 13304.25, 3.5, 0)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "i int, n long")
    assert [r.m for r in df.orderBy("i").select(X.megabytes("n").alias("m")).collect()] == [f"{n / 1048576:.1f} MB" for n in sizes]


def test_text_functions(spark):
    assert one(spark, X.safe_filename(F.lit(' .a/b:c?. '))) == "a_b_c_"
    assert one(spark, X.safe_filename(F.lit(" . "))) == "export"
    assert one(spark, X.slug(F.lit("--My Model 2!"))) == "my-model-2"
    assert one(spark, X.masked(F.lit("abcdefgh"))) == "abc**********fgh"
    assert one(spark, X.masked(F.lit("abc"))) == "**********"
    assert one(spark, X.words(F.lit("  a  b\tc "))) == ["a", "b", "c"]
    assert one(spark, X.is_lower(F.lit("12"))) is False
    assert [one(spark, X.is_hallucination(F.lit(t))) for t in ("<|x|>", "ok", "fine", "a|>b")] == [True, True, False, True]
    assert one(spark, X.upload_filename(F.lit("/x/Åsa mötet (1).mp4"))) == "Åsa_mötet__1_.mp4"
    assert one(spark, X.cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(2.0)))) == 0.0


def test_learned_terms():
    f = learned.corrected_phrases
    assert f("same", " same ") == [] and f(None, "x") == []
    assert f("we use cubernetes now", "we use Kubernetes now") == ["Kubernetes"]
    assert f("a b", "a Foo Bar b") == ["Foo Bar"]
    assert f("a b c", "a c") == []
    assert f("we go on", "we run on") == []  # short lower-case word
    assert f("hi there", "hi " + "x" * 120) == []


def test_json_recovery(spark):
    cases = {'{"a": 1}': {"a": 1}, '<think>{"b"}</think> {"a": 2}': {"a": 2}, 'x\n```json\n{"a": 3}\n```': {"a": 3}, 'so: [1, 2] done': [1, 2], "none": None, None: None}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string").orderBy("i")
    got = [r.x and json.loads(r.x) for r in df.select("i", learned.answer_json("t").alias("x")).orderBy("i").collect()]
    assert got == list(cases.values())


def test_json_spans_ignore_brackets_in_strings():
    assert learned.recovered_json('say {"a": "}]{"} [1]') == '{"a":"}]{"}'
    assert learned.recovered_json('[1, {"b": ') is None and learned.recovered_json("{x} [2]") == "[2]"
    assert learned.recovered_json('```\n{bad}\n``` then {"ok": [1, 2]}') == '{"ok":[1,2]}'


def test_protocol_blocks(spark):
    text = "# **Title**\n\n§ 2 Next\ntext one\nDECISION: inside\n- ACTION: do *it*\n3. three\n---\nDECISION: go\nmore\nACTION: also\n#tag line\njoined\n"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "k int, md string")
    b = learned.block_rows(df, "md", "k").orderBy("block").collect()
    assert [(x["kind"], x["level"], x["mark"], x["text"]) for x in b] == [
        ("heading", 1, None, "Title"), ("heading", 2, None, "§ 2 Next"), ("paragraph", 0, None, "text one DECISION: inside"), ("bullet", 0, "action", "ACTION: do *it*"), ("number", 0, None, "three"), ("rule", 0, None, ""),
        ("paragraph", 0, "decision", "DECISION: go"), ("paragraph", 0, None, "more ACTION: also"), ("paragraph", 0, None, "#tag line joined"),
    ]
    assert [tuple(r) for r in b[3].runs] == [("ACTION: do ", False, False), ("it", False, True)]
    assert b[6].runs[0].bold and {x.k for x in b} == {1}
    runs = {t: [tuple(r) for r in one(spark, learned.inline_runs(F.lit(t)))] for t in ("a ***b*** **c**", "2 * 3 * 4", "a * b", "", "x **y")}
    assert runs["a ***b*** **c**"] == [("a ", False, False), ("b", True, True), (" ", False, False), ("c", True, False)]
    assert runs["2 * 3 * 4"] == [("2 ", False, False), (" 3 ", False, True), (" 4", False, False)]
    assert runs["a * b"] == [("a * b", False, False)] and runs[""] == []


def test_runs_of_stars(spark):
    """Every text of a few stars and letters against the rules by plain expressions; a text is taken apart once."""

    def plain(text):
        out = []
        for t in re.findall(learned.MARKED, text):
            n = 3 if re.search(r"(?s)^\*{3}.*\*{3}$", t) else 2 if re.search(r"(?s)^\*\*.*\*\*$", t) or t == "**" else 1 if re.search(r"(?s)^\*.*\*$", t) and len(t) > 1 else 0
            if not n and out and out[-1][3]:
                out[-1] = (out[-1][0] + t, False, False, True)
            else:
                out.append((t[n : max(len(t) - n, n)], n >= 2, n in (1, 3), not n))
        return [r[:3] for r in out]

    texts = ["".join(x) for n in range(8) for x in product("*a\n", repeat=n)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", learned.inline_runs("t").alias("r"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    for r in got.collect():
        assert [tuple(x) for x in r.r] == plain(r.t), r.t


def test_encryption(spark):
    key = learned.recording_key("pw", b"s" * 16, rounds=10)
    df = spark.createDataFrame([("a",), (None,), ("",)], "text string")
    enc = mutate.crypt_texts(df, ["text"], lambda c: learned.encrypted(c, key))
    assert sorted(map(str, (r.text for r in mutate.crypt_texts(enc, ["text"], lambda c: learned.decrypted(c, key)).collect()))) == ["", "None", "a"]
    assert {r.text for r in enc.collect()} & {"a"} == set()


# --- speakers -----------------------------------------------------------------------------------------


def test_names_and_colours(spark):
    labels = spark.createDataFrame([(1, x) for x in ("S0", "S1", "S2", "UNKNOWN")] + [(2, f"S{i:02d}") for i in range(11)], "meeting_id int, label string")
    answers = spark.createDataFrame([(1, "S1", "Ann", 0), (1, "S9", "Ghost", 1), (1, "", "x", 2), (1, "S1", "Anna", 3)], "meeting_id int, label string, name string, pos int")
    got = {(r.meeting_id, r.label): r for r in speakers.name_speakers(labels, speakers.intro_names(answers)).collect()}
    assert {k[1]: v.display_name for k, v in got.items() if k[0] == 1} == {"S1": "Anna", "S9": "Ghost", "S0": "Participant 3", "S2": "Participant 4", "UNKNOWN": "Unknown"}
    assert got[2, "S00"].display_name == "Participant 1" and got[2, "S10"].color == schemas.PALETTE[0] and got[1, "UNKNOWN"].color == schemas.UNKNOWN_COLOR


def test_profiles(spark):
    p = spark.createDataFrame([(1, "Ann", [1.0, 0.0]), (2, "Bob", [0.0, 1.0]), (3, "Zero", [0.0, 0.0]), (4, "Ann2", [1.0, 0.0])], "profile_id int, name string, embedding array<double>")
    q = spark.createDataFrame([(1, [2.0, 0.1]), (2, [-1.0, -1.0]), (3, [0.0, 0.0])], "vec_id int, embedding array<double>")
    got = {r.vec_id: r.profile for r in speakers.match_profiles(q, p).collect()}
    assert got == {1: "Ann", 2: None, 3: None}
    assert {r.vec_id: r.profile for r in speakers.match_profiles(q, p, block=1).collect()} == got
    t = spark.createDataFrame([(1, 0, 0.0, 1.9, "A"), (1, 1, 5.0, 8.0, "B"), (1, 2, 10.0, 13.0, "B"), (1, 3, 0.0, 40.0, "C")], "meeting_id int, di int, ds double, de double, lab string")
    assert {r.label: (r.ds, r.clip) for r in speakers.longest_turn(t).collect()} == {"B": (5.0, 3.0), "C": (0.0, 15.0)}


def test_merge_keeps_time(spark):
    s = segs(spark, [(0, 2, "a", 1), (2, 5, "b", 2), (5, 6, "c", 3)])
    sp = speakers.refreshed(spark.createDataFrame([(1, i, f"L{i}", None, 0, 0.0) for i in (1, 2, 3)], "meeting_id long, speaker_id long, label string, display_name string, segment_count long, total_speaking_time double"), s)
    m = spark.createDataFrame([(1, 2, 1), (1, 3, 99)], "meeting_id long, source_id long, target_id long")
    left, moved = speakers.merge_speakers(sp, s, m)
    assert {r.speaker_id: (r.segment_count, r.total_speaking_time) for r in left.collect()} == {1: (2, 5.0), 3: (1, 1.0)}
    assert moved.where("speaker_id = 2").count() == 0 and moved.count() == 3


def test_clips(spark):
    got = speakers.clip_budget(segs(spark, [(0, 20, "a", 1), (20, 35, "b", 1), (40, 50, "c", 1), (0, 5, "d", None)])).orderBy("ord").collect()
    assert [(r.ord, r.clip) for r in got] == [(0, 20.0), (1, 10.0)]


# --- analytics, search, documents -----------------------------------------------------------------------


def test_analytics_guards(spark):
    m = spark.createDataFrame([(1, 0.0), (2, 5.0), (3, None)], "meeting_id long, duration double")
    sp = spark.createDataFrame([(1, 1, "A", None, 0, 0.0), (2, 2, "B", "", 0, 9.0), (2, 3, "C", "Cy", 7, 3.0)], "meeting_id long, speaker_id long, label string, display_name string, segment_count long, total_speaking_time double")
    got = {r.speaker_id: r for r in analytics.meeting_analytics(m, sp, segs(spark, [(0, 1, "t", 2)], 2)).collect()}
    assert (got[1].percentage, got[1].silence_percentage) == (0.0, 0.0)
    assert (got[2].name, got[2].segment_count, got[2].percentage, got[2].silence_percentage, got[2].position) == ("B", 1, 75.0, 0.0, 1)
    assert got[3].segment_count == 7


def test_search_rules(spark):
    s = segs(spark, [(0, 1, "Budget plan for plan", None), (1, 2, "the planner", 5), (2, 3, "100% sure", 5), (3, 4, "plan, budget!", 5)])
    m = spark.createDataFrame([(1, "M", 1)], "meeting_id long, title string, created_at int")
    sp = spark.createDataFrame([(1, 5, "Ann")], "meeting_id long, speaker_id long, display_name string")
    assert [r.ord for r in search.search(s, m, sp, "plan budget").collect()] == [3, 0]
    assert {r.ord for r in search.search(s, m, sp, "plan").collect()} == {0, 1, 3}
    assert [r.ord for r in search.search(s, m, sp, "1_0%").collect()] == [2]
    assert search.search(s, m, sp, "plan").where("ord = 0").first().speaker_name is None
    assert search.search(s, m.withColumn("is_encrypted", F.lit(True)), sp, "plan").count() == 0


def test_documents(spark):
    s = segs(spark, [(0, 1.5, "Hi", 1), (1.5, 3, "there", 1), (3600, 3601.25, "Yes & no", None)])
    sp = spark.createDataFrame([(1, 1, "L", "Ann")], "meeting_id long, speaker_id long, label string, display_name string")
    m = spark.createDataFrame([(1, "T", 3661.0)], "meeting_id long, title string, duration double")
    assert render.srt(s, sp).first().content == "﻿1\n00:00:00,000 --> 00:00:01,500\n[Ann] Hi\n\n2\n00:00:01,500 --> 00:00:03,000\n[Ann] there\n\n3\n01:00:00,000 --> 01:00:01,250\n[Unknown] Yes & no\n"
    assert render.vtt(s, sp).first().content.startswith("WEBVTT\n\n00:00:00.000 --> 00:00:01.500\n<v Ann>Hi\n\n")
    assert render.txt(s, sp).first().content == "Ann:\n  Hi\n  there\n\nUnknown:\n  Yes & no"
    assert render.markdown(m, s, sp).first().content == "# T\n\n**Duration:** 1:01:01\n\n\n### Ann [0:00]\n\nHi\nthere\n\n### Unknown [1:00:00]\n\nYes & no"
    assert json.loads(render.json_document(m, s, sp).first().content)["segments"][2] == {"start": 3600.0, "end": 3601.25, "speaker": "Unknown", "text": "Yes & no"}
    assert [r.markup_text for r in render.document_blocks(m, s, sp).orderBy("block").collect()][-1] == "Yes &amp; no"
    assert [r.key for r in render.events(spark.createDataFrame([(1, "progress", 5.0)], "meeting_id int, type string, progress double")).collect()] == ["meeting:1"]
    r = spark.createDataFrame([(1, "Sum", "T", "## A\nb")], "result_id int, action_name string, title string, result_text string")
    assert [(x.level, x.text) for x in render.action_blocks(r).orderBy("block").collect()] == [(2, "A"), (0, "b")]
    assert render.action_document(r).first().content.startswith("# Sum\n\n**Meeting:** T")
    assert render.signed(m).count() == 2


def test_recording_buckets_are_replaced_alone(spark, tmp_path):
    a = segs(spark, [(0, 1, "a", 1)], 1).unionByName(segs(spark, [(0, 1, "b", 1)], 2))
    render.write_recordings(a, str(tmp_path / "t"))
    render.write_recordings(segs(spark, [(0, 1, "new", 1)], 1), str(tmp_path / "t"))
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["b", "new"]


# --- sources --------------------------------------------------------------------------------------------


def test_transcript_files(spark, tmp_path):
    item = lambda t, a, b, tok: {"text": t, "timestamps": {"from": a, "to": b}, "tokens": tok}
    (tmp_path / "a.json").write_text(json.dumps({"transcription": [item(" Hi ", "00:00:01,000", "00:00:02,500", [{"id": 1, "p": 0.5}, {"id": 50256, "p": 0.25}, {"id": 50257, "p": 0.1}, {"id": 2, "p": 0}]), item("  ", "0", "1", []), item("x", "00:03", "4", [])]}))
    got = readers.transcript_files(spark, str(tmp_path / "*.json")).orderBy("ord").collect()
    assert [(r.text, r.start, r.end, r.confidence) for r in got] == [("Hi", 1.0, 2.5, 0.375), ("x", 3.0, 4.0, None)]


def test_presets_and_preferences(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "one", "type": "llm"}')
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text('{"type": "whisper"}')
    (tmp_path / "d.json").write_text('{"id": "one", "type": "llm2"}')
    p = readers.presets(spark, str(tmp_path))
    assert {r.id: r.type for r in p.collect()} == {"one": "llm2", "c": "whisper"}
    s = spark.createDataFrame([("live", "one")], "task string, preset_id string")
    assert {r.task: r.type for r in models.preset_for_task(s, p).collect()}["live"] == "llm2"
    prefs = {r.key: r.shown for r in readers.preferences(spark, '{"llm_api_key": "abcdefghij", "x": "y"}').collect()}
    assert prefs == {"default_vocabulary": "", "speaker_profiles_enabled": "false", "hf_auth_token": "", "llm_api_key": "abc**********hij", "x": "y"}
    assert readers.preferences(spark, "{bad").count() == 4


def test_uploads(spark, tmp_path):
    (tmp_path / "m.mp4").write_bytes(b"x" * 10)
    u = readers.uploads(spark, str(tmp_path)).first()
    assert (u.name, u.size) == ("m.mp4", 10)
    rows = [(" T ", "a b.MP4", 5, 1, 2, " v "), ("", "a.mp4", 5, None, None, None), ("t", "a.txt", 5, None, None, None), ("t", "a.mp4", 5, 3, 2, None), ("t", "a.mp4", 6 * 1024**3, None, None, None)]
    got = readers.checked_uploads(spark.createDataFrame(rows, "title string, name string, size long, min_speakers int, max_speakers int, vocabulary string"), "dv").collect()
    assert got[0] == Row(title="T", name="a_b.MP4", extension=".mp4", size=5, min_speakers=1, max_speakers=2, vocabulary="v", error=None)
    assert got[1].vocabulary == "dv" and all(r.error for r in got[1:])


def test_schema_evolution(spark):
    old = spark.createDataFrame([("1", "A", "p", True)], "action_id string, name string, prompt string, extra boolean")
    new = schemas.conform(old, "actions")
    assert new.columns == [f.name for f in schemas.TABLES["actions"].fields]
    assert schemas.violations(new, "actions").first().reasons == ["is_default is null", "created_at is null"]


# --- state ----------------------------------------------------------------------------------------------


def test_mutations(spark):
    v = spark.createDataFrame([("x", 1, "m1"), ("y", 2, "m2")], "term string, frequency long, source_meeting_id string")
    gone = spark.createDataFrame([("m1",)], "meeting_id string")
    out = mutate.delete_meetings({"meetings": gone, "vocabulary_entries": v}, gone)
    assert out["meetings"].count() == 0 and {r.term: r.source_meeting_id for r in out["vocabulary_entries"].collect()} == {"x": None, "y": "m2"}
    l = vocabulary.learn(spark.createDataFrame([("m3", "use fobar", "use Foobar"), ("m3", "use fobar", "use Foobar")], "meeting_id string, old_text string, new_text string"))
    assert {r.term: r.frequency for r in vocabulary.merge_terms(v, l).collect()} == {"x": 1, "y": 2, "Foobar": 2}
    a = spark.createDataFrame([("1", "A")], "action_id string, name string")
    d = spark.createDataFrame([("2", "A"), ("3", "B")], "action_id string, name string")
    assert sorted(r.name for r in mutate.seed(a, d).collect()) == ["A", "B"]
    assert sorted(r.action_id for r in mutate.upsert(a, d, "name").collect()) == ["2", "3"]
    s = segs(spark, [(0, 1, "a", 1)])
    assert mutate.move_segments(s, spark.createDataFrame([(1, 0, None)], "meeting_id long, ord long, speaker_id long")).first().speaker_id is None
    sp = spark.createDataFrame([(1, "A", "red", None)], "speaker_id int, display_name string, color string, identified_by string")
    c = spark.createDataFrame([(1, "Ann", None)], "speaker_id int, display_name string, color string")
    assert mutate.rename_speakers(sp, c).first() == Row(speaker_id=1, display_name="Ann", color="red", identified_by="manual")


def test_models(spark):
    df = spark.createDataFrame([("a",), ("bad",)], "q string")

    def model(q):
        if q == "bad":
            raise RuntimeError("down")
        return q.upper()

    assert {r.q: r.answer for r in models.run_model(df, ["q"], model).collect()} == {"a": "A", "bad": None}
    a = spark.createDataFrame([(1, 0, 10.0, '{"speaker_count": 2, "names": ["A"], "intro_ongoing": true}'), (1, 1, 20.0, '{"names": ["B", "A"], "intro_ongoing": false}'), (1, 2, 30.0, None)], "meeting_id int, chunk int, end_time double, answer string")
    r = models.intro_result(a).first()
    assert (r.speaker_count, r.names, r.intro_end_time) == (2, ["A", "B"], 20.0)


# --- live -----------------------------------------------------------------------------------------------


def chunk_rows():
    e = lambda *x: list(map(float, x))
    rows = [(900.0, 0.0, 3.5, "hello there", e(1, 0)), (10.0, 0.0, 3.5, "too quiet", e(1, 0)), (900.0, 0.0, 3.5, "<|x|>", e(1, 0)), (900.0, 0.0, 3.5, "ok", e(1, 0)), (900.0, 0.0, 1.9, "short one", e(0, 1)), (900.0, 0.0, 3.5, "other voice", e(0, 1)), (900.0, 0.0, 3.5, "near first", e(0.45, 0.8930)), (900.0, 0.0, 1.0, "short again", e(1, 0)), (900.0, 0.0, 3.5, "no vector", None)]
    return [(r, i, 4.0 if i != 1 else None, *x) for r in (1, 2) for i, x in enumerate(rows * 3)]


SCHEMA = "recording long, arrival long, seconds double, loudness double, start double, end double, text string, embedding array<double>"


def test_live_rules(spark):
    got = [r for r in live.live_batch(spark.createDataFrame(chunk_rows()[:9], SCHEMA)).orderBy("ord").collect() if r.kind == "segment"]
    assert [(r.ord, r.text, r.start_time, r.speaker_label) for r in got] == [(1, "hello there", 0.0, "Speaker 1"), (2, "short one", 12.0, "Speaker 1"), (3, "other voice", 16.0, "Speaker 2"), (4, "near first", 20.0, "Speaker 2"), (5, "short again", 24.0, "Speaker 2"), (6, "no vector", 28.0, "Speaker 2")]
    assert got[1].prompt == "hello there"


def test_rolling_prompt_and_clock(spark):
    p = chunks.rolling_prompt(segs(spark, [(0, 1, " ".join(f"w{i}_{j}" for j in range(20)), 1) for i in range(3)])).orderBy("ord").collect()
    assert p[0].prompt is None and len(p[1].prompt.split()) == 20 and p[2].prompt.split()[0] == "w0_10" and len(p[2].prompt.split()) == 30
    c = spark.createDataFrame([(1, 0, 4.0), (1, 1, None), (1, 2, 3.0)], "recording int, arrival int, seconds double")
    assert [r.chunk_start for r in chunks.clock(c).orderBy("arrival").collect()] == [0.0, 4.0, 4.0]
