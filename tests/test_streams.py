"""Streams with restarts, and tables in committed versions."""

import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parlance.operators import mutate
from parlance.sources import committed
from parlance.sources.committed import Conflict, KeyedTable
from parlance.sources.folders import create_json, names, read_json, shared_folder
from parlance.streaming import live
from parlance.streaming.replay import replay

from test_operators import SCHEMA, chunk_rows

ROWS = "k long, n long, v string"


def table(spark, path, **how):
    return KeyedTable(spark, str(path), "k", **how)


def rows(spark, *values):
    return spark.createDataFrame(list(values), ROWS)


def held(t):
    return sorted((r.k, r.n, r.v) for r in t.read().collect())


# --- files that one writer creates --------------------------------------------------------------------


def test_of_many_writers_one_creates(spark, tmp_path):
    won = []
    run = lambda i: won.append(i) if create_json(spark, f"{tmp_path}/m/x.json", {"by": i}) else None
    threads = [threading.Thread(target=run, args=(i,)) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and read_json(spark, f"{tmp_path}/m/x.json") == {"by": won[0]}
    assert names(spark, f"{tmp_path}/m") == ["x.json"] and names(spark, f"{tmp_path}/none") == []


def test_other_file_systems_rename_without_overwriting(spark, tmp_path):
    """The path through ``FileContext``, on a view of the same disk."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.t.link./d", f"file://{tmp_path}")
    assert create_json(spark, "viewfs://t/d/a.json", {"x": 1})
    assert not create_json(spark, "viewfs://t/d/a.json", {"x": 2})
    assert read_json(spark, "viewfs://t/d/a.json") == {"x": 1} and [n for n in names(spark, "viewfs://t/d") if "tmp" in n] == []


def test_folders_lie_where_the_session_says(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    made = {shared_folder(spark, "x") for _ in range(3)}
    assert len(made) == 3 and all("/x-" in m and m.startswith(base or "/") for m in made)


# --- versions -----------------------------------------------------------------------------------------


def test_merge_read_and_versions(spark, tmp_path):
    t = table(spark, tmp_path)
    with pytest.raises(FileNotFoundError):
        t.read()
    assert t.merge(rows(spark, (1, 0, "a"), (2, 0, "b"))) == 0
    assert t.merge(rows(spark, (2, 0, "c"), (3, 0, "d")), gone=rows(spark, (1, 0, "x"))) == 1
    assert held(t) == [(2, 0, "c"), (3, 0, "d")]
    assert sorted(r.v for r in t.read(0).collect()) == ["a", "b"]
    assert t.compact() == 2 and held(t) == [(2, 0, "c"), (3, 0, "d")] and t.compact() == 2
    t.merge(rows(spark, (1, 0, "back")))
    assert held(t)[0] == (1, 0, "back")
    t.forget(keep=1)
    assert held(t) == [(1, 0, "back"), (2, 0, "c"), (3, 0, "d")] and len(names(spark, f"{tmp_path}/parts")) == 2
    with pytest.raises(ValueError, match="columns"):
        t.merge(spark.createDataFrame([(1, "x")], "k long, other string"))


def test_the_highest_sequence_wins_whatever_comes_last(spark, tmp_path):
    t = table(spark, tmp_path, order="n")
    t.merge(rows(spark, (1, 5, "five"), (1, 7, "seven"), (1, 6, "six"), (2, 1, "one")))
    t.merge(rows(spark, (1, 6, "late"), (2, 2, "two")))
    assert held(t) == [(1, 7, "seven"), (2, 2, "two")]
    t.merge(rows(spark, (2, 2, "two again")))  # as high: the later version
    assert held(t)[1] == (2, 2, "two again")
    tied = [rows(spark, (9, 1, "x"), (9, 1, "y")), rows(spark, (9, 1, "y"), (9, 1, "x"))]
    kept = []
    for i, r in enumerate(tied):
        own = table(spark, f"{tmp_path}/tie{i}", order="n")
        own.merge(r)
        kept += held(own)
    assert len(set(kept)) == 1  # one of equals, whatever their order


def test_a_killed_and_repeated_batch_gives_the_same_table(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path, order="n")
    write = t.sink("s")
    write(rows(spark, (1, 1, "a"), (2, 1, "b")), 0)
    with monkeypatch.context() as m:
        m.setattr(committed, "create_json", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):  # killed with its part written
            write(rows(spark, (2, 2, "c"), (3, 1, "d")), 1)
    assert held(t) == [(1, 1, "a"), (2, 1, "b")] and len(names(spark, f"{tmp_path}/parts")) == 2
    for _ in range(3):
        write(rows(spark, (2, 2, "c"), (3, 1, "d")), 1)
    assert held(t) == [(1, 1, "a"), (2, 2, "c"), (3, 1, "d")] and t.version() == 1
    t.sink("other")(rows(spark, (4, 1, "e")), 1)  # batches are counted by stream
    write(rows(spark, (9, 9, "old batch")), 0)
    assert [k for k, *_ in held(t)] == [1, 2, 3, 4]
    t.compact()
    write(rows(spark, (9, 9, "old batch")), 1)
    assert [k for k, *_ in held(t)] == [1, 2, 3, 4]
    t.forget()
    assert held(t)[1] == (2, 2, "c")


def test_a_batch_of_one_key_writes_one_small_file(spark, tmp_path):
    t = table(spark, tmp_path, order="n")
    t.merge(spark.range(20_000).select(F.col("id").alias("k"), F.lit(0).cast("long").alias("n"), F.lit("x").alias("v")))
    before = set(names(spark, f"{tmp_path}/parts"))
    t.sink("s")(rows(spark, (5, 1, "y")), 0)
    (new,) = set(names(spark, f"{tmp_path}/parts")) - before
    files = [n for n in names(spark, f"{tmp_path}/parts/{new}") if n.endswith(".parquet")]
    assert len(files) == 1 and spark.read.parquet(f"{tmp_path}/parts/{new}").count() == 1
    assert t.read().where("v = 'y'").collect()[0].k == 5 and t.read().count() == 20_000


def test_deltas_are_folded(spark, tmp_path):
    t = table(spark, tmp_path, order="n", fold=3)
    for i in range(7):
        t.sink("s")(rows(spark, (i % 2, i, str(i))), i)
    assert held(t) == [(0, 6, "6"), (1, 5, "5")] and len(t._manifest(t.version())["deltas"]) < 3


def test_two_writers_from_one_version(spark, tmp_path):
    t = table(spark, tmp_path)
    v = t.merge(rows(spark, (1, 0, "idle")))
    assert t.merge(rows(spark, (1, 0, "mine")), expected=v) == v + 1
    with pytest.raises(Conflict):
        t.merge(rows(spark, (1, 0, "late")), expected=v)
    assert held(t) == [(1, 0, "mine")] and len(names(spark, f"{tmp_path}/parts")) == 2
    t.merge(rows(spark, (1, 0, "blind")))  # without a version: on top of whatever is there
    assert held(t) == [(1, 0, "blind")]


def test_of_two_starts_one_wins_and_the_other_is_busy(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), "meeting_id")
    t.merge(spark.createDataFrame([(1, "completed"), (2, "processing"), (3, "completed")], "meeting_id long, status string"))
    want = spark.createDataFrame([(1,), (2,), (9,)], "meeting_id long")
    answers, gate = [], threading.Barrier(2)
    inner = KeyedTable.merge

    def together(self, *a, **k):  # both have read the same version before either commits
        gate.wait(60)
        KeyedTable.merge = inner
        return inner(self, *a, **k)

    def ask():
        answers.append({r.meeting_id: r.started for r in mutate.start_committed(KeyedTable(spark, str(tmp_path), "meeting_id"), want).collect()})

    KeyedTable.merge = together
    try:
        threads = [threading.Thread(target=ask) for _ in range(2)]
        [x.start() for x in threads]
        [x.join() for x in threads]
    finally:
        KeyedTable.merge = inner
    assert sorted(a[1] for a in answers) == [False, True] and all(a[2] is False and 9 not in a for a in answers)
    assert {r.meeting_id: r.status for r in t.read().collect()} == {1: "processing", 2: "processing", 3: "completed"}


def test_replaced_recordings(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), "meeting_id", "ord")
    make = lambda *x: spark.createDataFrame(list(x), "meeting_id long, ord long, text string")
    t.merge(make((1, 0, "a"), (1, 1, "b"), (2, 0, "c")))
    mutate.replace_recordings(t, make((1, 0, "new")))
    assert sorted(tuple(r) for r in t.read().collect()) == [(1, 0, "new"), (2, 0, "c")]


# --- streams ------------------------------------------------------------------------------------------

KEYS = ["recording", "arrival", "kind", "ord"]


def same(a, b):
    key = lambda df: sorted(map(str, df.select("recording", "arrival", "kind", "ord", "start_time", "end_time", "text", "speaker_label", "prompt", "clock").collect()))
    assert key(a) == key(b)


def test_stream_with_restarts_equals_batch(spark):
    chunks = spark.createDataFrame([r + (r[1] in (7, 20),) for r in chunk_rows()], SCHEMA + ", stop boolean")
    got = replay(chunks, "arrival", live.live_stream, KEYS, slices=3)
    same(got, live.live_batch(chunks))
    ends = {(r.recording, r.arrival): (r.ord, r.clock) for r in got.where("kind = 'stopped'").collect()}
    assert set(ends) == {(1, 7), (1, 20), (2, 7), (2, 20)} and ends[1, 7] == (4, 24.0)
    after = got.where("recording = 1 and kind = 'segment' and arrival > 7").orderBy("arrival").first()
    assert (after.ord, after.start_time, after.speaker_label, after.prompt) == (1, 0.0, "Speaker 1", None)


def test_polish_marks_catch_up_one_a_chunk(spark):
    rows = [(1, i, float(s), None, 0.0, 0.0, None, None) for i, s in enumerate([30, 500, 1, 1, 1, 1, 1, 1, 400, 2000, 1, 1])]
    chunks = spark.createDataFrame(rows, SCHEMA)
    state, want = live.LiveState(), []
    for r in rows:
        want += [(m[1], m[3]) for m in state.step(*r)]
    got = live.live_batch(chunks)
    assert sorted((r.arrival, r.ord) for r in got.collect()) == want and len(want) > 6


def test_state_of_silent_recordings_ends(spark, tmp_path):
    """With a time to live the states ask for it; a query of timed states runs until it is stopped."""
    asked = []

    class Handle:
        def __getattr__(self, name):
            return lambda *a: asked.append((name, a[-1]))

    live.LiveProcessor(5000).init(Handle())
    assert asked == [("getValueState", 5000), ("getMapState", 5000), ("getListState", 5000)]


def test_the_fold_takes_batches_of_many_recordings(spark):
    """Recordings of a few chunks cost no call each, and a recording goes on over batches."""
    chunks = spark.createDataFrame([r + (r[1] == 20,) for r in chunk_rows()], SCHEMA + ", stop boolean")
    got = live.live_batch(chunks)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()
    want = got.collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert sorted(map(str, live.live_batch(chunks).collect())) == sorted(map(str, want)) and len(want) > 20
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_centroids_are_kept_in_blocks():
    """130 voices are three entries of the state, and come back as they were; a batch writes the blocks it has moved."""
    calls, held = [], {}

    class State:
        def __init__(self, name):
            self.name = name

        def __getattr__(self, what):
            def call(*a):
                calls.append((self.name, what))
                if what in ("update", "put"):
                    held[self.name] = a[0]
                elif what == "updateValue":
                    held[self.name, a[0]] = a[1]
                return held.get((self.name, *a) if what == "getValue" else self.name)

            return call

    class Handle:
        def __getattr__(self, _):
            return lambda name, *a: State(name)

    frame = lambda i: pd.DataFrame([(1, i, 4.0, 900.0, 0.0, 3.5, "some words", np.eye(130)[i % 130], False)], columns=[*live.INPUT, "stop"])
    processor = live.LiveProcessor()
    processor.init(Handle())
    first = pd.concat([frame(i) for i in range(130)])
    assert list(next(processor.handleInputRows((1,), iter([first]), None)).speaker_label)[-1] == "Speaker 130"
    assert calls.count(("centroids", "updateValue")) == 3
    calls.clear()
    again = next(processor.handleInputRows((1,), iter([frame(195)]), None))
    assert list(again.speaker_label) == ["Speaker 66"]
    assert calls.count(("centroids", "getValue")) == 3 and calls.count(("centroids", "updateValue")) == 1
