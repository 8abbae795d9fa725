"""Model calls with limits, kept answers, and the introduction's conversation in rounds; JSON in answers."""

import json
import os
import threading
import time

from parlance.functions import learned
from parlance.operators import models

CALLS = "meeting_id long, chunk int, text string, start_time double, end_time double"


def test_a_slow_call_is_given_up_and_tried_again():
    began, seen = time.time(), []

    def slow(q):
        seen.append(q)
        if len(seen) == 1:
            time.sleep(5)
        return "late" if len(seen) == 1 else "second"

    assert models.ask(slow, ("q",), 0.2, 2, 0.01, None) == "second" and time.time() - began < 3
    assert models.ask(lambda q: time.sleep(5), ("q",), 0.1, 2, 0.01, None) is None


def test_a_failing_call_is_tried_again_after_longer_waits(monkeypatch):
    waits, seen = [], []
    monkeypatch.setattr(models.time, "sleep", waits.append)

    def failing(q):
        seen.append(q)
        raise RuntimeError("no")

    assert models.ask(failing, ("q",), 1, 4, 0.5, None) is None
    assert len(seen) == 4 and waits == [0.5, 1.0, 2.0]


def test_kept_answers_are_not_asked_again(spark, tmp_path):
    log = tmp_path / "log"
    os.makedirs(log)
    kept = models.FolderAnswers(str(tmp_path / "answers"), "v1")

    def counted(q, n):
        with open(f"{log}/{q}-{n}-{time.time_ns()}", "w"):
            pass
        if q == "bad":
            raise RuntimeError
        return f"{q}{n}"

    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("bad", 3), ("é", 4)], "q string, n int").coalesce(1)
    run = lambda answers=kept: sorted((str(r.q), r.answer) for r in models.run_model(df, ["q", "n"], counted, wait=0.01, answers=answers).collect())
    first = run()
    assert [x for x in first if x[0] != "é"] == [("a", "a1"), ("a", "a1"), ("b", "b2"), ("bad", None)]
    calls = lambda: sorted(n.split("-")[0] for n in os.listdir(log))
    assert calls() == ["a", "b", "bad", "bad", "é"]  # equal inputs once, a failure twice
    assert run() == first and calls() == ["a", "b"] + ["bad"] * 4 + ["é"]
    assert run(models.FolderAnswers(str(tmp_path / "answers"), "v2")) == first and calls().count("a") == 2


def test_calls_run_side_by_side_up_to_a_bound(spark, tmp_path):
    """The most that runs at a time is seen from files."""
    lock, now, most = threading.Lock(), [0], [0]

    def busy(q):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.05)
        with lock:
            now[0] -= 1
        return str(most[0])

    import pandas as pd
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(3) as pool:
        got = list(pool.map(lambda v: models.ask(busy, (v,), 5, 1, 0, None), range(12)))
    assert max(map(int, got)) == 3 and len(pd.Series(got)) == 12


def test_rounds_ask_nothing_after_the_introduction(spark, tmp_path):
    os.makedirs(tmp_path / "log")
    log = str(tmp_path / "log")
    say = {  # (recording, chunk) -> answer
        (1, 0): {"intro_ongoing": True, "speaker_count": 2, "names": ["A"]}, (1, 1): {"intro_ongoing": False, "speaker_count": 3, "names": ["A", "B"]}, (1, 2): {"never": 1},
        (2, 0): None, (2, 1): {"speaker_count": 1}, (2, 2): None, (3, 0): {"intro_ongoing": False},
    }

    def model(history, prompt):
        m, c = map(int, prompt.split("\n")[1].split("/"))
        with open(f"{log}/{m}-{c}", "w") as f:
            f.write(history)
        answer = say.get((m, c), {"intro_ongoing": True})
        if answer is None:
            raise RuntimeError
        return "So: " + json.dumps(answer)

    rows = [(m, c, f"{m}/{c}", c * 30.0, c * 30.0 + 30) for m, n in ((1, 3), (2, 3), (3, 1), (4, 25)) for c in range(n)]
    got = {r.meeting_id: (r.speaker_count, r.names, r.intro_end_time, r.asked) for r in models.intro_rounds(spark.createDataFrame(rows, CALLS), model, tries=1).collect()}
    assert got == {1: (3, ["A", "B"], 60.0, 2), 2: (1, [], 60.0, 3), 3: (0, [], 30.0, 1), 4: (0, [], 600.0, 20)}
    asked = set(os.listdir(log))
    assert asked == {"1-0", "1-1", "2-0", "2-1", "2-2", "3-0"} | {f"4-{c}" for c in range(20)}
    assert open(f"{log}/1-0").read() == "" and '"names": ["A"]' in open(f"{log}/1-1").read()
    assert open(f"{log}/2-1").read().split("\n")[-1] == "2/0"  # of a failed call only the prompt stays
    assert models.intro_rounds(spark.createDataFrame([], CALLS), model).count() == 0


def test_json_has_one_form():
    read = learned.recovered_json
    assert read('{"b":1,"a":2.50}') == read('so {"b":1,"a":2.50}') == read('```json\n{"b":1,"a":2.50}\n```') == '{"a":2.5,"b":1}'
    assert read('{"a":1e400}') is None and read('x {"a":NaN}') is None and read('{"a":-Infinity} [1]') == "[1]"
    assert read('{"a":123456789012345678901234567890}') == '{"a":123456789012345678901234567890}'
    assert read('he said "it {"a": 1}') == '{"a":1}' and read('{"a": "}]{"} x') == '{"a":"}]{"}'
    assert read('[{"a": "open string} [2, 3]') == "[2,3]"


def test_json_in_many_brackets_takes_time_in_proportion():
    began = time.time()
    assert learned.recovered_json("[" * 100_000) is None
    assert learned.recovered_json("{x " * 50_000 + "}" * 50_000) is None
    assert time.time() - began < 5
