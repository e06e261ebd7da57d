import json
import os
import threading
import time
from collections import Counter

import pytest
from conftest import rows

from quillframe.operators import completion, postprocess, reports, revisions


def prompts(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "k int, prompt string")


def by_text(asked, results):
    joined = completion.with_prompt_hash(asked).join(results, "prompt_hash")
    return rows(joined, "prompt", "text", "attempts", "status", "error")


def test_retries_per_prompt(spark):
    def make():
        seen = Counter()

        def complete(batch):
            seen.update(batch)
            return [
                ValueError("no") if p == "never" or (p == "third" and seen[p] < 3) else p.upper() for p in batch
            ]

        return complete

    asked = prompts(spark, "a", "third", "never", "a")
    results = completion.complete_prompts(asked, make, backoff=0)
    assert results.count() == 3  # equal prompts are sent once
    assert by_text(asked, results) == [
        ("a", "A", 1, "completed", None), ("a", "A", 1, "completed", None),
        ("never", None, 6, "failed", "no"), ("third", "THIRD", 3, "completed", None),
    ]
    assert rows(completion.completed_texts(asked, results), "k", "text") == [(0, "A"), (1, "THIRD"), (3, "A")]
    assert rows(completion.not_completed(asked, results), "k") == [(2,)]


def test_raising_and_short_replies_are_failures(spark):
    def broken():
        def complete(batch):
            raise ConnectionError("down")

        return complete

    def short():
        return lambda batch: []

    asked = prompts(spark, "a", "b")
    for make, error in ((broken, "down"), (short, "one reply per prompt expected")):
        results = completion.complete_prompts(asked, make, max_retries=1, backoff=0)
        assert {tuple(r) for r in rows(results, "attempts", "status", "error")} == {(2, "failed", error)}


def failing_model(folder, fails):
    """Fails so many times per prompt, counting calls in files as a hosted model would."""
    def make():
        def complete(batch):
            out = []
            for p in batch:
                log = os.path.join(folder, p)
                with open(log, "a") as f:
                    f.write("x")
                out.append(ValueError("busy") if os.path.getsize(log) <= fails.get(p, 0) else p.upper())
            return out
        return complete
    return make


def calls(folder):
    return {name: os.path.getsize(os.path.join(folder, name)) for name in os.listdir(folder)}


def test_no_task_waits_between_rounds(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    make, waits = failing_model(str(tmp_path / "calls"), {"b": 1, "c": 3, "d": 99}), []

    def wait(seconds):
        assert spark.sparkContext.statusTracker().getActiveStageIds() == []  # all slots are free
        waits.append(seconds)

    asked = prompts(spark, "a", "b", "c", "d", "a")
    results = completion.complete_in_rounds(asked, make, str(tmp_path / "replies"), max_retries=4, backoff=5, wait=wait, call_size=2, in_flight=3)
    assert waits == [5, 10, 15, 20]
    assert by_text(asked, results) == [
        ("a", "A", 1, "completed", None), ("a", "A", 1, "completed", None), ("b", "B", 2, "completed", None),
        ("c", "C", 4, "completed", None), ("d", None, 5, "failed", "busy")]
    assert calls(tmp_path / "calls") == {"a": 1, "b": 2, "c": 4, "d": 5}
    # a later run sends what failed for good anew, and nothing else
    completion.complete_in_rounds(asked, make, str(tmp_path / "replies"), max_retries=0, backoff=5, wait=wait).count()
    assert calls(tmp_path / "calls") == {"a": 1, "b": 2, "c": 4, "d": 6} and len(waits) == 4


def test_a_killed_run_goes_on_with_its_round(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    make, root = failing_model(str(tmp_path / "calls"), {"b": 3, "c": 99}), str(tmp_path / "replies")

    def killed(seconds):
        if seconds == 2:
            raise KeyboardInterrupt

    asked = prompts(spark, "a", "b", "c")
    with pytest.raises(KeyboardInterrupt):
        completion.complete_in_rounds(asked, make, root, max_retries=4, backoff=1, wait=killed)
    assert calls(tmp_path / "calls") == {"a": 1, "b": 2, "c": 2}
    waits = []
    results = completion.complete_in_rounds(asked, make, root, max_retries=4, backoff=1, wait=waits.append)
    assert waits == [3, 4] and calls(tmp_path / "calls") == {"a": 1, "b": 4, "c": 5}
    assert by_text(asked, results) == [
        ("a", "A", 1, "completed", None), ("b", "B", 4, "completed", None), ("c", None, 5, "failed", "busy")]


def test_calls_under_way_are_bounded_and_in_order():
    running, most, lock = [0], [0], threading.Lock()

    def work(n):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.01)
        with lock:
            running[0] -= 1
        return n * n

    for limit in (1, 3):
        most[0] = 0
        assert list(completion._side_by_side(work, iter(range(12)), limit)) == [n * n for n in range(12)]
        assert most[0] <= limit
    assert most[0] == 3


def test_post_processor(spark):
    contents = {1: "` ``py\nx", 2: "", 3: "# t\nok\n"}
    data = [(k, json.dumps({"new_file_content": v})) for k, v in contents.items()] + [(4, "{not json"), (5, "{}")]
    df = spark.createDataFrame(data, "k int, args string")
    done = postprocess.apply_named(df, "write_new_content", '{"tag": "# t"}')
    assert rows(done, "k", "new_content") == [(1, "# t\n```py\nx\n"), (3, "# t\nok\n")]
    with pytest.raises(ValueError):
        postprocess.apply_named(df, "unknown")


PAIRS = [
    (1, "a\nb\nb\nc", "a\nb\nd\nc"), (2, "same", "same"), (3, None, "new\nnew"), (4, "gone\n", ""), (5, "x\ny", "y\nx"), (6, None, None),
]


def test_line_changes_are_multiset_differences(spark):
    df = spark.createDataFrame(PAIRS, "k int, old string, new string")
    expected = []
    for key, old, new in PAIRS:
        before = Counter(old.split("\n") if old is not None else [])
        after = Counter(new.split("\n") if new is not None else [])
        expected += [(key, line, "added", n) for line, n in (after - before).items()]
        expected += [(key, line, "removed", n) for line, n in (before - after).items()]
    assert rows(revisions.line_changes(df, "k"), "k", "line", "change", "lines") == sorted(expected, key=repr)


def test_paired_versions(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, content string")
    new = spark.createDataFrame([("b", "3"), ("c", "4")], "path string, content string")
    assert rows(revisions.paired(old, new)) == [("a", "1", None), ("b", "2", "3"), ("c", None, "4")]


def test_reports_in_parts_join_to_the_whole(spark):
    paths = [f"d/{i:04d}.py" for i in range(200)]
    data = [("d", p) for p in paths] + [("e", "e/x.py")]
    df = spark.createDataFrame(data, "folder string, path string").repartition(6)
    whole = dict(rows(reports.change_reports(df), "folder", "body"))
    assert whole["d"] == reports.REPORT_HEADER + "".join(f"- `{p}`\n" for p in paths)
    parts = reports.change_reports(df, lines_per_part=7).where("folder = 'd'").orderBy("part").collect()
    assert len(parts) == 29 and "".join(p.body for p in parts) == whole["d"]


def test_approval(spark):
    changes = spark.createDataFrame([(i,) for i in range(5)], "k int")
    answers = spark.createDataFrame([(0, "y"), (1, " YES\n"), (2, "no"), (3, "perhaps")], "k int, answer string")
    assert rows(reports.approved_only(changes, answers, "k")) == [(0,), (1,)]


def test_last_message_may_be_a_user_turn(spark):
    data = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "again"), (2, 0, "user", "alone")]
    df = spark.createDataFrame(data, "conv_id int, turn int, role string, text string")
    assert rows(reports.last_messages(df), "conv_id", "role", "text") == [(1, "user", "again"), (2, "user", "alone")]
    assert rows(reports.last_messages(df, role="assistant"), "conv_id", "text") == [(1, "a")]
    assert rows(reports.messages_in_order(df), "conv_id", "turn", "position") == [(1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 1)]
    assert reports.last_messages(df.where("false")).count() == 0
