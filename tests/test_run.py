import json
import sys

from conftest import rows
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillframe import schemas
from quillframe.plans.run import RunSettings, run
from quillframe.sources import storage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the models below run in tasks

FILES = [
    ("top.py", "from lib import A\nx = 1\n"),
    ("pkg/a.py", "from lib import A\n"),
    ("pkg/sub/deep/b.py", "def f():\n    return '```'\n"),
    ("pkg/fail.py", "refuse = True\n"),
    ("pkg/same.py", "nothing = 1\n"),
]


def describer():
    return lambda batch: [RuntimeError("no") if "refuse" in p else f"about A {len(p)}" for p in batch]


def documenter():
    def complete(batch):
        replies = []
        for prompt in batch:
            code = prompt.rsplit("python\n", 1)[1][:-4]
            new = "" if "nothing" in code else '"""Doc."""\n' + code.rstrip("\n")
            replies.append(RuntimeError("no") if "refuse" in code else json.dumps({"new_file_content": new}))
        return replies

    return complete


def settings(tmp_path, second):
    return RunSettings(
        state_root=str(tmp_path / "state"), collection="run_vectors", package="lib", tag="# t",
        at=F.to_timestamp(F.lit(f"2024-01-01 00:00:0{second}")), retry=(("backoff", 0), ("max_retries", 1)),
    )


def test_runs_resume_from_state(spark, tmp_path):
    files = spark.createDataFrame(FILES, "path string, content string")
    done = run(files, settings(tmp_path, 1), describer, documenter)
    assert done.pending.count() == 5
    assert rows(done.verdict, "rows", "accepted") == [(4, True)]
    assert spark.table("run_vectors").where("file_type = 'description'").count() == 4
    new = dict(rows(done.contents, "path", "new_content"))
    assert set(new) == {"top.py", "pkg/a.py", "pkg/sub/deep/b.py"}
    assert new["pkg/sub/deep/b.py"] == '# t\n"""Doc."""\ndef f():\n    return \'```\'\n'
    assert dict(rows(done.reports, "folder", "body")).keys() == {"", "pkg", "pkg/sub"}
    history = spark.read.schema(schemas.HISTORY).parquet(str(tmp_path / "state/history"))
    assert dict(rows(history, "path", "content"))["top.py"] == FILES[0][1]

    again = run(done.files, settings(tmp_path, 2), describer, documenter)
    assert [r[0] for r in rows(again.pending, "path")] == ["pkg/fail.py", "pkg/same.py"]
    assert again.descriptions.count() == 0
    assert again.contents.count() == 0
    assert spark.table("run_vectors").count() == 4
    assert storage.versions(spark, str(tmp_path / "state/manifest")) == [1, 2]
    assert rows(again.manifest) == rows(done.manifest)


def test_only_approved_files_are_written(spark, tmp_path):
    files = spark.createDataFrame(FILES[:2] + [("gone.py", None)], "path string, content string")
    answers = spark.createDataFrame([("top.py", "yes"), ("pkg/a.py", "no")], "path string, answer string")
    chosen = settings(tmp_path, 1)
    done = run(files, RunSettings(**{**chosen.__dict__, "collection": "run_vectors_2"}), describer, documenter, decisions=answers)
    assert rows(done.contents, "path") == [("top.py",)]
    assert rows(done.manifest, "path") == [("top.py",)]
    assert done.files.where("path = 'gone.py' AND content IS NULL").count() == 1


def test_a_run_that_dies_pays_for_no_reply_again(spark, tmp_path, monkeypatch):
    """Killed between the model and what is made of its replies: no second call."""
    from quillframe.plans import document

    calls = spark.sparkContext.accumulator(0)

    def counted(make):
        def factory():
            complete = make()

            def run_batch(batch):
                calls.add(len(batch))
                return complete(batch)
            return run_batch
        return factory

    files = spark.createDataFrame(FILES[:3], "path string, content string")
    chosen = RunSettings(**{**settings(tmp_path, 1).__dict__, "collection": "run_vectors_3"})
    real = document.keep_versions

    def dies(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(document, "keep_versions", dies)
    try:
        run(files, chosen, counted(describer), counted(documenter))
    except RuntimeError as error:
        assert str(error) == "lost"
    paid = calls.value
    assert paid == 6
    monkeypatch.setattr(document, "keep_versions", real)
    done = run(files, chosen, counted(describer), counted(documenter))
    assert done.contents.count() == 3 and calls.value == paid


def test_only_approved_folders_are_written(spark, tmp_path):
    files = spark.createDataFrame(FILES[:3], "path string, content string")
    answers = spark.createDataFrame([("pkg", "yes"), ("pkg/sub", "no")], "folder string, answer string")
    chosen = RunSettings(**{**settings(tmp_path, 1).__dict__, "collection": "run_vectors_4"})
    done = run(files, chosen, describer, documenter, folder_decisions=answers)
    assert rows(done.contents, "path") == [("pkg/a.py",)]
    assert rows(done.manifest, "path") == [("pkg/a.py",)] and rows(done.reports, "folder") == [("pkg",)]


def test_a_repeated_run_keeps_its_descriptions(spark, tmp_path, monkeypatch):
    from quillframe.plans import document

    files = spark.createDataFrame(FILES[:3], "path string, content string")
    chosen = RunSettings(**{**settings(tmp_path, 1).__dict__, "collection": "run_vectors_5"})

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(document, "keep_versions", dies)
        try:
            run(files, chosen, describer, documenter)
        except RuntimeError as error:
            assert str(error) == "lost"
    more = spark.createDataFrame([*FILES[:3], ("new.py", "y = 2\n")], "path string, content string")
    run(more, chosen, describer, documenter)
    kept = spark.read.parquet(str(tmp_path / "state/descriptions"))
    assert rows(kept, "path") == sorted((p,) for p in ("top.py", "pkg/a.py", "pkg/sub/deep/b.py", "new.py"))
