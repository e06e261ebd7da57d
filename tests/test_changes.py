from hashlib import sha256

from conftest import rows
from pyspark.sql import functions as F

from quillframe.operators import changes, ordering, vectors
from quillframe.plans import document


def digest(content):
    return sha256(content.encode()).hexdigest()


def test_match_differ_absent(spark):
    files = spark.createDataFrame([(f"f{i}.py", f"x = {i}") for i in range(10)], "path string, content string")
    known = [(f"f{i}.py", digest(f"x = {i}") if i < 2 else "old") for i in range(9)]
    manifest = spark.createDataFrame(known, "path string, sha256 string")
    current = changes.fingerprints(files)
    assert changes.changed(current, manifest).count() == 8
    assert changes.run_counters(current, manifest).first().asDict() == {
        "found": 10, "changed": 8, "unchanged": 2, "failed": 0,
    }
    merged = changes.merge_manifest(manifest, current)
    assert changes.changed(current, merged).count() == 0


def test_empty_manifest_and_unreadable_file(spark):
    files = spark.createDataFrame([("a", "x"), ("b", None)], "path string, content string")
    empty = spark.createDataFrame([], "path string, sha256 string")
    current = changes.fingerprints(files)
    assert rows(changes.changed(current, empty), "path", "sha256") == [("a", digest("x")), ("b", "")]
    assert changes.run_counters(current, empty).first().failed == 1


def test_merge_keeps_other_paths(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha256 string")
    new = spark.createDataFrame([("b", "3"), ("c", "4")], "path string, sha256 string")
    assert rows(changes.merge_manifest(old, new)) == [("a", "1"), ("b", "3"), ("c", "4")]


def test_positions_with_one_hot_key(spark):
    """A third of all rows under one key, and many equal sort values."""
    data = [("hot" if i % 3 == 0 else f"k{i % 50}", i % 10, i) for i in range(6000)] + [(None, 0, 1), (None, 0, 0)]
    df = spark.createDataFrame(data, "k string, v int, n int").repartition(7)
    placed = ordering.with_position(df, [F.col("v"), F.col("n")], ["k"])
    expected, seen = [], {}
    for k, v, n in sorted(data, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        seen[k] = seen.get(k, 0) + 1
        expected.append((k, v, n, seen[k]))
    assert rows(placed) == sorted(expected, key=repr)


def test_global_positions(spark):
    df = spark.range(5000).select((F.col("id") % 13).alias("s"), "id").repartition(9)
    placed = ordering.with_position(df, [F.col("s").desc(), F.col("id")])
    wanted = sorted(((i % 13, i) for i in range(5000)), key=lambda r: (-r[0], r[1]))
    assert [(r.s, r.id) for r in placed.orderBy("position").collect()] == wanted
    assert placed.agg(F.min("position"), F.max("position")).first() == (1, 5000)
    assert ordering.with_position(df.where("id < 0"), [F.col("id")]).count() == 0


def test_first_and_last_definitions(spark):
    df = spark.createDataFrame(
        [("a", 2, "late", None), ("a", 1, "early", "x"), ("b", 5, "only", None)], "k string, o int, v string, w string"
    )
    assert rows(ordering.first_per_key(df, ["k"], "o"), "k", "v", "o") == [("a", "early", 1), ("b", "only", 5)]
    assert rows(ordering.last_definition_wins(df, ["k"], "o"), "k", "o", "v", "w") == [
        ("a", 1, "late", None), ("b", 5, "only", None),
    ]


def test_batch_verdicts_first_failing_check(spark):
    meta = {"a": "b"}
    data = [
        ("ok", "1", "d", meta), ("ok", "2", "d", meta),
        ("missing", "1", None, meta), ("missing", "1", "", meta),
        ("empty", "1", "", meta), ("empty", "1", "d", meta),
        ("twice", "1", "d", meta), ("twice", "1", "e", meta),
        ("no meta", "1", "d", None),
    ]
    df = spark.createDataFrame(data, "batch string, id string, document string, metadata map<string,string>")
    assert rows(vectors.batch_verdicts(df), "batch", "accepted", "reason") == [
        ("empty", False, "empty document"), ("missing", False, "length mismatch"),
        ("no meta", False, "length mismatch"), ("ok", True, "ok"), ("twice", False, "duplicate id"),
    ]


def test_merge_metadata_right_wins(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": "4"}), ({}, {"x": "y"})], "l map<string,string>, r map<string,string>")
    merged = df.select(vectors.merge_metadata(F.col("l"), F.col("r")).alias("m"))
    assert [r.m for r in merged.collect()] == [{"a": "1", "b": "3", "c": "4"}, {"x": "y"}]


def test_insert_keeps_stored_rows(spark):
    stored = spark.createDataFrame([("1", "old")], "id string, document string")
    new = spark.createDataFrame([("1", "new"), ("2", "new")], "id string, document string")
    assert rows(vectors.absent_only(new, stored)) == [("2", "new")]


def test_empty_outputs_are_rejected(spark):
    df = spark.createDataFrame([(1, ""), (2, "x"), (3, None)], "k int, new_content string")
    assert rows(changes.accepted(df), "k") == [(2,)]


def test_a_path_that_occurs_again_has_its_newest_hash(spark):
    old = spark.createDataFrame([("a", "v0"), (None, "n"), ("z", "1"), ("z", "2")], "path string, sha256 string")
    new = spark.createDataFrame([("a", "v2", 2), ("a", "v1", 1), ("a", "v1", 1)], "path string, sha256 string, at int")
    assert rows(changes.merge_manifest(old, new, order="at")) == [("a", "v2"), ("z", "2"), (None, "n")]
    assert rows(changes.merge_manifest(old, new)) == [("a", "v2"), ("z", "2"), (None, "n")]
    assert rows(changes.latest(new, "at")) == [("a", "v2", 2)]


def test_contents_are_never_broadcast(spark, monkeypatch):
    """Contents derived from next to nothing look small to the planner and can be any size."""
    files = spark.range(10).select(F.concat(F.lit("f"), "id").alias("path"), F.repeat(F.lit("x\r\n"), 1000).alias("content"))
    selected = files.select("path").where("path < 'f5'").unionByName(spark.createDataFrame([("f1",), ("gone",)], "path string"))
    few = changes.attach_content(selected, files)
    monkeypatch.setattr(changes, "FEW_ROWS", 2)
    many = changes.attach_content(selected, files)
    updated = document.updated_files(files, files.select("path", F.lit("y").alias("new_content")))
    for found, broadcasts in ((few, 1), (many, 0), (updated, 0)):
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("BroadcastHashJoin") == broadcasts and "BuildRight" not in plan
    assert rows(few, "path", "content") == rows(many, "path", "content") and many.count() == 6
    assert "BuildLeft" in few._jdf.queryExecution().sparkPlan().toString()
