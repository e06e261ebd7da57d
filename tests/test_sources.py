import json
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quillframe import schemas
from quillframe.sources import source_tree, state, storage


def make(root, name, data=b"x = 1\n"):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def test_tree_keeps_underscore_and_dot_files(spark, tmp_path):
    for name in ("pkg/__init__.py", "_priv/x.py", ".dot.py", ".hid/h.py", "pkg/.git/y.py", "a b/ü%20.py", "note.txt"):
        make(tmp_path, name)
    found = source_tree.scan_tree(spark, str(tmp_path))
    assert [r[0] for r in rows(found, "path")] == [".dot.py", "_priv/x.py", "a b/ü%20.py", "pkg/__init__.py"]
    assert found.where("content = 'x = 1\\n' AND size_bytes = 6").count() == 4


def test_unreadable_file_keeps_its_row(spark, tmp_path):
    make(tmp_path, "bad.py", b"\xff\xfe")
    make(tmp_path, "good.py")
    bad = source_tree.scan_tree(spark, str(tmp_path)).where("error IS NOT NULL").collect()
    assert [(r.path, r.content) for r in bad] == [("bad.py", None)]


def listed(spark, root, **options):
    return sorted((r.path, r.size_bytes, r.is_folder) for r in source_tree.list_entries(spark, str(root), **options).collect())


def test_listing_is_split_and_complete(spark, tmp_path):
    names = {f"d{i % 7}/e{i % 3}/f{i}.py" for i in range(200)} | {"top.py"}
    for name in names:
        make(tmp_path, name)
    folders = {f"d{i}" for i in range(7)} | {f"d{i}/e{j}" for i in range(7) for j in range(3)}
    wanted = sorted([(n, 6, False) for n in names] + [(f, None, True) for f in folders], key=repr)
    for options in ({}, {"tasks": 1, "first_share": 1, "most_share": 1}, {"tasks": 5, "first_share": 2}):
        assert sorted(listed(spark, tmp_path, **options), key=repr) == wanted
    assert {r.path for r in source_tree.list_tree(spark, str(tmp_path), 3).collect()} == names


def test_one_wide_level_and_one_deep_chain(spark, tmp_path):
    for i in range(600):
        (tmp_path / f"w{i}").mkdir()
        (tmp_path / f"w{i}" / "f").write_text("")
    deep = "/".join(["c"] * 300)
    make(tmp_path, f"{deep}/end.py")
    found = listed(spark, tmp_path)
    assert len(found) == 2 * 600 + 300 + 1 and (f"{deep}/end.py", 6, False) in found
    # a task opens its share in one go: 8 + 32 + 128 + 512 folders deep in four rounds
    assert listed(spark, tmp_path, tasks=2, first_share=200) == found


def test_a_task_opens_its_share_and_hands_on_the_rest():
    tree = {"": [("a", None), ("b", None), (".h", None), ("f", 1)], "a": [("a/x", None)], "b": [("b/g", 2)], "a/x": [], ".h": [(".h/s", 3)]}
    found = list(source_tree.open_folders(iter([""]), tree.__getitem__, 2, hidden=False))
    assert found == [("", None, True, True), ("f", 1, False, True), ("b", None, True, True), ("b/g", 2, False, True), ("a", None, True, False)]
    every = list(source_tree.open_folders(iter(["", "zz"]), lambda f: tree.get(f, []), 99, hidden=True))
    assert [r[0] for r in every if r[2]] == ["", ".h", "b", "a", "a/x", "zz"] and all(r[3] for r in every)
    assert [r[:1] + r[3:] for r in source_tree.open_folders(iter(["a", "b"]), tree.__getitem__, 1, False)] == [("a", True), ("a/x", False), ("b", False)]


def test_no_names_pass_through_the_driver(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame
    for i in range(30):
        make(tmp_path, f"d{i}/f.py")
    for name in ("collect", "toPandas", "toArrow", "toLocalIterator"):
        monkeypatch.setattr(DataFrame, name, lambda *a, **k: pytest.fail("rows on the driver"))
    listing = source_tree.list_tree(spark, str(tmp_path))
    monkeypatch.undo()
    assert listing.count() == 30


def test_empty_and_missing_tree(spark, tmp_path):
    assert source_tree.scan_tree(spark, str(tmp_path)).count() == 0
    assert source_tree.scan_tree(spark, str(tmp_path / "no")).count() == 0


def test_manifest_json(spark, tmp_path):
    path = tmp_path / "m.json"
    assert state.load_manifest_json(spark, str(path)).count() == 0
    assert state.load_manifest_document(spark, str(path)).count() == 0
    path.write_text(json.dumps({"a.py": "1", "b/c.py": "2"}, indent=2))
    assert rows(state.load_manifest_document(spark, str(path))) == [("a.py", "1"), ("b/c.py", "2")]
    path.write_text('{"a.py": "1"}\n{"b }\\n{ x": "2"}\n')
    both = [("a.py", "1"), ("b }\n{ x", "2")]
    assert rows(state.load_manifest_json(spark, str(path))) == both
    assert rows(state.load_manifest_document(spark, str(path))) == both
    path.write_text('{"a.py": "1", ')
    assert state.load_manifest_json(spark, str(path)).count() == 0
    assert state.load_manifest_document(spark, str(path)).count() == 0


def test_exports_are_read_back(spark, tmp_path):
    manifest = spark.createDataFrame([("a.py", "h1"), ('b "x".py', "h2")], "path string, sha256 string")
    storage.export_manifest_json(manifest, str(tmp_path / "m"))
    assert rows(state.load_manifest_json(spark, str(tmp_path / "m"))) == rows(manifest)
    summaries = spark.createDataFrame([("a", "A\nB"), ("b", "C")], "path string, description string")
    storage.export_summaries_json(summaries, str(tmp_path / "s"))
    assert rows(state.load_summaries_json(spark, str(tmp_path / "s")), "path", "description") == rows(summaries)


def test_summaries_json(spark, tmp_path):
    path = tmp_path / "s.json"
    entries = [{"file": "b", "description": "B"}, {"file": "a", "description": "A"}]
    path.write_text(json.dumps(entries, indent=2))
    assert rows(state.load_summaries_document(spark, str(path))) == [(0, "b", "B"), (1, "a", "A")]
    path.write_text(json.dumps(entries))
    assert rows(state.load_summaries_json(spark, str(path))) == [(0, "b", "B"), (1, "a", "A")]
    path.write_text(json.dumps(entries)[:-9])
    assert state.load_summaries_json(spark, str(path)).count() == 0
    assert state.load_summaries_document(spark, str(path)).count() == 0


def test_rule_lines(spark):
    files = spark.createDataFrame([("d", "#c\n  #kept\n\n   \n *.py \nb/")], "dir string, content string")
    assert rows(state.parse_ignore_rules(files)) == [("d", "#kept"), ("d", "*.py"), ("d", "b/")]


def test_versions_ignore_unfinished_ones(spark, tmp_path):
    root = str(tmp_path / "t")
    assert storage.load_version(spark, root, schemas.MANIFEST).count() == 0
    one = spark.createDataFrame([("a", "1")], schemas.MANIFEST)
    storage.save_version(one, root)
    storage.save_version(storage.load_version(spark, root, schemas.MANIFEST).withColumn("sha256", F.lit("2")), root)
    os.remove(f"{root}/v=2/_SUCCESS")
    assert rows(storage.load_version(spark, root, schemas.MANIFEST)) == [("a", "1")]
    storage.save_version(one.withColumn("sha256", F.lit("3")), root)
    assert storage.versions(spark, root) == [1, 2]
    assert rows(storage.load_version(spark, root, schemas.MANIFEST)) == [("a", "3")]


def test_descriptions_and_history(spark, tmp_path):
    rows_in = spark.createDataFrame([("a/b.py", "text"), ("c", "d")], schemas.SUMMARIES)
    storage.save_descriptions(rows_in, str(tmp_path / "d"), "data/")
    saved = spark.read.parquet(str(tmp_path / "d"))
    assert rows(saved, "path", "out_path") == [("a/b.py", "data/a/b.txt"), ("c", "data/c.txt")]
    prior = spark.createDataFrame([("p", "old")], "path string, content string")
    for second in ("01", "02"):
        for _ in range(2):  # repeated after a failure
            storage.keep_history(
                prior, F.to_timestamp(F.lit(f"2024-01-01 00:00:{second}")), str(tmp_path / "h"), int(second))
    kept = spark.read.schema(schemas.HISTORY).parquet(str(tmp_path / "h"))
    assert rows(kept, "path", "content", "stamp") == [("p", "old", "20240101000001"), ("p", "old", "20240101000002")]


def test_collection_survives_the_catalog(spark, tmp_path):
    where = str(tmp_path / "c")
    empty = storage.get_or_create_collection(spark, "kept_vectors", where)
    assert empty.count() == 0
    row = spark.createDataFrame([("i", "d", {"file_type": "x"}, [1.0], 1, "x")], schemas.VECTORS)
    storage.append_to_collection(row, "kept_vectors")
    spark.sql("DROP TABLE kept_vectors")
    assert rows(storage.get_or_create_collection(spark, "kept_vectors", where), "id", "file_type") == [("i", "x")]
