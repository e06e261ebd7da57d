import random
from pathlib import PurePosixPath

from conftest import rows
from pyspark.sql import functions as F

from quillframe.operators import folders, ignore

NAMES = ["x.py", "build", "b.py", "ab.py", "[x]", "a-b", "a^b", "]q", "x.PY", "build.d", "x\\y", "a.b", "é.py"]
PATTERNS = [
    "*.py", "build", "build/", "b*", "?.py", "[ab]*.py", "[!a]*", "[a-c]?.py", "[]x]q", "[x", "!b.py", "*",
    "src/*.py", "src/build", "*/x.py", "/x.py", "a/src/x.py", "x.p[xy]", "[z-a]*", "[!z-a].py", "a[-^]b", "**/x.py", "a.b",
    "[[]x]", "x\\\\y", "lib/src/x.py",
]


def test_globs_agree_with_pathlib(spark):
    entries = [f"{folder}{name}" for folder in ("", "src/", "a/src/") for name in NAMES]
    frame = spark.createDataFrame([(p,) for p in PATTERNS], "pattern string").withColumn("dir", F.lit(""))
    compiled = frame.withColumn("entry", F.explode(F.array(*[F.lit(e) for e in entries])))
    hits = compiled.where(F.rlike("entry", ignore.glob_regex(F.col("pattern")))).where("pattern NOT LIKE '/%'")
    expected = {
        (p, e) for p in PATTERNS for e in entries if not p.startswith("/") and PurePosixPath(e).match(p)
    }
    assert {(r.pattern, r.entry) for r in hits.collect()} == expected


def brute_force_kept(files, rules):
    def dropped(path):
        parts = path.split("/")
        for end in range(1, len(parts) + 1):
            where = "/".join(parts[:end - 1])
            entry = PurePosixPath("/".join(parts[:end]))
            if any(d == where and p and not p.startswith("/") and entry.match(p) for d, p in rules):
                return True
        return False

    return sorted(p for p in files if not dropped(p))


def test_rules_hold_in_their_own_folder_only(spark):
    files = [f"{d}{n}" for d in ("", "src/", "src/gen/", "src/gen/deep/", "docs/", "docs/src/") for n in ("a.py", "b.txt", "gen")]
    rules = [("", "b.txt"), ("src", "gen/"), ("docs", "*.py"), ("docs/src", "src/a.py"), ("", "/docs"), ("", "")]
    df = spark.createDataFrame([(f, 1) for f in files], "path string, n int")
    frame = spark.createDataFrame(rules, "dir string, pattern string")
    kept = ignore.without_ignored(df, frame)
    assert kept.columns == ["path", "n"]
    assert [r[0] for r in rows(kept, "path")] == brute_force_kept(files, rules)
    assert ignore.without_ignored(df, frame.where("false")).count() == len(files)


def test_rules_of_every_kind(spark):
    names = ["a.py", "a.tar.gz", "b.gz", ".gz", "gz", "x", "[x]", "a*", "é.py", "a.py.bak", "y.", "a\nb.py"]
    folders = ["", "d/", "d/e/", "q/d/e/", "x/", "d/x/"]
    files = [f + n for f in folders for n in names]
    patterns = ["a.py", "*.gz", "*.tar.gz", "*.py", "a*", "?", "[[]x]", "e/*.gz", "d/e/x", "d/e", "e/a.py", "*/x", "x/", "*.", "y.", "*.p?", ".*", "*", "b.g", "gz/"]
    choose = random.Random(1)
    for _ in range(3):
        rules = [(choose.choice(["", "d", "./d//e", "q/d/e", "x", "zz"]), p) for p in choose.sample(patterns, 9)]
        kept = ignore.without_ignored(spark.createDataFrame([(f,) for f in files], "path string"), spark.createDataFrame(rules, "dir string, pattern string"))
        plain = [(str(PurePosixPath(d)) if d else "", p) for d, p in rules]
        assert [r[0] for r in rows(kept, "path")] == sorted(brute_force_kept(files, plain), key=lambda p: repr((p,)))


def test_names_and_endings_meet_no_regular_expression(spark):
    files = spark.createDataFrame([("d/a.py",)], "path string")
    rules = spark.createDataFrame([("d", "a.py"), ("d", "*.gz"), ("d", "?")], "dir string, pattern string")
    kinds = {r.pattern: r._kind for r in ignore.compiled_rules(rules).join(rules.select("pattern"), F.col("_regex") == ignore.glob_regex(F.col("pattern"))).collect()}
    assert kinds == {"a.py": "name", "*.gz": "suffix", "?": "rest"}
    plan = ignore.without_ignored(files, rules)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join LeftAnti" in line]
    assert len(joins) == 3 and "RLIKE" not in plan.split("Join LeftAnti")[1]
    with_pattern = [line for line in joins if "regexp_instr" in line]
    assert len(with_pattern) == 1 and all("=" in line for line in joins)  # the one row of a folder


def test_ignored_subtrees_are_whole_components(spark):
    df = spark.createDataFrame([("a/b/x",), ("a/bc/x",), ("a/b",), ("q",)], "path string")
    listed = spark.createDataFrame([("./a//b/",), ("zz",)], "folder string")
    assert [r[0] for r in rows(ignore.without_subtrees(df, listed))] == ["a/b", "a/bc/x", "q"]
    everything = spark.createDataFrame([(".",)], "folder string")
    assert ignore.without_subtrees(df, everything).count() == 0


def test_suffix_filters(spark):
    df = spark.createDataFrame([("a.cached",), (".cached",), ("x/.cached",), ("b.py",)], "path string")
    assert [r[0] for r in rows(ignore.without_suffixes(df, [".cached"]))] == [".cached", "b.py", "x/.cached"]
    assert [r[0] for r in rows(ignore.with_suffix_in_scope(df))] == ["b.py"]


FILES = [("r.py", 1), ("a/x.py", 2), ("a/y.py", 3), ("a/b/z.py", 4), ("a/b/c/w.py", 5), ("d/e/v.py", 6)]


def file_frame(spark):
    return spark.createDataFrame(FILES, "path string, size_bytes bigint")


def test_folder_levels_in_parts(spark):
    every = folders.folders_of(file_frame(spark))
    assert rows(every) == [("", 0), ("a", 1), ("a/b", 2), ("a/b/c", 3), ("d", 1), ("d/e", 2)]
    shallow = folders.within_depth(every, 2)
    assert rows(folders.folder_levels(shallow)) == [(0, 0, [""]), (1, 0, ["a", "d"]), (2, 0, ["a/b", "d/e"])]
    assert rows(folders.folder_levels(shallow, per_part=1)) == [
        (0, 0, [""]), (1, 0, ["a"]), (1, 1, ["d"]), (2, 0, ["a/b"]), (2, 1, ["d/e"]),
    ]
    first = folders.deepest_first(every).where("position = 1").first()
    assert first.folder == "a/b/c"


def test_assignment(spark):
    by_depth = folders.assign_by_depth(file_frame(spark), 2)
    assert dict(rows(by_depth, "path", "folder")) == {
        "r.py": "", "a/x.py": "a", "a/y.py": "a", "a/b/z.py": "a/b", "a/b/c/w.py": "a/b", "d/e/v.py": "d/e",
    }
    single = folders.assign_by_depth(file_frame(spark), 2, per_file=True)
    assert single.where("folder <> path").count() == 0
    listed = spark.createDataFrame([("a",), ("a/b/c",), ("nope",)], "folder string")
    assigned = folders.assign_to_listed(file_frame(spark), listed)
    assert dict(rows(assigned, "path", "folder")) == {
        "r.py": "", "a/x.py": "a", "a/y.py": "a", "a/b/z.py": "a", "a/b/c/w.py": "a/b/c", "d/e/v.py": "",
    }


def test_directory_totals(spark):
    totals = {r.folder: r for r in folders.directory_totals(file_frame(spark)).collect()}
    assert set(totals) == {"", "a", "a/b", "a/b/c", "d", "d/e"}
    for folder, row in totals.items():
        inside = [(p, s) for p, s in FILES if folder == "" or p.startswith(folder + "/")]
        names = {p[len(folder) + 1 if folder else 0:].split("/")[0] for p, _ in inside}
        own = [p for p, _ in inside if str(PurePosixPath(p).parent).replace(".", "") == folder]
        assert (row.subtree_files, row.subtree_bytes) == (len(inside), sum(s for _, s in inside))
        assert (row.children, row.own_files) == (len(names), len(own))


def test_tree_lines(spark):
    lines = [r.line for r in folders.tree_lines(file_frame(spark)).where("path LIKE 'a%'").orderBy("path").collect()]
    assert lines == ["  a/", "    b/", "      c/", "        w.py", "      z.py", "    x.py", "    y.py"]
