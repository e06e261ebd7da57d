import re
from pathlib import PurePosixPath

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quillframe.functions import paths, prompts, text


def column(spark, values, expression):
    """Values of an expression over a one-column table, in input order."""
    df = spark.createDataFrame(list(enumerate(values)), "n int, v string")
    return [r.out for r in df.select("n", expression(F.col("v")).alias("out")).orderBy("n").collect()]


def test_strip_takes_all_outer_white_space(spark):
    values = ["  a b \n", "\t\r\n\f", "x", "", None]
    assert column(spark, values, text.strip) == ["a b", "", "x", "", None]


def test_universal_newlines(spark):
    assert column(spark, ["a\r\nb\rc\n", ""], text.universal_newlines) == ["a\nb\nc\n", ""]


def test_unreadable_content_hashes_to_empty(spark):
    assert column(spark, [None], text.content_hash) == [""]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="` a\n", max_size=12), min_size=1, max_size=40))
def test_fence_escape_round_trip(spark, values):
    plain = [v for v in values if text.ESCAPED_FENCE not in v] or ["x"]
    escaped = column(spark, plain, text.escape_fences)
    assert escaped == [v.replace("```", "` ``") for v in plain]
    back = column(spark, plain, lambda c: text.unescape_fences(text.escape_fences(c)))
    assert back == [v.replace("```", "` ``").replace("` ``", "```") for v in plain]


def test_header_and_newline(spark):
    values = ["code", "# t\ncode\n", "x # t y"]
    assert column(spark, values, lambda c: text.ensure_header(c, "# t")) == [
        "# t\ncode", "# t\ncode\n", "x # t y",
    ]
    assert column(spark, values, text.ensure_trailing_newline) == ["code\n", "# t\ncode\n", "x # t y\n"]


def test_sanitized_names(spark):
    assert column(spark, ["feature/äö b..c", "a-b_c"], text.sanitize_name) == ["feature-_b_c", "a-b_c"]


def test_repository_names(spark):
    urls = [
        "https://github.com/own/name.git", "git@github.com:own/name.git", "https://github.com/own/name",
        "ssh://git@github.com/own/na.me", "https://example.org/own/name", "https://githubXcom/own/name",
    ]
    found = column(spark, urls, text.repository_owner_and_name)
    assert [tuple(f) for f in found] == [
        ("own", "name"), ("own", "name"), ("own", "name"), ("own", "na.me"), (None, None), (None, None),
    ]


def test_token_count(spark):
    pattern = r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]"
    values = ["def f(x):\n  return 'é'", "", " \t", "a\u00a0b \U0001f600\U0001f600 c\x0b", "w ww_1 ...", "\r\n$\\"]
    expected = [len(re.findall(pattern, v)) for v in values]
    assert column(spark, values, text.token_count) == expected
    assert column(spark, values, lambda c: text.token_count(c, pattern)) == expected


def test_small_maps(spark):
    assert column(spark, [" YES\n", "y", "No", "n ", "maybe", "", None], text.decision) == [
        True, True, False, False, None, None, None,
    ]
    assert column(spark, ["\n one\ntwo", ""], text.first_line) == ["one", ""]
    assert column(spark, ["k", "", None], text.secret_state) == ["[HIDDEN]", "NOT SET", "NOT SET"]
    assert column(spark, ["é" * 300], text.preview) == ["é" * 200]


PATHS = ["a/b.py", "a", "a/.hidden", "a/b.tar.gz", "x.", "a.b/c", "..txt", "é/ü.md", "a//b/./c.py", "./q/"]


def test_paths_agree_with_pathlib(spark):
    pure = [PurePosixPath(p) for p in PATHS]
    clean = [str(p) for p in pure]
    assert column(spark, PATHS, paths.normalize) == clean
    assert column(spark, clean, paths.suffix) == [p.suffix for p in pure]
    assert column(spark, clean, lambda c: paths.with_suffix(c, ".txt")) == [str(p.with_suffix(".txt")) for p in pure]
    assert column(spark, clean, paths.depth) == [len(p.parts) for p in pure]
    assert column(spark, clean, paths.parent) == ["" if str(p.parent) == "." else str(p.parent) for p in pure]
    assert column(spark, clean, paths.base_name) == [p.name for p in pure]


def test_relative_paths(spark):
    assert column(spark, ["/r/a/b.py", "/r2/x", "c"], lambda c: paths.relative_to(c, "/r/")) == ["a/b.py", "/r2/x", "c"]


def test_folder_of_and_ancestors(spark):
    files = ["x.py", "a/x.py", "a/b/x.py", "a/b/c/x.py"]
    assert column(spark, files, lambda c: paths.folder_of(c, 2)) == ["", "a", "a/b", "a/b"]
    assert column(spark, files, lambda c: paths.folder_of(c, 0)) == ["", "", "", ""]
    assert column(spark, ["", "a/b"], paths.folders_down_to) == [[""], ["", "a", "a/b"]]


def test_hidden_folders_not_files(spark):
    values = [".git/x", "a/.b/c.py", "a/.dot.py", ".dot.py", "a.b/c.py"]
    assert column(spark, values, paths.is_hidden) == [True, True, False, False, False]


def test_prompts(spark):
    df = spark.createDataFrame([("a ``` b", None, "")], "code string, none string, empty string")
    row = df.select(
        prompts.document_prompt(F.col("code"), F.col("empty")).alias("doc"),
        prompts.describe_prompt(F.col("code"), F.col("none"), F.col("empty")).alias("desc"),
        prompts.context_section(F.col("none"), F.col("code")).alias("section"),
        prompts.context_budget(F.repeat("code", F.lit(20000))).alias("budget"),
        prompts.composite_id(F.col("code"), F.lit("C")).alias("id"),
    ).first()
    assert prompts.NO_CONTEXT in row.doc and row.doc.endswith("python\na ` `` b\n```")
    assert row.desc == prompts.DESCRIBE_PREAMBLE + "File content :```python\na ``` b\n```"
    assert row.section == "More informations\na ``` b\n\n"
    assert row.budget == (64000 - 7 * 20000) // 2
    assert row.id == "a ``` b::C"
