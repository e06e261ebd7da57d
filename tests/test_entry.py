"""The entry point with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry_point

ROOT = os.path.dirname(os.path.abspath(entry_point.__file__))
LISTED = "import __spark_entry__ as e; print(sorted(e.queries())); print(sorted(e.oracle_sql()))"


def test_a_copy_without_the_subpackage_has_all_other_queries(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache"))
    assert not (copy / "quillframe" / "llm").exists()
    out = subprocess.run([sys.executable, "-c", LISTED], cwd=copy, capture_output=True, text=True, check=True).stdout
    queries, sql = map(eval, out.splitlines()[-2:])
    from quillframe.checks.oracles import ORACLES
    from quillframe.checks.queries import QUERIES
    assert queries == sorted(QUERIES) and sql == sorted(ORACLES)


def test_the_subpackage_adds_queries_if_it_is_there():
    optional = os.path.isdir(os.path.join(ROOT, "quillframe", "llm"))
    assert ("pipeline" in entry_point.queries()) == optional
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
