"""What the plans must not lose: pruning, pushdown, one model call, no pairs."""

import re

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from quillframe.checks import fixtures as fx
from quillframe.checks.queries import QUERIES
from quillframe.operators import embedding, revisions


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


LAZY = [
    "flt3_ignore_rule_filter", "flt4_ignore_subtree_filter", "jon1_changed_files", "jon2_skip_described",
    "jon3_description_lookup", "jon4_listed_folder_assignment", "jon5_insert_if_absent", "jon6_vector_top_k",
    "jon7_approval_gate", "jon8_class_docstring_lookup", "set1_manifest_merge", "set4_line_diff", "agg7_directory_rollup",
]


@pytest.mark.parametrize("name", LAZY)
def test_no_pairs_without_a_key(spark, no_broadcast, name):
    assert not re.search("NestedLoop|Cartesian", plan(QUERIES[name](spark, SF_DIR)))


def test_change_detection_shuffles_no_contents(spark, no_broadcast):
    text = plan(QUERIES["jon1_changed_files"](spark, SF_DIR))
    probe = text.split("SortMergeJoin", 1)[1].split("Exchange", 2)[1]
    assert "sha2(" in probe and "content#" not in probe.split("Project", 1)[0]


def test_path_filter_reads_no_contents(spark):
    scans = re.findall(r"ReadSchema: (\S+)", plan(QUERIES["flt2_hidden_folder_filter"](spark, SF_DIR)))
    assert scans == ["struct<page_id:bigint,url:string>"]


def test_line_diff_of_joined_versions_needs_no_further_shuffle(spark, no_broadcast):
    docs = fx.table(spark, SF_DIR, "documents")
    old = docs.select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    text = plan(revisions.line_changes(revisions.paired(old, old), "path"))
    assert text.count("Exchange hashpartitioning") == 1


def test_model_runs_once_under_an_explode(spark):
    docs = fx.table(spark, SF_DIR, "documents")
    slots = embedding.with_embedding(docs, "text").select("doc_id", F.explode("embedding").alias("w")).where("w > 0")
    assert plan(slots).count("ArrowEvalPython") == 1


def test_top_k_is_limited_before_the_shuffle(spark):
    text = plan(QUERIES["jon6_vector_top_k"](spark, SF_DIR))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text
