import importlib
import sys

import numpy as np
import public_tokenizers
import pytest
from test_decontaminate import brute as contamination
from test_minhash import brute as components
from tokenizers import Tokenizer as Library

import corpus_pipeline
from quillframe.llm import language, quality
from quillframe.llm.queries import PREDICTED_FROM, language_model, quality_model, table
from quillframe.scratch import written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows in and out of every stage."""
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        made = written(stage(spark, docs, SF), name)
        out.append((name, docs, made))
        docs = made
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(stages):
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns


def test_filters_follow_their_operators(spark, stages):
    _, before, after = stages[0]
    found = language.identify(before, language_model(before)).where("lang_pred <> 'und'")
    assert ids(after) == ids(found)
    _, before, after = stages[1]
    scored = quality.score_quality(before, quality_model(before, table(spark, SF, "labels")))
    assert ids(after) == ids(scored.where(f"quality_score >= {PREDICTED_FROM}"))


def test_dedup_as_by_brute_force(stages):
    _, before, after = stages[2]
    want = components([(r.doc_id, r.text) for r in before.collect()], 5)
    assert ids(after) == sorted(i for i, (_, c) in want.items() if i == c)


def test_decontamination_as_by_brute_force(spark, stages):
    _, before, after = stages[3]
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    assert ids(after) == sorted(r.doc_id for r in before.collect() if not contamination(r.text, items)[-1])


def test_tokens_as_the_library(stages):
    _, before, after = stages[4]
    library = Library.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in before.collect()}
    rows = after.collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert np.frombuffer(r.token_ids, "<u4").tolist() == library.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_run_is_the_stages_in_turn(spark, stages):
    assert ids(corpus_pipeline.run(spark, SF)) == ids(stages[-1][2])


def test_stages_take_odd_rows(spark):
    docs = table(spark, SF, "documents")
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (None, "some words of a text here", "en", None, 3), (90001, "", "en", "s", 0),
         (90002, "the words of a short text", None, "s", 1), (90002, "the words of a short text", None, "s", 1)],
        docs.schema)
    rows = docs.limit(40).unionByName(odd)
    for name, stage in corpus_pipeline.STAGES:
        rows = written(stage(spark, rows, SF), name)
    assert rows.where("doc_id = 90002").count() <= 1
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = written(stage(spark, empty, SF), name)
    assert empty.count() == 0


def test_entry_works_without_this_folder(monkeypatch):
    import __spark_entry__ as entry
    assert "pipeline" in entry.queries() and "op1_warc" in entry.oracle_sql()
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n: None if n in ("quillframe.llm.queries", "quillframe.llm.oracles", "quillframe.llm", "corpus_pipeline") else real(n))
    assert "pipeline" not in entry.queries() and "op1_warc" not in entry.oracle_sql()
    assert sys.modules["corpus_pipeline"]
