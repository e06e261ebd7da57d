"""Embeddings kept by content hash, class vectors, vocabulary counts, pruned hit lists."""

import public_tokenizers
import pytest
from conftest import rows
from pyspark.sql import functions as F

from quillframe import scratch
from quillframe.functions.text import token_counter
from quillframe.operators import embedding, packing
from quillframe.plans import describe, retrieval
from quillframe.sources import storage

TEXTS = [(1, "a b", "clash"), (2, "c", "clash"), (3, "a b", "clash"), (4, None, "clash"), (5, "", "clash"), (None, "c", "clash")]
SCHEMA = "n int, document string, digest string"


def refusing():
    def make_predict():  # nested, so that it travels by value
        def predict(texts):
            raise AssertionError(f"asked for {list(texts)}")

        return predict

    return make_predict


def test_a_second_run_embeds_nothing(spark, tmp_path):
    root = str(tmp_path / "embeddings")
    df = spark.createDataFrame(TEXTS, SCHEMA)
    first = embedding.with_stored_embedding(df, root)
    assert rows(first, "n", "document", "digest", "embedding") == rows(embedding.with_embedding(df), "n", "document", "digest", "embedding")
    assert storage.load_log(spark, root, embedding.STORED, "digest", "embedding").count() == 3
    again = embedding.with_stored_embedding(df, root, make_predict=refusing())
    assert rows(again) == rows(first) and storage.versions(spark, root) == [1]
    more = df.unionByName(spark.createDataFrame([(9, "new text", "")], SCHEMA))
    assert rows(embedding.with_stored_embedding(more, root), "n", "embedding") == rows(embedding.with_embedding(more), "n", "embedding")
    assert spark.read.parquet(f"{root}/v=2").count() == 1
    assert embedding.with_stored_embedding(df.limit(0), root, make_predict=refusing()).count() == 0


def test_a_failed_model_leaves_no_version(spark, tmp_path):
    root = str(tmp_path / "embeddings")
    with pytest.raises(Exception, match="asked for"):
        embedding.with_stored_embedding(spark.createDataFrame(TEXTS, SCHEMA), root, make_predict=refusing())
    assert storage.versions(spark, root) == []


def test_class_rows(spark):
    classes = spark.createDataFrame(
        [("a.py", "A", "one"), ("a.py", "A", "another"), ("a.py", "B", None), ("b.py", "A", ""), ("b.py", "C", "c")],
        "path string, class_name string, summary string")
    found = describe.class_vector_rows(classes, {"file_type": "class"})
    assert sorted((r.id, r.document, sorted(r.metadata.items())) for r in found.collect()) == [
        ("a.py::A", "another", [("class_name", "A"), ("file_path", "a.py"), ("file_type", "class")]),
        ("b.py::C", "c", [("class_name", "C"), ("file_path", "b.py"), ("file_type", "class")])]
    assert describe.class_vector_rows(classes.limit(0)).count() == 0


PATH = public_tokenizers.path("word_bpe_49k.json")


def vocabulary(path):
    def make_count():
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)

    return make_count


def test_counts_of_a_vocabulary_pack_into_a_budget(spark):
    count = vocabulary(PATH)()
    texts = ["hello world", "", None, "hello world", "Unbelievable tokenisation, isn't it?", "é" * 40]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "rank int, text string").coalesce(1)
    counted = df.withColumn("tokens", token_counter(vocabulary(PATH))("text"))
    assert rows(counted, "rank", "tokens") == [(i, None if t is None else count(t)) for i, t in enumerate(texts)]
    fits = count("hello world") * 2 + count(texts[4])
    ranked = counted.where("text is not null").withColumn("key", F.lit(1))
    kept = packing.pack_ranked(ranked, ["key"], F.lit(fits))
    assert rows(kept, "rank") == [(0,), (1,), (3,), (4,)]


def test_hits_beyond_every_budget_get_no_document(spark):
    ranked = spark.createDataFrame(
        [("q", r, f"d{r}", 10) for r in (1, 2, 3)] + [("p", 1, "d1", 10)], "query_id string, rank int, id string, tokens long")
    vectors = spark.createDataFrame([(f"d{r}", f"text {r}") for r in (1, 2, 3)], "id string, document string")
    budgets = spark.createDataFrame([("q", 5), ("q", 25), ("p", 9), ("none", 99)], "query_id string, budget int")
    found = {r.query_id: [h.document for h in r.hits] for r in retrieval.hit_lists(ranked, vectors, budgets).collect()}
    assert found == {"q": ["text 1", "text 2"]}
    whole = {r.query_id: len(r.hits) for r in retrieval.hit_lists(ranked, vectors).collect()}
    assert whole == {"q": 3, "p": 1}


@pytest.mark.parametrize("warehouse,master,fine", [
    ("file:/tmp/w", "local[4]", True), ("/tmp/w", "local", True), ("file:/tmp/w", "spark://host:1", False),
    ("/tmp/w", "yarn", False), ("hdfs://n/w/", "yarn", True)])
def test_scratch_of_a_cluster_is_shared(warehouse, master, fine):
    if fine:
        assert scratch.shared_warehouse(warehouse, master) == warehouse.rstrip("/") + "/_scratch"
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch.shared_warehouse(warehouse, master)
