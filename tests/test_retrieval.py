import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from quillframe.operators import code, embedding, packing, search
from quillframe.plans import retrieval


def frames(spark, queries, vectors):
    q = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(queries)], "query_id bigint, embedding array<float>")
    v = spark.createDataFrame([(f"v{i:05d}", [float(x) for x in v]) for i, v in enumerate(vectors)], "id string, embedding array<float>")
    return q, v.repartition(5)


def brute(queries, vectors, k, metric):
    queries, vectors = (np.asarray(m, dtype=np.float32).astype(float) for m in (queries, vectors))
    out = []
    for i, q in enumerate(queries):
        if metric == "l2":
            d = ((vectors - q) ** 2).sum(axis=1)
        else:
            norms = np.linalg.norm(vectors, axis=1) * np.linalg.norm(q)
            d = 1 - vectors @ q / np.where(norms == 0, 1, norms)
        order = sorted(range(len(vectors)), key=lambda j: (round(d[j], 9), j))[:k]
        out += [(i, r + 1, f"v{j:05d}") for r, j in enumerate(order)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("shared", [True, False])
def test_nearest_is_exact(spark, metric, shared):
    rng = np.random.default_rng(1)
    queries, vectors = rng.normal(size=(30, 8)), rng.normal(size=(700, 8))
    vectors[:233] = vectors[0]  # a third are copies of one vector
    vectors[300], queries[3], queries[4] = 0, 0, vectors[0]
    q, v = frames(spark, queries, vectors)
    size = {} if shared else {"max_shared_bytes": 0, "block_bytes": 11 * 8 * 4}
    found = search.nearest(q, v, k=7, metric=metric, **size)
    assert rows(found, "query_id", "rank", "id") == brute(queries, vectors, 7, metric)


def test_fewer_vectors_than_k_and_missing_embeddings(spark):
    q, v = frames(spark, [[1, 0]], [[1, 0], [0, 1]])
    v = v.unionByName(spark.createDataFrame([("none", None)], "id string, embedding array<float>"))
    assert rows(search.nearest(q, v), "rank", "id") == [(1, "v00000"), (2, "v00001")]
    assert search.nearest(q, v.where("false")).count() == 0
    assert search.nearest(q.where("false"), v).count() == 0
    assert search.nearest(q, v.where("false"), max_shared_bytes=0).count() == 0
    with pytest.raises(ValueError):
        search.nearest(q, v, metric="dot")


def loop_pack(tokens, budget):
    kept, total = [], 0
    for at, n in enumerate(tokens):
        if total + n > budget:
            break
        total += n
        kept.append(at + 1)
    return kept


def test_packing_equals_the_loop(spark):
    rng = np.random.default_rng(2)
    groups = {g: [int(n) for n in rng.integers(0, 9, size=rng.integers(1, 40))] for g in range(12)}
    budgets = {g: int(b) for g, b in zip(groups, [0, -5, 1000, 3, 10, 20, 30, 40, 50, 60, 70, 80])}
    groups[0][0] = 0
    groups[3] = [4, 1, 1]  # the first does not fit: nothing is kept, no skipping ahead
    data = [(g, at + 1, n, budgets[g]) for g, tokens in groups.items() for at, n in enumerate(tokens)]
    df = spark.createDataFrame(data, "g int, rank int, tokens int, budget int").repartition(5)
    wanted = sorted(((g, r) for g in groups for r in loop_pack(groups[g], budgets[g])), key=repr)
    assert rows(packing.pack_ranked(df, ["g"], F.col("budget")), "g", "rank") == wanted
    for block in (1, 4, 1000):
        packed = packing.pack_ranked_any_size(df, ["g"], F.col("budget"), block_rows=block)
        assert rows(packed, "g", "rank") == wanted


def test_context_of_no_hits_is_empty(spark):
    q, v = frames(spark, [[1, 0], [0, 1]], [[1, 0], [0, 1]])
    v = v.withColumn("document", F.concat(F.lit("doc "), "id"))
    q = q.withColumn("budget", F.when(F.col("query_id") == 0, 2).otherwise(-1).cast("bigint"))
    found = dict(rows(retrieval.retrieved_context(q, v)))
    assert found == {0: "doc v00000\n\n", 1: ""}
    assert set(dict(rows(retrieval.retrieved_context(q, v.where("false")))).values()) == {""}


def test_embedding_is_unit_length_and_case_blind(spark):
    df = spark.createDataFrame([(1, "Alpha beta"), (2, "alpha BETA"), (3, ""), (4, None)], "n int, document string")
    found = {r.n: r.embedding for r in embedding.with_embedding(df).collect()}
    assert found[1] == found[2] and abs(sum(x * x for x in found[1]) - 1) < 1e-6
    assert set(found[3]) == set(found[4]) == {0.0}


def test_custom_embedding_model(spark):
    def lengths():
        return lambda texts: np.array([[len(t), 1] for t in texts], dtype=np.float32)

    df = spark.createDataFrame([("abc",)], "document string")
    assert embedding.with_embedding(df, make_predict=lengths).first().embedding == [3.0, 1.0]


def test_import_contexts_pack_per_file(spark):
    """Same imports, different budgets: each file takes the prefix that fits."""
    short = "from p import A, B\n"
    files = spark.createDataFrame(
        [("a.py", short), ("b.py", short + "#" * 63980), ("c.py", "import os\n"), ("d.py", "def (")], "path string, content string"
    )
    vectors = embedding.with_embedding(spark.createDataFrame([("1", "A B"), ("2", "zz yy")], "id string, document string"))
    parsed = code.parse_modules(files)
    found = {r.path: (r["query"], r.context) for r in retrieval.import_contexts(parsed, files, vectors, "p").collect()}
    assert found["a.py"] == ("A B", "A B\n\nzz yy\n\n")
    assert found["b.py"] == ("A B", "")
    assert found["c.py"][0] == found["d.py"][0] == "" and found["c.py"][1] == "A B\n\nzz yy\n\n"


def test_null_keys_are_packed_like_others(spark):
    df = spark.createDataFrame(
        [(None, 1, 5), (None, 2, 5), (None, 3, 5), ("a", 1, 5), ("a", 2, 90)], "k string, rank int, tokens int")
    kept = [("a", 1), (None, 1), (None, 2)]
    assert rows(packing.pack_ranked(df, ["k"], F.lit(10)), "k", "rank") == sorted(kept, key=repr)
    for block_rows in (1, 2, 100):
        packed = packing.pack_ranked_any_size(df, ["k"], F.lit(10), block_rows=block_rows)
        assert packed.columns == [*df.columns, "running_tokens"]
        assert rows(packed, "k", "rank") == sorted(kept, key=repr)


def test_embeddings_without_a_distance_come_last(spark):
    nan = float("nan")
    vectors = spark.createDataFrame(
        [(1, [nan, 0.0]), (2, [1.0, 0.0]), (3, []), (4, [0.0, 1.0, 2.0]), (5, [9.0, 9.0]), (6, None), (7, [None, 1.0])],
        "id int, embedding array<float>")
    queries = spark.createDataFrame(
        [("q", [1.0, 0.0]), ("r", [9.0, 8.0]), ("odd", [1.0]), ("nan", [nan, 1.0]), ("none", None)], "query_id string, embedding array<float>")
    for options in ({}, {"max_shared_bytes": 0, "block_bytes": 8}):
        got = {}
        for r in search.nearest(queries, vectors, 4, **options).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.id, str(r.distance)))
        assert got == {
            "q": [(2, "0.0"), (5, "145.0"), (1, "nan"), (3, "nan")], "r": [(5, "1.0"), (2, "128.0"), (1, "nan"), (3, "nan")],
            "odd": [(i, "nan") for i in (1, 2, 3, 4)], "nan": [(i, "nan") for i in (1, 2, 3, 4)]}
