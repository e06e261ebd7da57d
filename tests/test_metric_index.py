"""The stored index against the search without one."""

import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows

from quillframe.operators import metric_index as mi, search

ROWS = "query_id", "rank", "id", "distance"


def vector_rows(spark, matrix, extra=()):
    data = [(i, [float(x) for x in v]) for i, v in enumerate(matrix)] + list(extra)
    return spark.createDataFrame(data, "id bigint, embedding array<float>").repartition(3)


def query_rows(spark, matrix, extra=()):
    data = [(f"q{i:04d}", [float(x) for x in v]) for i, v in enumerate(matrix)] + list(extra)
    return spark.createDataFrame(data, "query_id string, embedding array<float>")


def clustered(seed, clusters=40, each=100, width=8):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(clusters, width)) * 10
    return np.repeat(centers, each, axis=0) + rng.normal(size=(clusters * each, width)) * 0.1, centers


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_same_hits_as_without(spark, tmp_path, metric):
    matrix, centers = clustered(1, 8, 40)
    matrix[:100] = matrix[0]  # a third are copies of one vector
    matrix[100:103] = 0
    matrix[110] = 2 * matrix[111]
    odd = [(900, [float("nan")] * 8), (901, []), (902, [1.0, 2.0]), (903, None), (904, [3.0, None])]
    vectors = vector_rows(spark, matrix, odd)
    queries = query_rows(spark, np.vstack([centers, matrix[:3], np.zeros((1, 8)), -100 * centers[:2]]),
                         [("wide", [1.0, 1.0]), ("odd", [float("inf")] * 8), ("none", None), ("empty", [])])
    index = mi.write_index(vectors, str(tmp_path / "index"), metric, pivots=12)
    wanted = repr(rows(search.nearest(queries, vectors, 6, metric), *ROWS))
    assert repr(rows(mi.nearest_indexed(queries, index, 6), *ROWS)) == wanted
    assert repr(rows(mi.nearest_indexed(queries, index, 6, max_shared_bytes=0, block_bytes=30 * 8 * 4), *ROWS)) == wanted
    again = mi.read_index(spark, str(tmp_path / "index"))
    assert repr(rows(mi.nearest_indexed(queries, again, 6), *ROWS)) == wanted


def test_few_or_no_vectors_and_no_queries(spark, tmp_path):
    matrix, _ = clustered(2, 2, 2)
    queries = query_rows(spark, matrix[:2])
    for name, vectors in {"few": vector_rows(spark, matrix, [(90, [1.0])]), "none": vector_rows(spark, matrix).where("false"),
                          "odd": vector_rows(spark, [], [(1, []), (2, None)]), "zero": vector_rows(spark, np.zeros((3, 8)))}.items():
        for metric, size in (("l2", {}), ("cosine", {"max_shared_bytes": 0})):
            index = mi.write_index(vectors, str(tmp_path / name / metric), metric)
            assert repr(rows(mi.nearest_indexed(queries, index, 7, **size), *ROWS)) == repr(rows(search.nearest(queries, vectors, 7, metric), *ROWS))
            assert mi.nearest_indexed(queries.where("false"), index, 7, **size).count() == 0
    with pytest.raises(ValueError):
        mi.write_index(queries.withColumnRenamed("query_id", "id"), str(tmp_path / "x"), "dot")


def test_far_from_the_origin_rounding_loses_nothing(spark, tmp_path):
    rng = np.random.default_rng(3)
    matrix = (rng.normal(size=(300, 4)) + 5e5).astype(np.float32)
    index = mi.write_index(vector_rows(spark, matrix), str(tmp_path / "i"))
    queries = query_rows(spark, matrix[:40])
    assert rows(mi.nearest_indexed(queries, index), *ROWS) == rows(search.nearest(queries, vector_rows(spark, matrix)), *ROWS)


def scored_pairs(index, queries):
    """Pairs that one task scores when all vectors pass it in the order of their cells."""
    table = index.vectors.orderBy("cell", "id").toArrow().combine_chunks()
    own = queries.toArrow()
    scorer = mi.CellScorer(search.one_array(own["query_id"]), search.one_array(own["embedding"]), 5, index.cells)
    for batch in table.to_batches(max_chunksize=500):
        scorer.add(batch.column("id"), batch.column("embedding"), batch.column("cell").to_numpy(), batch.column("to_pivot").to_numpy())
    return scorer.best.scored


def test_clusters_save_most_pairs_and_rows_and_noise_saves_little(spark, tmp_path):
    matrix, centers = clustered(4)
    rng = np.random.default_rng(5)
    queries = query_rows(spark, centers[rng.integers(0, 40, 200)] + rng.normal(size=(200, 8)) * 0.1)
    index = mi.write_index(vector_rows(spark, matrix), str(tmp_path / "clustered"))
    every = 200 * len(matrix)
    assert scored_pairs(index, queries) < 0.1 * every
    assert mi.visits(queries, index, 5).count() < 0.1 * 200 * len(index.cells.pivots)
    noise = rng.normal(size=(2000, 64))
    index = mi.write_index(vector_rows(spark, noise), str(tmp_path / "noise"))
    pairs = scored_pairs(index, query_rows(spark, rng.normal(size=(100, 64))))
    assert 0.5 * 100 * 2000 < pairs <= 100 * 2000  # without clusters nothing is near enough to leave others out


def test_cells_no_query_reaches_are_not_read(spark, tmp_path):
    matrix, centers = clustered(6, 10, 30)
    index = mi.write_index(vector_rows(spark, matrix), str(tmp_path / "i"))
    found = mi.nearest_indexed(query_rows(spark, centers[:1]), index)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(cell" in plan or "PushedFilters: [Or" in plan or "cell" in plan.split("PushedFilters")[1]
    assert found.count() == 5


def test_each_width_is_searched_on_its_own(spark):
    queries = query_rows(spark, np.eye(2)[[0, 1, 0, 1, 0]], [("wide", [1.0, 2.0, 3.0])])
    vectors = vector_rows(spark, np.eye(2), [(10, [1.0, 2.0, 3.0]), (11, [1.0, 2.0, 4.0])])
    for size in ({}, {"max_shared_bytes": 0, "block_bytes": 8}):
        hits = [(r.id, str(r.distance)) for r in search.nearest(queries, vectors, 3, **size).where("query_id = 'wide'").orderBy("rank").collect()]
        assert hits == [(10, "0.0"), (11, "1.0"), (0, "nan")]


def test_widths_of_embeddings():
    nan, inf = float("nan"), float("inf")
    embeddings = pa.array([[1.0, 2.0], [], [nan], [1.0, None], [3.0], [inf, 1.0, 2.0]], pa.list_(pa.float32()))
    assert search.shape_of(embeddings).tolist() == [2, 0, 0, 0, 1, 0]


def test_blocks_and_regions_are_bounded_in_number_and_size():
    wide = 64 * search.FLOAT_BYTES
    for rows, least, most in ((1_000, 4, 4), (100_000, 2, 16), (720_000, 2, 16), (100_000_000, 382, 382)):
        blocks = -(-rows // search.rows_per_block(rows, 64, 64 * 1024))
        assert least <= blocks <= most and -(-rows // blocks) * wide <= search.BLOCK_BYTES
    regions, parts = mi.regions_of([0, 3, 3, 25, 1, 9, 2], 10)
    assert regions == [0, 0, 0, 1, 2, 2, 3] and parts == [1, 3, 1, 1]


def test_rows_are_copied_a_bounded_number_of_times(spark, tmp_path):
    """Blocks and lots of one row would copy each of 200 rows 200 times."""
    noise = np.random.default_rng(8).normal(size=(200, 8))
    queries, vectors = query_rows(spark, noise), vector_rows(spark, noise)
    index = mi.write_index(vectors, str(tmp_path / "i"))
    for found in (search.nearest(queries, vectors, max_shared_bytes=0, block_bytes=8),
                  mi.nearest_indexed(queries, index, max_shared_bytes=0, block_bytes=8)):
        wanted = rows(search.nearest(queries, vectors), *ROWS)
        assert rows(found, *ROWS) == wanted
        numbers = re.findall(r"sequence\(0, (\d+)", found._jdf.queryExecution().analyzed().toString())
        assert numbers and max(map(int, numbers)) < search.MOST_BLOCKS


def test_queries_meet_all_pivots_in_bounded_numbers(spark, tmp_path, monkeypatch):
    noise, most = np.random.default_rng(9).normal(size=(300, 8)), []
    monkeypatch.setattr(mi, "PIVOTED_ROWS", 64)
    straight = mi._straight
    monkeypatch.setattr(mi, "_straight", lambda a, b: most.append(len(a) * len(b)) or straight(a, b))
    index = mi.write_index(vector_rows(spark, noise), str(tmp_path / "i"), pivots=32)
    scored_pairs(index, query_rows(spark, noise))
    assert max(most) <= max(64 * 32, len(noise))
