"""Exact nearest neighbours of many queries in a vector table.

The pairs are never rows. Each task scores a block of vectors against a block
of queries with numpy and passes on k rows per query; a ranking window then
merges those. A query set of proven size goes to every task; a larger one is
cut into blocks that meet every block of vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from quillframe.operators.ordering import top_k
from quillframe.spreading import spread

DEFAULT_K = 5  # fixed value: hits per query
MAX_SHARED_BYTES = 64 * 1024 * 1024
BLOCK_BYTES = 64 * 1024 * 1024
#: Blocks of a table while they stay under ``BLOCK_BYTES``: so often a row is copied.
MOST_BLOCKS = 16
FLOAT_BYTES = 4
SCORED_QUERIES = 256
SCORED_VECTORS = 8_192
EXACT_PAIRS = 65_536
# Distances that are equal in mathematics differ in their last bits with the
# order of the sum; rounding makes them tie, so ranks repeat on any layout.
DECIMALS = 9


def matrix_of(column, kind=np.float64) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty((0, 0), kind)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _estimate(vectors: np.ndarray, queries: np.ndarray, metric: str) -> tuple[np.ndarray, float]:
    """Distances by one single-precision matrix product, with a bound on their
    error: products of width w lose at most w rounding units of the norms."""
    v_square, q_square = (vectors**2).sum(axis=1), (queries**2).sum(axis=1)
    rounding = (vectors.shape[1] + 16) * float(np.finfo(np.float32).eps)
    if metric == "cosine":
        unit_v = vectors / np.sqrt(np.where(v_square == 0, 1, v_square))[:, None]
        unit_q = queries / np.sqrt(np.where(q_square == 0, 1, q_square))[:, None]
        return 1 - unit_q.astype(np.float32) @ unit_v.astype(np.float32).T, 2 * rounding
    near = queries.astype(np.float32) @ vectors.astype(np.float32).T
    near *= -2
    near += v_square.astype(np.float32)[None, :]
    near += q_square.astype(np.float32)[:, None]
    return near, rounding * float(v_square.max(initial=0) + q_square.max(initial=0))


def _exact(vectors: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Distance of row i of one to row i of the other."""
    if metric == "cosine":
        norms = np.sqrt((vectors**2).sum(axis=1)) * np.sqrt((queries**2).sum(axis=1))
        distance = 1 - (vectors * queries).sum(axis=1) / np.where(norms == 0, 1, norms)
    else:
        distance = ((vectors - queries) ** 2).sum(axis=1)
    return np.round(distance, DECIMALS) + 0.0  # no negative zero


def _place_in_group(groups: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each run of a sorted array."""
    return np.arange(len(groups)) - np.searchsorted(groups, groups, side="left")


def _without_extra_copies(vectors: np.ndarray, k: int) -> np.ndarray:
    """Rows left when equal vectors count with their first k rows only: further
    copies tie with k smaller ids, so they are nobody's neighbours."""
    whole = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.itemsize * vectors.shape[1])))
    _, group = np.unique(whole.ravel(), return_inverse=True)
    by_group = np.argsort(group, kind="stable")
    return np.sort(by_group[_place_in_group(group[by_group]) < k])


class _Best:
    """The k nearest so far per query of one width, ties to the smaller id.

    ``bound`` is an upper bound on each query's k-th distance, if one is known.
    """

    def __init__(self, query_ids: pa.Array, queries: np.ndarray, k: int, metric: str, bound: np.ndarray | None = None):
        self.query_ids, self.queries, self.k, self.metric = query_ids, queries, k, metric
        self.worst = np.full(len(queries), np.inf) if bound is None else bound.copy()
        self.table: pa.Table | None = None
        self.scored = 0

    def add(self, ids: pa.Array, vectors: np.ndarray, chosen: np.ndarray | None = None) -> None:
        """Scores vectors against the chosen queries, or all."""
        chosen = np.arange(len(self.queries)) if chosen is None else chosen
        for low in range(0, len(ids), SCORED_VECTORS):
            self._add_block(ids.slice(low, SCORED_VECTORS), vectors[low:low + SCORED_VECTORS], chosen)

    def _add_block(self, ids: pa.Array, vectors: np.ndarray, chosen: np.ndarray) -> None:
        by_id = pc.sort_indices(ids).to_numpy()
        kept = by_id[_without_extra_copies(vectors[by_id], self.k)]
        ids, vectors = ids.take(pa.array(kept)), vectors[kept]
        self.scored += len(vectors) * len(chosen)
        parts = []
        for start in range(0, len(chosen), SCORED_QUERIES):
            found = self._candidates(vectors, chosen[start:start + SCORED_QUERIES])
            if found is not None:
                query, vector, distance = found
                parts.append(
                    pa.table(
                        {"query": pa.array(query), "distance": pa.array(distance), "id": ids.take(pa.array(vector))}
                    )
                )
        if parts:
            self._keep_best(pa.concat_tables(parts))

    def _candidates(self, vectors: np.ndarray, chosen: np.ndarray):
        queries = self.queries[chosen].astype(np.float64)
        near, error = _estimate(vectors, queries, self.metric)
        limit = self.worst[chosen]
        if np.isinf(limit).any():
            k = min(self.k, near.shape[1])
            limit = np.minimum(limit, np.partition(near, k - 1, axis=1)[:, k - 1])
        limit = (limit + 3 * error + 10.0**-DECIMALS).astype(np.float32)
        row, column = np.nonzero(near <= limit[:, None])
        if len(row) > 8 * self.k * len(chosen):  # a loose bound: of these only the nearest can count
            tight = np.partition(near, self.k - 1, axis=1)[:, self.k - 1] + 3 * error + 10.0**-DECIMALS
            row, column = np.nonzero(near <= np.minimum(limit, tight.astype(np.float32))[:, None])
        if not len(row):
            return None
        distance = np.concatenate(
            [
                _exact(vectors[column[i:i + EXACT_PAIRS]], queries[row[i:i + EXACT_PAIRS]], self.metric)
                for i in range(0, len(row), EXACT_PAIRS)
            ]
        )
        # Columns follow the ids, so they break ties. Equal copies are cut to k here.
        order = np.lexsort((column, distance, row))
        row, column, distance = row[order], column[order], distance[order]
        keep = _place_in_group(row) < self.k
        return chosen[row[keep]], column[keep], distance[keep]

    def _keep_best(self, table: pa.Table) -> None:
        """Only queries with new candidates are sorted anew."""
        others = None
        if self.table is not None:
            met = np.zeros(len(self.queries), bool)
            met[table["query"].to_numpy()] = True
            own = met[self.table["query"].to_numpy()]
            others = self.table.filter(pa.array(~own))
            table = pa.concat_tables([self.table.filter(pa.array(own)), table])
        table = table.take(
            pc.sort_indices(table, [("query", "ascending"), ("distance", "ascending"), ("id", "ascending")])
        )
        query = table["query"].to_numpy()
        place = _place_in_group(query)
        table = table.filter(pa.array(place < self.k))
        query, place = query[place < self.k], place[place < self.k]
        full = place == self.k - 1
        self.worst[query[full]] = np.minimum(self.worst[query[full]], table["distance"].to_numpy()[full])
        self.table = (table if others is None else pa.concat_tables([others, table])).combine_chunks()

    def hits(self) -> list[pa.Table]:
        if self.table is None:
            return []
        return [
            pa.table(
                {
                    "query_id": self.query_ids.take(self.table["query"].combine_chunks()),
                    "id": self.table["id"],
                    "distance": self.table["distance"],
                }
            )
        ]


def shape_of(embeddings: pa.Array) -> np.ndarray:
    """Width of every embedding that has distances, 0 of one that is empty or
    holds a null, NaN or infinite number."""
    widths = pc.list_value_length(embeddings).to_numpy(zero_copy_only=False).astype(np.int64)
    odd = ~np.isfinite(embeddings.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if odd.any():
        widths[np.repeat(np.arange(len(widths)), widths)[odd]] = 0
    return widths


class Scorer:
    """Hits of a set of queries among the vectors that pass by.

    Queries of each width are searched among vectors of that width. Other
    vectors have no distance to them; the k smallest of their ids are kept as
    hits of distance NaN, which come last.
    """

    def __init__(self, query_ids: pa.Array, embeddings: pa.Array, k: int, metric: str):
        self.k, widths = k, shape_of(embeddings)
        self.best: dict[int, _Best | None] = {}
        self.queries: dict[int, pa.Array] = {}
        self.first: dict[int, pa.Array] = {}
        for width in np.unique(widths).tolist():
            own = pa.array(widths == width)
            self.queries[width] = query_ids.filter(own)
            matrix = matrix_of(embeddings.filter(own), np.float32) if width else None
            self.best[width] = _Best(self.queries[width], matrix, k, metric) if width else None

    def add(self, ids: pa.Array, embeddings: pa.Array) -> None:
        widths = shape_of(embeddings)
        for width, best in self.best.items():
            own = (widths == width) & (width > 0)
            if own.any():
                rows = np.flatnonzero(own)
                for low in range(0, len(rows), SCORED_VECTORS):
                    taken = pa.array(rows[low:low + SCORED_VECTORS])
                    best.add(ids.take(taken), matrix_of(embeddings.take(taken)))
            if not own.all():
                self._without_distance(width, ids.filter(pa.array(~own)))

    def _without_distance(self, width: int, ids: pa.Array) -> None:
        if width in self.first:
            ids = pa.concat_arrays([self.first[width], ids])
        self.first[width] = ids.take(pc.sort_indices(ids)[:self.k])

    def hits(self) -> pa.Table | None:
        found = [table for best in self.best.values() if best for table in best.hits()]
        for width, ids in self.first.items():
            queries = self.queries[width]
            found.append(pa.table({
                "query_id": queries.take(pa.array(np.repeat(np.arange(len(queries)), len(ids)))),
                "id": ids.take(pa.array(np.tile(np.arange(len(ids)), len(queries)))),
                "distance": pa.array(np.full(len(queries) * len(ids), np.nan)),
            }))
        return pa.concat_tables(found) if found else None


def hit_schema(queries: DataFrame, vectors: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("id", vectors.schema["id"].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )


def _proven_small(queries: DataFrame, max_bytes: int) -> bool:
    each = 8 if isinstance(queries.schema["embedding"].dataType.elementType, T.DoubleType) else FLOAT_BYTES
    one = F.size("embedding") * each + F.octet_length(F.col("query_id").cast("string"))
    return (queries.agg(F.sum(one)).first()[0] or 0) <= max_bytes


def rows_per_block(rows: int, width: int, block_bytes: int) -> int:
    """Blocks of ``block_bytes``, larger ones where there would be more than
    ``MOST_BLOCKS``, but none over ``BLOCK_BYTES``, if that is more."""
    least, most = (max(1, size // (max(width, 1) * FLOAT_BYTES)) for size in (block_bytes, max(block_bytes, BLOCK_BYTES)))
    return min(most, max(least, math.ceil(rows / MOST_BLOCKS)))


def _blocks(rows: DataFrame, block_bytes: int) -> int:
    found = rows.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("embedding")).alias("width")).first()
    return max(1, math.ceil(found.rows / rows_per_block(found.rows, found.width or 1, block_bytes)))


def one_array(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    return whole if isinstance(whole, pa.Array) else pa.concat_arrays(whole.chunks)


def _with_shared_queries(queries: DataFrame, vectors: DataFrame, schema: T.StructType, k: int, metric: str) -> DataFrame:
    table = queries.toArrow()
    shared = vectors.sparkSession.sparkContext.broadcast((one_array(table["query_id"]), one_array(table["embedding"])))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Scorer(*shared.value, k, metric)
        for batch in batches:
            if batch.num_rows:
                best.add(batch.column("id"), batch.column("embedding"))
        hits = best.hits()
        if hits is not None:
            yield from hits.to_batches()

    return spread(vectors).mapInArrow(score, schema)


def _in_blocks(
    queries: DataFrame, vectors: DataFrame, schema: T.StructType, k: int, metric: str, block_bytes: int
) -> DataFrame:
    """Every block of queries meets every block of vectors in a task of its own.

    Blocks hold a bounded number of bytes and come from hashes of unique ids, so
    they are even whatever the data. Vectors are copied once per query block,
    queries once per vector block; blocks of ``block_bytes`` grow with the tables
    up to ``BLOCK_BYTES``, so that copies don't grow with their square.
    """
    query_blocks, vector_blocks = _blocks(queries, block_bytes), _blocks(vectors, block_bytes)

    def block(column: str, count: int):
        return F.pmod(F.xxhash64(column), F.lit(count))

    def all_blocks(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    left = queries.select("*", block("query_id", query_blocks).alias("_q"), all_blocks(vector_blocks).alias("_v"))
    right = vectors.select("*", block("id", vector_blocks).alias("_v"), all_blocks(query_blocks).alias("_q"))
    target = pa.schema([(f.name, arrow_type(f.dataType)) for f in schema])

    def score(query_table: pa.Table, vector_table: pa.Table) -> pa.Table:
        if not query_table.num_rows or not vector_table.num_rows:
            return target.empty_table()
        best = Scorer(one_array(query_table["query_id"]), one_array(query_table["embedding"]), k, metric)
        best.add(one_array(vector_table["id"]), one_array(vector_table["embedding"]))
        hits = best.hits()
        return target.empty_table() if hits is None else hits.cast(target)

    keys = [F.col("_q").cast("bigint"), F.col("_v").cast("bigint")]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, schema)


def arrow_type(spark_type: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(spark_type)


def nearest(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = DEFAULT_K,
    metric: str = "l2",
    max_shared_bytes: int = MAX_SHARED_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest vectors of every query.

    ``queries`` has (query_id, embedding) and is read twice, ``vectors`` has (id,
    embedding); ids are unique. Filter ``vectors`` before, so that the filter
    reaches its scan. Metrics: squared ``l2`` and ``cosine``. Candidates are
    found in single precision with its error allowed for; their distances are
    double precision, rounded to nine decimals, and ties go to the smaller id.

    Null embeddings are absent ones. Every query is searched among the vectors
    of its own width. An embedding of another width has the distance NaN to it,
    and one that is empty or holds a null, NaN or infinite number has it to all
    others. Such hits come last, by id, and can be told by it.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    present = F.col("embedding").isNotNull()
    queries = queries.select("query_id", "embedding").where(present)
    vectors = vectors.select("id", "embedding").where(present)
    schema = hit_schema(queries, vectors)
    if _proven_small(queries, max_shared_bytes):
        partial = _with_shared_queries(queries, vectors, schema, k, metric)
    else:
        partial = _in_blocks(queries, vectors, schema, k, metric, block_bytes)
    return top_k(partial, ["query_id"], [F.col("distance"), F.col("id")], k)


def attach_documents(hits: DataFrame, vectors: DataFrame) -> DataFrame:
    """Documents of the hits; only k rows per query take part in the join."""
    return hits.join(vectors.select("id", "document"), "id")
