"""Exact nearest neighbours with a stored index of cells.

Every vector belongs to the cell of its nearest pivot, and keeps its distance to
it. A cell has a radius and a number of vectors, so the cells around a query
give an upper bound on its k-th distance before any vector is read. A cell that
is farther away than this bound, by the triangle inequality, is not scored for
that query. Vectors that gather around pivots are mostly left out; vectors
without clusters are about equally far from everything, and little is saved.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from quillframe.operators import search
from quillframe.operators.ordering import top_k
from quillframe.spreading import spread

#: Pivots are held by every task: so many rows of one width at most.
MAX_PIVOTS = 1024
#: Rows that are compared with all pivots at once: a few matrices of so many rows and a column a pivot.
PIVOTED_ROWS = 1024
#: The cell of vectors that no bound holds for: another width, no numbers, no direction.
REST = -1
CELLS = "cell int, vectors bigint, nearest double, farthest double, pivot array<float>"


def _points(vectors: np.ndarray, metric: str) -> np.ndarray:
    """Points whose straight distance grows with the metric."""
    vectors = vectors.astype(np.float64)
    if metric == "l2":
        return vectors
    norms = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    return vectors / np.where(norms == 0, 1, norms)


def _straight(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _as_distance(straight: np.ndarray, metric: str) -> np.ndarray:
    return straight**2 if metric == "l2" else straight**2 / 2


@dataclass(frozen=True)
class Cells:
    """Pivots with the number of vectors around each and how near and far they are."""

    metric: str
    pivots: np.ndarray
    vectors: np.ndarray
    nearest: np.ndarray
    farthest: np.ndarray
    rest: int

    @property
    def width(self) -> int:
        return self.pivots.shape[1]

    def bounds(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Straight distances of queries to pivots, and an upper bound on each query's k-th
        straight distance (infinite for fewer vectors). ``PIVOTED_ROWS`` queries at most."""
        points, pivots = _points(queries, self.metric), _points(self.pivots, self.metric)
        to_pivot = _straight(points, pivots)
        norms, slack = np.sqrt((points**2).sum(axis=1)), self.slack(points)
        outer = to_pivot + self.farthest[None, :]
        near = min(k, outer.shape[1])  # no cell is empty
        order = np.argpartition(outer, near - 1, axis=1)[:, :near] if near else np.zeros((len(points), 0), np.int64)
        order = np.take_along_axis(order, np.argsort(np.take_along_axis(outer, order, 1), axis=1), 1)
        enough = np.cumsum(self.vectors[order], axis=1) >= k
        upper = np.full(len(queries), np.inf)
        has = enough.any(axis=1)
        first = enough.argmax(axis=1)
        upper[has] = np.take_along_axis(outer, np.take_along_axis(order, first[:, None], 1), 1)[has, 0]
        if self.metric == "cosine":  # a query without a direction is at distance 1 from all
            upper[norms == 0] = np.inf
        return to_pivot, upper + 2 * slack

    def slack(self, points: np.ndarray) -> np.ndarray:
        """What rounding can change in straight distances of these points."""
        most = np.sqrt((_points(self.pivots, self.metric)**2).sum(axis=1)).max(initial=0) + self.farthest.max(initial=0)
        return 1e-6 * (np.sqrt((points**2).sum(axis=1)) + most) + 1e-9

    def upper_bounds(self, queries: np.ndarray, k: int) -> np.ndarray:
        """The upper bounds of any number of queries."""
        parts = [self.bounds(queries[low:low + PIVOTED_ROWS], k)[1] for low in range(0, len(queries), PIVOTED_ROWS)]
        return np.concatenate([np.zeros(0), *parts])

    def reached(self, to_pivot: np.ndarray, upper: np.ndarray, cells: slice | int = slice(None)) -> np.ndarray:
        """Whether a vector of a cell can be as near as the bound."""
        inner = np.maximum(to_pivot - self.farthest[cells], self.nearest[cells] - to_pivot)
        return inner <= (upper[:, None] if inner.ndim > 1 else upper)


@dataclass(frozen=True)
class MetricIndex:
    """``vectors`` (id, embedding, cell, to_pivot), in the order of cells, and its cells."""

    vectors: DataFrame
    cells: Cells


def has_distance(width: int) -> Column:
    """Whether an embedding has ``width`` finite numbers."""
    return (F.size("embedding") == width) & F.forall(
        "embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def _pivots(vectors: DataFrame, metric: str, count: int | None) -> np.ndarray:
    """Distinct vectors of the most frequent width among a bounded number, taken by the hash of their ids."""
    if count is None:
        count = math.ceil(math.sqrt(vectors.count()))
    count = max(1, min(count, MAX_PIVOTS))
    taken = vectors.select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(count).toArrow()["embedding"]
    whole = taken.combine_chunks()
    embeddings = whole if isinstance(whole, pa.Array) else pa.concat_arrays(whole.chunks)
    widths = search.shape_of(embeddings)
    found, counts = np.unique(widths[widths > 0], return_counts=True)
    if not len(found):
        return np.zeros((0, 0), np.float32)
    width = int(found[counts.argmax()])
    chosen = search.matrix_of(embeddings.filter(pa.array(widths == width)), np.float32)
    if metric == "cosine":
        chosen = chosen[(chosen != 0).any(axis=1)]
    return np.unique(chosen, axis=0)


def write_index(vectors: DataFrame, path: str, metric: str = "l2", pivots: int | None = None) -> MetricIndex:
    """Store the index of ``vectors`` (id, embedding) in a folder.

    ``pivots`` is their number, the square root of the rows if not given, and
    never more than ``MAX_PIVOTS``. Null embeddings are left out. Rows are
    written in the order of cells and ids, so a hot cell is several files, and
    a scan of some cells leaves the others out by their row groups.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    spark = vectors.sparkSession
    vectors = vectors.select("id", "embedding").where(F.col("embedding").isNotNull())
    points = _pivots(vectors, metric, pivots)
    width, normal = points.shape[1] if len(points) else 0, _points(points, metric) if len(points) else points
    schema = T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("to_pivot", T.DoubleType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, to_pivot = np.full(batch.num_rows, REST, np.int32), np.zeros(batch.num_rows)
            embeddings = batch.column("embedding")
            own = np.flatnonzero(search.shape_of(embeddings) == width) if width else np.zeros(0, np.int64)
            for low in range(0, len(own), PIVOTED_ROWS):
                rows = own[low:low + PIVOTED_ROWS]
                found = _points(search.matrix_of(embeddings.take(pa.array(rows))), metric)
                if metric == "cosine":
                    directed = (found != 0).any(axis=1)
                    rows, found = rows[directed], found[directed]
                distance = _straight(found, normal)
                cell[rows] = distance.argmin(axis=1)
                to_pivot[rows] = distance.min(axis=1, initial=np.inf)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(to_pivot)], names=schema.names)

    spread(vectors).mapInArrow(assign, schema).repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.parquet(f"{path}/vectors")
    stored = spark.read.schema(schema).parquet(f"{path}/vectors")
    pivot_rows = spark.createDataFrame(
        [(i, row) for i, row in enumerate(points.tolist())], "cell int, pivot array<float>")
    stored.groupBy("cell").agg(
        F.count(F.lit(1)).alias("vectors"), F.min("to_pivot").alias("nearest"), F.max("to_pivot").alias("farthest"),
    ).join(F.broadcast(pivot_rows), "cell", "left").select(
        "cell", "vectors", "nearest", "farthest", "pivot", F.lit(metric).alias("metric")
    ).coalesce(1).write.parquet(f"{path}/cells")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> MetricIndex:
    """An index that ``write_index`` stored; its cells are at most ``MAX_PIVOTS`` and one."""
    rows = spark.read.schema(f"{CELLS}, metric string").parquet(f"{path}/cells").orderBy("cell").collect()
    own = [r for r in rows if r.cell != REST]
    numbers = {r.cell: i for i, r in enumerate(own)}  # cells without vectors are not there
    cells = Cells(
        rows[0].metric if rows else "l2",
        np.array([r.pivot for r in own], np.float32) if own else np.zeros((0, 0), np.float32),
        np.array([r.vectors for r in own], np.int64),
        np.array([r.nearest for r in own], np.float64), np.array([r.farthest for r in own], np.float64),
        sum(r.vectors for r in rows if r.cell == REST))
    vectors = spark.read.parquet(f"{path}/vectors")
    if numbers and list(numbers) != list(numbers.values()):
        places = F.create_map(*[F.lit(x) for pair in [(REST, REST), *numbers.items()] for x in pair])
        vectors = vectors.withColumn("cell", places[F.col("cell")])
    return MetricIndex(vectors, cells)


class CellScorer:
    """Hits among vectors that pass by in the order of their cells.

    ``upper`` has the queries' bounds, if they are all of the index's width and
    the bounds are known. Distances to a pivot are found when its cell comes.
    """

    def __init__(self, query_ids: pa.Array, embeddings: pa.Array, k: int, cells: Cells, upper: np.ndarray | None = None):
        self.cells, self.scorer = cells, search.Scorer(query_ids, embeddings, k, cells.metric)
        self.best = self.scorer.best.get(cells.width) if cells.width else None
        if self.best:
            self.points, self.pivots = _points(self.best.queries, cells.metric), _points(cells.pivots, cells.metric)
            self.slack = cells.slack(self.points)
            self.best.worst = _as_distance(cells.upper_bounds(self.best.queries, k) if upper is None else upper, cells.metric)

    def _reach(self) -> np.ndarray:
        """Straight distance that is still of interest to each query."""
        factor = 1 if self.cells.metric == "l2" else 2
        reach = np.sqrt(factor * (self.best.worst + 10.0**-search.DECIMALS)) + self.slack
        if self.cells.metric == "cosine":
            reach[~self.best.queries.any(axis=1)] = np.inf
        return reach

    def add(self, ids: pa.Array, embeddings: pa.Array, cell: np.ndarray, to_pivot: np.ndarray) -> None:
        edges = np.flatnonzero(np.diff(cell, prepend=cell[0] - 1 if len(cell) else 0, append=cell[-1] + 1 if len(cell) else 0))
        for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
            here = slice(begin, end)
            if cell[begin] == REST:
                self.scorer.add(ids.slice(begin, end - begin), embeddings.slice(begin, end - begin))
            elif self.best:
                self._add_cell(int(cell[begin]), ids, embeddings, np.arange(begin, end), to_pivot[here])

    def _add_cell(self, cell: int, ids: pa.Array, embeddings: pa.Array, rows: np.ndarray, to_pivot: np.ndarray) -> None:
        reach, away = self._reach(), _straight(self.points, self.pivots[cell:cell + 1])[:, 0]
        chosen = np.flatnonzero(self.cells.reached(away, reach, cell))
        if not len(chosen):
            return
        # vectors at a distance from the pivot that no chosen query reaches
        low, high = (away[chosen] - reach[chosen]).min(), (away[chosen] + reach[chosen]).max()
        rows = rows[(to_pivot >= low) & (to_pivot <= high)]
        if len(rows):
            taken = pa.array(rows)
            self.best.add(ids.take(taken), search.matrix_of(embeddings.take(taken)), chosen)


def _shared(queries: DataFrame, index: MetricIndex, schema: T.StructType, k: int) -> DataFrame:
    """Queries of a proven size go to every task; cells that none of them reaches aren't read."""
    table = queries.toArrow()
    ids, embeddings = search.one_array(table["query_id"]), search.one_array(table["embedding"])
    matrix, visited = search.matrix_of(embeddings, np.float32), np.zeros(len(index.cells.pivots), bool)
    bounds = [np.zeros(0)]
    for low in range(0, len(matrix), PIVOTED_ROWS):
        to_pivot, upper = index.cells.bounds(matrix[low:low + PIVOTED_ROWS], k)
        visited |= index.cells.reached(to_pivot, upper).any(axis=0)
        bounds.append(upper)
    cells = [REST, *np.flatnonzero(visited).tolist()]
    shared = index.vectors.sparkSession.sparkContext.broadcast((ids, embeddings, astuple(index.cells), np.concatenate(bounds)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ids, own_embeddings, own_cells, upper = shared.value
        best = CellScorer(own_ids, own_embeddings, k, Cells(*own_cells), upper)
        for batch in batches:
            if batch.num_rows:
                best.add(batch.column("id"), batch.column("embedding"), batch.column("cell").to_numpy(), batch.column("to_pivot").to_numpy())
        hits = best.scorer.hits()
        if hits is not None:
            yield from hits.to_batches()

    return index.vectors.where(F.col("cell").isin(cells)).select("id", "embedding", "cell", "to_pivot").mapInArrow(score, schema)


def visits(queries: DataFrame, index: MetricIndex, k: int, regions: list[int] | None = None) -> DataFrame:
    """(query_id, embedding, cell, upper): the cells that each query can have hits in, and its bound.

    ``regions`` names the region of every cell, ``REST`` first: a query comes once
    for all cells of one, which stands in ``cell``.
    """
    schema = T.StructType([*queries.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("upper", T.DoubleType())])
    cells = index.cells

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, search.SCORED_QUERIES):
                part = batch.slice(low, search.SCORED_QUERIES)
                to_pivot, upper = cells.bounds(search.matrix_of(part.column("embedding"), np.float32), k)
                query, cell = np.nonzero(cells.reached(to_pivot, upper))
                if cells.rest:
                    query = np.concatenate([query, np.arange(part.num_rows)])
                    cell = np.concatenate([cell, np.full(part.num_rows, REST)])
                if regions:
                    query, cell = np.divmod(np.unique(query * len(regions) + np.array(regions)[cell + 1]), len(regions))
                taken = part.take(pa.array(query))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(cell.astype(np.int32)), pa.array(upper[query])], names=schema.names)

    return queries.mapInArrow(visit, schema)


def regions_of(vectors: list[int], per_block: int) -> tuple[list[int], list[int]]:
    """The region of every cell, given their numbers of vectors, and the parts of every region.

    A region is a run of cells of a block of vectors together, or a single larger
    cell in parts.
    """
    regions, parts, held = [], [], per_block + 1
    for n in vectors:
        if held + n > per_block:
            parts.append(max(1, math.ceil(n / per_block)))
            held = 0
        held += n
        regions.append(len(parts) - 1)
    return regions, parts


def _by_visits(queries: DataFrame, index: MetricIndex, schema: T.StructType, k: int, block_bytes: int) -> DataFrame:
    """Queries travel to the cells they can have hits in.

    Cells are taken together up to a block of vectors, a cell of more has parts,
    and queries are dealt to as many lots as keep a lot within a block, so no task
    holds more than a block of each whatever a cell's share of vectors or of
    queries is. Blocks grow with the tables as ``search.nearest`` has them.
    """
    cells, vectors = index.cells, [int(n) for n in (index.cells.rest, *index.cells.vectors)]
    count = queries.count()
    lots = max(1, math.ceil(count / search.rows_per_block(count, cells.width, block_bytes)))
    regions, parts = regions_of(vectors, search.rows_per_block(sum(vectors), cells.width, block_bytes))
    region, parts_of = F.element_at(F.array(*map(F.lit, regions)), F.col("cell") + 2), F.element_at(F.array(*map(F.lit, parts)), F.col("_region") + 1)
    lot = F.pmod(F.xxhash64("query_id"), F.lit(lots)).cast("int").alias("_lot")
    part = F.pmod(F.xxhash64("id"), parts_of).cast("int").alias("_part")
    left = visits(queries, index, k, regions).withColumnRenamed("cell", "_region").select(
        "query_id", "embedding", "upper", "_region", lot, F.explode(F.sequence(F.lit(0), parts_of - 1)).alias("_part"))
    right = index.vectors.withColumn("_region", region).select(
        "id", "embedding", "to_pivot", "cell", "_region", part, F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("_lot"))
    target = pa.schema([(f.name, search.arrow_type(f.dataType)) for f in schema])

    def score(query_table: pa.Table, vector_table: pa.Table) -> pa.Table:
        if not query_table.num_rows or not vector_table.num_rows:
            return target.empty_table()
        vector_table = vector_table.sort_by("cell")
        best = CellScorer(search.one_array(query_table["query_id"]), search.one_array(query_table["embedding"]), k, cells,
                          query_table["upper"].to_numpy())
        best.add(search.one_array(vector_table["id"]), search.one_array(vector_table["embedding"]),
                 vector_table["cell"].to_numpy(), vector_table["to_pivot"].to_numpy())
        hits = best.scorer.hits()
        return target.empty_table() if hits is None else hits.cast(target)

    keys = [F.col("_region"), F.col("_part"), F.col("_lot")]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, schema)


def nearest_indexed(
    queries: DataFrame,
    index: MetricIndex,
    k: int = search.DEFAULT_K,
    max_shared_bytes: int = search.MAX_SHARED_BYTES,
    block_bytes: int = search.BLOCK_BYTES,
) -> DataFrame:
    """(query_id, id, distance, rank) as ``search.nearest`` has them, by the index.

    Queries of another width than the pivots, and those without numbers, are
    searched without it.
    """
    queries = queries.select("query_id", "embedding").where(F.col("embedding").isNotNull())
    width = index.cells.width if len(index.cells.pivots) else 0
    schema = search.hit_schema(queries, index.vectors)
    own = F.coalesce(has_distance(width), F.lit(False)) if width else F.lit(False)
    size = F.size("embedding") * search.FLOAT_BYTES + F.octet_length(F.col("query_id").cast("string"))
    held = queries.agg(F.sum(F.when(own, size)).alias("bytes"), F.count_if(~own).alias("others")).first()
    indexed = queries.where(own)
    if (held.bytes or 0) <= max_shared_bytes:
        partial = _shared(indexed, index, schema, k)
    else:
        partial = _by_visits(indexed, index, schema, k, block_bytes)
    found = top_k(partial, ["query_id"], [F.col("distance"), F.col("id")], k)
    if held.others:
        found = found.unionByName(search.nearest(
            queries.where(~own), index.vectors, k, index.cells.metric, max_shared_bytes, block_bytes))
    return found
