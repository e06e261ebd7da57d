"""Near-duplicate embeddings by random hyperplanes, verified by exact cosine.

Signs of projections on random hyperplanes are the key of a vector in each of
several tables. Vectors that share a key in some table are compared exactly;
links are counted in the task and only a spanning forest of each bucket leaves
it, from which components are found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillframe.llm.components import connected_components
from quillframe.scratch import written

LEAST_COSINE = 0.98
#: Chance of missing a pair that is just similar enough.
MISSED = 1e-4
#: Vectors of a label that share a key by chance, on average.
BUCKET_ROWS = 500
LEAST_BITS, MOST_BITS = 4, 30
#: Rows of a bucket that are compared with another such block in one group.
BLOCK_ROWS = 1024
SEED = 20240229


def table_shape(rows: int, least_cosine: float = LEAST_COSINE, missed: float = MISSED) -> tuple[int, int]:
    """(bits, tables) for a label with that many vectors.

    More bits keep buckets small, more tables keep the chance of finding a pair:
    two vectors at the least cosine agree in a bit with 1 - angle / pi.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(rows, 1) / BUCKET_ROWS)) if rows > BUCKET_ROWS else 0))
    agree = (1 - math.acos(least_cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(missed) / math.log(1 - agree))) if agree < 1 else 1


def _planes(width: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, width]).standard_normal((width, MOST_BITS * tables)).reshape(
        width, tables, MOST_BITS)[:, :, :bits].reshape(width, tables * bits)


def _keyed(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """Adds the unit vector's bytes, its width and its key in each table, drops the vector."""
    passed = ["least", "x", "y", "label", "n"]
    schema = "least long, x long, y long, label string, n long, unit binary, width int, keys array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        powers = (1 << np.arange(bits)).astype(np.int64)
        for batch in batches:
            values = batch.column(len(passed))
            sizes = np.diff(values.offsets.to_numpy())
            flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            begin = np.cumsum(sizes) - sizes
            units, keys = [b""] * len(sizes), [[]] * len(sizes)
            for width in np.unique(sizes):
                rows = np.flatnonzero(sizes == width)
                if width not in planes:
                    planes[width] = _planes(int(width), bits, tables)
                x = flat[begin[rows][:, None] + np.arange(width)]
                x /= np.abs(x).max(axis=1, keepdims=True)  # squares of extreme numbers would overflow
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                signs = (x @ planes[width] > 0).reshape(len(rows), tables, bits)
                own = (signs @ powers).astype(np.int32)
                for r, unit, key in zip(rows, x, own):
                    units[r], keys[r] = unit.tobytes(), key
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(passed)], pa.array(units, pa.binary()),
                 pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int32()))],
                names=[*passed, "unit", "width", "keys"])

    return classes.select(*passed, "vector").mapInArrow(run, schema)


def _compared(buckets: DataFrame, least_cosine: float) -> DataFrame:
    """(id, links, to) of bucket blocks: links found there, and one link of its forest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []

        def compared() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                yield from _links_of(rows, at[1], at[4] == at[5], least_cosine)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns):
                if at != row[:6]:
                    yield from compared()
                    at, rows = row[:6], []
                rows.append(row[6:])
        yield from compared()

    keys = ["label", "table", "width", "key", "low", "high"]
    return (
        buckets.select(*keys, "side", "id", "n", "unit", "keys")
        .repartition(*keys).sortWithinPartitions(*keys, "side", "id")
        .mapInArrow(run, "id long, links long, to long")
    )


_FOUND = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("to", pa.int64())])


def _links_of(rows: list[tuple], table: int, same: bool, least_cosine: float) -> Iterator[pa.RecordBatch]:
    """Links between two blocks of a bucket, or within one.

    A pair that an earlier table brings together is left to that table, so each
    pair counts once. A link counts as often as the other's vector occurs.
    """
    side = np.array([r[0] for r in rows])
    ids, times = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    units = np.frombuffer(b"".join(r[3] for r in rows), np.float64).reshape(len(rows), -1)
    keys = np.array([r[4] for r in rows], np.int32)[:, :table]
    left = np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    if not len(left) or not len(right):
        return
    links = np.zeros(len(rows), np.int64)
    lowest = np.arange(len(rows))
    for start in range(0, len(left), 256):
        part = left[start:start + 256]
        x, y = np.nonzero(units[part] @ units[right].T >= least_cosine - 1e-9)
        a, b = part[x], right[y]
        keep = a < b if same else np.ones(len(a), bool)
        a, b = a[keep], b[keep]
        if table:
            new = np.ones(len(a), bool)
            for from_ in range(0, len(a), 1 << 18):
                piece = slice(from_, from_ + (1 << 18))
                new[piece] = (keys[a[piece]] != keys[b[piece]]).all(axis=1)
            a, b = a[new], b[new]
        # on the edge, one sum in one order decides, wherever a pair is met
        cosine = np.concatenate([
            (units[a[f:f + 4096]] * units[b[f:f + 4096]]).sum(axis=1) for f in range(0, len(a), 4096)] or [np.zeros(0)])
        a, b = a[cosine >= least_cosine], b[cosine >= least_cosine]
        np.add.at(links, a, times[b])
        np.add.at(links, b, times[a])
        while len(apart := np.flatnonzero(lowest[a] != lowest[b])):
            a, b = a[apart], b[apart]
            least = np.minimum(lowest[a], lowest[b])
            np.minimum.at(lowest, lowest[a], least)
            np.minimum.at(lowest, lowest[b], least)
            while not np.array_equal(lowest, lowest[lowest]):
                lowest = lowest[lowest]
    found = np.flatnonzero(links)
    if len(found):
        to = lowest[found]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[found]), pa.array(links[found]), pa.array(ids[to], mask=to == found)], schema=_FOUND)


def near_vectors(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label",
                 least_cosine: float = LEAST_COSINE, missed: float = MISSED) -> DataFrame:
    """(id, n_links, component_id, kept) of every row of vectors.

    Vectors of one label are linked if their cosine in double precision is at
    least ``least_cosine``. Null labels, and vectors that are null, empty, zero
    or hold null, NaN or infinite components, link with nothing; so do vectors
    of different widths with each other. component_id is the smallest id
    reachable by links. Rows with a null id have no links and no component and
    are kept. Repeated rows link with each other and stay repeated. An empty
    table gives no rows.

    Pairs just at the threshold are missed with a chance of ``missed`` at most.
    Equal vectors, by 128 bits, are one row until the end; they aren't expanded into pairs.
    Buckets are cut into blocks of bounded size and every two blocks meet, so a
    bucket's rows are neither capped nor gathered.
    """
    usable = (
        F.col("label").isNotNull() & F.col("id").isNotNull() & (F.size("vector") > 0)
        & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
        & F.exists("vector", lambda v: v != 0)
    )
    rows = vectors.select(
        F.col(id_column).cast("long").alias("id"), F.col(label).cast("string").alias("label"),
        # -0.0 and 0.0 are one value
        F.transform(vector, lambda v: v.cast("double") + F.lit(0.0)).alias("vector"))
    digest = F.when(F.coalesce(usable, F.lit(False)), F.struct(
        F.xxhash64("label", "vector").alias("x"), F.xxhash64(F.lit(1), "vector", "label").alias("y")))
    marked = written(rows.withColumn("digest", digest), "vectors")
    classes = marked.where("digest is not null").groupBy("digest").agg(
        F.min("id").alias("least"), F.count(F.lit(1)).alias("n"),
        F.first("label").alias("label"), F.first("vector").alias("vector"))
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = table_shape(largest, least_cosine, missed)

    # an id may stand for several vectors: classes have numbers of their own, which the written table fixes
    keyed = written(
        _keyed(classes.select("least", "digest.*", "label", "n", "vector"), bits, tables)
        .withColumn("id", F.monotonically_increasing_id()), "vector-keys")
    bands = keyed.select("label", "width", "id", "n", "unit", "keys", F.posexplode("keys").alias("table", "key"))
    bucket = ["label", "table", "width", "key"]
    sizes = bands.groupBy(*bucket).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    blocks = F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(1)), blocks).cast("int")
    dealt = (
        bands.join(sizes, bucket).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(
            *bucket, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
            (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "n", "unit", "keys")
    )
    found = written(_compared(dealt, least_cosine), "vector-links")
    linked = found.groupBy("id").agg(F.sum("links").alias("links"))
    # from classes to ids: all members of a class share its links and each other
    ids = keyed.select("id", F.struct("x", "y").alias("digest"), "least", "n")
    per_class = ids.join(linked, "id", "left").select(
        "digest", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    least = ids.select("id", "least")
    edges = found.where("to is not null").select("id", "to").join(least, "id").select(
        F.col("least").alias("a"), "to").join(least.select(F.col("id").alias("to"), F.col("least").alias("b")), "to").select("a", "b")
    copies = marked.where("digest is not null").join(ids.select("digest", "least"), "digest").where(
        "id <> least").select(F.col("id").alias("a"), F.col("least").alias("b"))
    components = connected_components(edges.unionByName(copies))
    return (
        marked.select("id", "digest").join(per_class.drop("least"), "digest", "left")
        .join(components, F.col("id") == F.col("node"), "left")
        .select(
            F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(True)))
    )
