"""Merkle manifest of a dataset: a proof for every row, checked against a second reading.

Rows are the leaves of one tree per group, and the roots of the groups are the
leaves of one tree above them. Leaves are numbered by a range sort and cut into
superblocks of ``1 << block_bits``. Going up, each superblock is reduced to one
node, and these are the leaves of the next level. Going down, the nodes of a
superblock meet the path of that one node to the root in a cogroup, which
finishes reduction, proofs and folding together.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillframe.scratch import written

#: A superblock has so many leaves at most, as a power of two.
BLOCK_BITS = 10
DIGEST = 32
#: Sides of a step of a path: alone in its run, or where its sibling stands.
ALONE, LEFT, RIGHT = 0, 1, 2

NODE = "tree string, pos bigint, hash binary"
OUTER = "tree string, pos bigint, path binary, subroot string, root string"
PROVED = ("key string, leaf string, subroot string, root string, proof_sha256 string, path binary, "
          "folded_root string, verified boolean")


def field_text(column: str | Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(columns: Sequence[str | Column]) -> Column:
    """SHA-256 of the fields, as hexadecimal text."""
    return F.sha2(F.concat(*[field_text(c) for c in columns]).cast("binary"), 256)


def _parent(nodes: Sequence[bytes]) -> bytes:
    """Digest of a run of digests, all as hexadecimal text."""
    return sha256(b"".join(nodes)).hexdigest().encode()


def levels_of(nodes: list[bytes], first: bool, bits: int) -> list[list[bytes]]:
    """The nodes of a superblock and of every level above, up to its one node.

    The ``first`` superblock of a tree has that many nodes, or it is the whole
    tree and ends with its root. Others go up all levels, so that a single node
    at the end of a tree is hashed alone as often as its neighbours are paired.
    """
    levels = [nodes]
    while len(levels[-1]) > 1 or not first and len(levels) <= bits:
        below = levels[-1]
        levels.append([_parent(below[i:i + 2]) for i in range(0, len(below), 2)])
    return levels


def steps_of(levels: list[list[bytes]], place: int) -> list[tuple[int, bytes]]:
    """(side, sibling) of every level from a leaf up to the superblock's node."""
    steps = []
    for level in levels[:-1]:
        other = place ^ 1
        steps.append((ALONE, b"") if other >= len(level) else (LEFT if place & 1 else RIGHT, level[other]))
        place >>= 1
    return steps


def pack_path(steps: Sequence[tuple[int, bytes]]) -> bytes:
    return b"".join(bytes([side]) + bytes.fromhex(sibling.decode()) for side, sibling in steps)


def unpack_path(path: bytes) -> list[tuple[int, bytes]]:
    steps, at = [], 0
    while at < len(path):
        side, end = path[at], at + 1 + (DIGEST if path[at] != ALONE else 0)
        steps.append((side, path[at + 1:end].hex().encode()))
        at = end
    return steps


def fold(leaf: bytes, steps: Sequence[tuple[int, bytes]]) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for side, sibling in steps:
        leaf = _parent([sibling, leaf] if side == LEFT else [leaf, sibling] if side == RIGHT else [leaf])
    return leaf


def _numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``pos``, from 0 on in each ``tree`` in the order of the columns.

    A range sort deals out the rows, whatever share one tree has. Only the tree
    that a sorted slot begins with can have rows in earlier slots, so one offset
    a slot is sent to the tasks.
    """
    schema = StructType([*rows.schema, StructField("_slot", LongType()), StructField("_at", LongType())])
    tree_place = rows.columns.index("tree")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slot, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            trees = batch.column(tree_place)
            runs = pc.run_end_encode(trees)
            ends = np.asarray(runs.run_ends)
            begins = np.concatenate([[0], ends[:-1]])
            at = np.arange(batch.num_rows) - np.repeat(begins, ends - begins)
            if trees[0].as_py() == last:
                at[:ends[0]] += count
            last, count = trees[-1].as_py(), int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(batch.num_rows, slot), pa.int64()), pa.array(at, pa.int64())],
                names=schema.names)

    keys = ["tree", *order]
    numbered = written(
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(number, schema), "merkle-leaves")
    before = Window.partitionBy("tree").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(numbered.groupBy("tree", "_slot").agg(F.count(F.lit(1)).alias("_rows")).select(
        "tree", "_slot", F.sum("_rows").over(before).alias("_before")).where("_before > 0"), "merkle-offsets")
    return numbered.join(F.broadcast(offsets), ["tree", "_slot"], "left").select(
        *rows.columns, (F.col("_at") + F.coalesce("_before", F.lit(0))).alias("pos"))


def _block(bits: int) -> Column:
    return F.shiftright(F.col("pos"), bits).alias("block")


def _levels_of_block(nodes: pd.DataFrame, bits: int) -> list[list[bytes]]:
    """Levels of a superblock whose nodes are sorted by ``pos``."""
    return levels_of([h.hex().encode() for h in nodes["hash"]], nodes["pos"].iloc[0] == 0, bits)


def _levels(leaves: DataFrame, bits: int) -> list[DataFrame]:
    """Leaves (tree, pos, hash), then one node a superblock, up to one node a tree."""

    def reduced(key: tuple, nodes: pd.DataFrame) -> pd.DataFrame:
        top = _levels_of_block(nodes.sort_values("pos"), bits)[-1][0]
        return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "hash": [bytes.fromhex(top.decode())]})

    levels = [leaves.select("tree", "pos", "hash")]
    while (levels[-1].agg(F.max("pos")).first()[0] or 0) > 0:
        levels.append(written(levels[-1].groupBy("tree", _block(bits)).applyInPandas(reduced, NODE), "merkle-nodes"))
    return levels


def _outer_of_block(nodes: pd.DataFrame, outer: pd.DataFrame, bits: int) -> tuple[list[list[bytes]], list, str, str]:
    above = outer.iloc[0]
    return _levels_of_block(nodes, bits), unpack_path(above["path"]), above["subroot"], above["root"]


def _inner_paths(nodes: pd.DataFrame, outer: pd.DataFrame, bits: int) -> pd.DataFrame:
    nodes = nodes.sort_values("pos")
    levels, above, subroot, root = _outer_of_block(nodes, outer, bits)
    paths = [pack_path(steps_of(levels, i) + above) for i in range(len(nodes))]
    return pd.DataFrame({"tree": nodes["tree"], "pos": nodes["pos"], "path": paths, "subroot": subroot, "root": root})


def _met(nodes: DataFrame, outer: DataFrame, bits: int, finish, schema: str) -> DataFrame:
    """Applies ``finish`` to each superblock of nodes and the path above it."""
    above = outer.select(F.col("tree").alias("of"), F.col("pos").alias("at"), "path", "subroot", "root")
    return nodes.groupBy("tree", _block(bits)).cogroup(above.groupBy("of", "at")).applyInPandas(
        lambda a, b: finish(a, b, bits), schema)


def _descend(levels: list[DataFrame], outer: DataFrame, bits: int) -> DataFrame:
    """From the paths of the trees' roots to those of the superblocks of leaves."""
    for nodes in levels[-2:0:-1]:
        outer = _met(nodes, outer, bits, _inner_paths, OUTER)
    return outer


def _group_paths(groups: pd.DataFrame, outer: pd.DataFrame, bits: int) -> pd.DataFrame:
    """For each group's tree, its subroot and the path from there to the root."""
    groups = groups.sort_values("pos")
    levels, above, _, root = _outer_of_block(groups, outer, bits)
    return pd.DataFrame({
        "tree": groups["group"], "pos": 0, "subroot": [h.hex() for h in groups["hash"]], "root": root,
        "path": [pack_path(steps_of(levels, i) + above) for i in range(len(groups))]})


def _proved(leaves: pd.DataFrame, outer: pd.DataFrame, bits: int) -> pd.DataFrame:
    """Local reduction, proofs and folding of one superblock."""
    leaves = leaves.sort_values("pos")
    levels, above, subroot, root = _outer_of_block(leaves, outer, bits)
    proofs, paths, folded = [], [], []
    for i, again in enumerate(leaves["again"]):
        steps = steps_of(levels, i) + above
        proofs.append(sha256(b"".join(sibling for _, sibling in steps)).hexdigest())
        paths.append(pack_path(steps))
        folded.append(fold(again.hex().encode(), steps).decode())
    return pd.DataFrame({
        "key": leaves["key"], "leaf": [h.decode() for h in levels[0]], "subroot": subroot, "root": root,
        "proof_sha256": proofs, "path": paths, "folded_root": folded, "verified": [f == root for f in folded]})


def manifest(rows: DataFrame, key: str, group: str, fields: Sequence[str],
             read_again: Mapping[str, Column] | None = None, block_bits: int = BLOCK_BITS) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, path, folded_root, verified) of every row.

    A leaf is the digest of ``fields``; leaves of a ``group`` stand by ``key``,
    and groups by their text's UTF-8 bytes, the null group first. ``path`` packs
    the sides and siblings up to the root, and ``proof_sha256`` is the digest of
    these siblings. ``read_again`` replaces fields by what a later reading of
    the rows has; ``folded_root`` is what that leaf leads to with the siblings
    of the manifest, and ``verified`` says whether it is the root.

    Null keys come first in their group, and rows of equal keys go by their
    leaves, so that repeated rows have one leaf each, next to each other. A null
    group is a group of its own, unlike an empty one. Null fields are ``-``,
    empty ones ``0:``. The only row of a group is its subroot, the only group's
    subroot is the root. Without rows there are no rows. Columns that aren't
    named don't count, whatever their names.
    """
    again = [(read_again or {}).get(f, F.col(f)) for f in fields]
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = _numbered(
        written(rows.select(
            tree.alias("tree"), F.col(key).alias("key"),
            F.unhex(leaf_digest(fields)).alias("hash"), F.unhex(leaf_digest(again)).alias("again")), "merkle-rows"),
        ["key", "hash"])
    levels = _levels(leaves, block_bits)
    groups = _numbered(levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("group"), "hash"), ["group"])
    forest = _levels(groups, block_bits)
    top = forest[-1].select(
        "tree", "pos", F.lit(b"").alias("path"), F.lit("").alias("subroot"), F.lower(F.hex("hash")).alias("root"))
    roots = _met(groups, _descend(forest, top, block_bits), block_bits, _group_paths, OUTER)
    outer = written(_descend(levels, roots, block_bits), "merkle-paths")
    texts = leaves.withColumn("key", F.col("key").cast("string"))
    return _met(texts, outer, block_bits, _proved, PROVED).withColumn(
        "key", F.col("key").cast(rows.schema[key].dataType)).withColumnRenamed("key", key)
