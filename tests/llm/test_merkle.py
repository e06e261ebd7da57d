"""Merkle manifest against a tree built in one piece."""

import random
import zlib
from hashlib import sha256

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from quillframe.llm import merkle, queries

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, more=0):
    row = dict(row)
    if row["n_chars"] is not None:
        row["n_chars"] += more
    return digest(*["-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS])


def tree_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def steps_in(levels, at):
    for level in levels[:-1]:
        yield level[at & ~1:(at | 1) + 1], at & 1
        at >>= 1


def slow(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append((row["doc_id"] is not None, row["doc_id"] or 0, leaf_of(row), row))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree_of([leaf for _, _, leaf, _ in sorted(groups[g], key=lambda r: r[:3])]) for g in groups}
    top = tree_of([trees[g][-1][0] for g in order])
    root = top[-1][0]
    found = []
    for place, group in enumerate(order):
        for at, (_, _, leaf, row) in enumerate(sorted(groups[group], key=lambda r: r[:3])):
            hit = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0
            now, siblings = leaf_of(row, 1 if hit else 0), []
            for run, own in [*steps_in(trees[group], at), *steps_in(top, place)]:
                siblings += [n for i, n in enumerate(run) if i != own]
                now = digest(*[now if i == own else n for i, n in enumerate(run)])
            found.append((row["doc_id"], leaf, trees[group][-1][0], root, digest(*siblings), now, now == root))
    return sorted(found, key=repr)


def found(spark, data, schema=SCHEMA, **options):
    out = queries.manifest_of(spark.createDataFrame(data, schema), **options)
    return sorted((tuple(r) for r in out.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def as_dicts(data):
    return [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in data]


@pytest.mark.parametrize("bits, count", [(1, 1), (1, 17), (2, 2), (2, 16), (2, 33), (10, 5)])
def test_any_size_of_tree_and_block(spark, bits, count):
    choose = random.Random(count)
    data = [(i, f"text {i} é", "en" if i % 3 else choose.choice(["fr", "de", None, ""]), "s", i) for i in range(count)]
    assert found(spark, data, block_bits=bits) == slow(as_dicts(data))


def test_superblocks_of_a_hot_group_and_many_groups(spark):
    data = [(i, f"t{i}", "en" if i % 3 else f"l{i}", None, i if i % 5 else None) for i in range(4000)]
    assert found(spark, data) == slow(as_dicts(data))


def test_nulls_empty_texts_ties_and_repeated_rows(spark):
    data = [(None, None, None, None, None), (None, "a", None, "s", 1), (7, "", "", "", 0), (7, "", "", "", 0),
            (7, "b", "", "s", 1), (8, "x" * 2_000_000, "en", "s", 2_000_000), (-1, "ä\x00", "en", "s", 2)]
    assert found(spark, data) == slow(as_dicts(data))


def test_no_rows_and_clashing_columns(spark):
    assert found(spark, []) == []
    names = "tree pos hash leaf root again key block path group subroot verified".split()
    data = [(i, f"t{i}", "en", "s", 2, *["x"] * len(names)) for i in range(9)]
    schema = SCHEMA + "".join(f", {n} string" for n in names)
    assert found(spark, data, schema) == slow(as_dicts(r[:5] for r in data))


def test_paths_lead_to_the_root_and_tell_a_changed_row(spark):
    docs = queries.table(spark, SF_DIR, "documents")
    out = merkle.manifest(docs, "doc_id", "lang", FIELDS, {"text": F.when(F.col("doc_id") == 3, F.lit("other")).otherwise(F.col("text"))})
    for row in out.collect():
        assert merkle.fold(row.leaf.encode(), merkle.unpack_path(bytes(row.path))).decode() == row.root
        assert row.verified == (row.doc_id != 3)


def test_every_tampered_document_of_the_query_is_found(spark):
    rows = [r.asDict() for r in queries.table(spark, SF_DIR, "documents").collect()]
    expected = {r[0]: r[1:] for r in slow(rows)}
    got = {r[0]: tuple(r)[1:] for r in queries.op12_merkle_manifest(spark, SF_DIR).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()}
    assert got == expected
    assert 0 < sum(not r[-1] for r in got.values()) < len(got)
