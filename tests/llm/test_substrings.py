"""Repeated passages against all windows in one dictionary."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF_DIR

from quillframe.llm import queries, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(rows, window=20):
    """(id, n_words, spans, kept) of (id, text) rows, sorted."""
    first = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    order = lambda i: (i is not None, i if i is not None else 0)
    for i, words in split:
        for p in range(len(words) - window + 1):
            key, place = tuple(words[p:p + window]), (order(i), p)
            first[key] = min(first.get(key, place), place)
    found = []
    for i, words in split:
        gone = set()
        for p in range(len(words) - window + 1):
            if first[tuple(words[p:p + window])] < (order(i), p):
                gone.update(range(p, p + window))
        spans = [p for p in sorted(gone) if p - 1 not in gone], [p for p in sorted(gone) if p + 1 not in gone]
        found.append((i, len(words), [(s, e - s + 1) for s, e in zip(*spans)],
                      " ".join(w for p, w in enumerate(words) if p not in gone)))
    return sorted(found, key=repr)


def found(spark, rows, schema="doc_id bigint, text string", **options):
    out = substrings.remove_repeats(spark.createDataFrame(rows, schema), **options)
    return sorted(((r.doc_id, r.n_words, [tuple(s) for s in r.removed], r.kept) for r in out.collect()), key=repr)


@pytest.fixture
def small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("seed, words, window, gram", [(1, 2, 4, 2), (2, 3, 5, 3), (3, 6, 4, 1), (4, 3, 3, 3)])
def test_few_words_many_repeats(spark, small_batches, seed, words, window, gram):
    choose = random.Random(seed)
    rows = [(i, " ".join(choose.choice("abcdefgh"[:words]) for _ in range(choose.randrange(40)))) for i in range(60)]
    assert found(spark, rows, window=window, gram=gram) == slow(rows, window)


def test_passages_copies_and_edits(spark):
    choose = random.Random(5)
    text = lambda n: " ".join(f"w{choose.randrange(10_000)}" for _ in range(n))
    passage, line, copied = text(60), text(21), text(120).split()
    rows = [(i, text(choose.randrange(80)) + f"  {passage}\n" + text(30)) for i in range(10)]
    rows += [(100 - i, f"{text(i)}\t{line} {text(25)} {line}") for i in range(30)]
    for i in range(20):
        edited = list(copied)
        edited[choose.randrange(120)] = "edit"
        rows.append((200 + i, " ".join(edited)))
    rows += [(300 + i, " ".join(copied)) for i in range(5)]
    choose.shuffle(rows)
    assert found(spark, rows) == slow(rows)
    assert sum(len(r[2]) for r in slow(rows)) > 50


def test_runs_of_one_word_and_long_texts(spark):
    rows = [(1, "the " * 5000), (2, "the " * 19), (3, "x " + "the " * 21), (4, "a b " * 3000 + "c"), (5, "b a " * 40),
            (6, " ".join(f"q{i}" for i in range(300_000))), (7, " ".join(f"q{i}" for i in range(250_000, 250_100)))]
    assert found(spark, rows) == slow(rows)


def test_nulls_short_texts_repeated_rows_and_equal_ids(spark):
    text = " ".join(map(str, range(30)))
    rows = [(None, text), (None, None), (1, ""), (2, None), (3, " \t\n"), (4, text), (4, text), (5, "z " + text),
            (5, "y y " + text), (5, "z " + text), (6, " ".join("ab") + "\x00 é"), (7, " ".join(map(str, range(19))))]
    assert found(spark, rows) == slow(rows)


def test_no_rows_and_clashing_columns(spark):
    names = "id text_id row packed of of_text repeats key1 key2 start windows late removed kept".split()
    schema = "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names)
    assert found(spark, [], schema) == []
    text = " ".join(map(str, range(25)))
    rows = [(i, text) for i in range(3)]
    out = substrings.remove_repeats(spark.createDataFrame([(*r, *names) for r in rows], schema))
    assert out.columns == ["doc_id", *names[:-2], "n_words", "removed", "kept"]
    assert [tuple(r)[1:-3] for r in out.collect()] == [tuple(names[:-2])] * 3
    assert sorted((r.doc_id, r.kept) for r in out.collect()) == [(0, text), (1, ""), (2, "")]


def test_every_window_holds_its_anchor_and_seeds_share_out_the_windows(monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK_WORDS", 64)
    substrings._powers.cache_clear()
    choose = random.Random(9)
    words = np.array([choose.randrange(30) for _ in range(500)], np.uint64)
    owner = np.repeat([0, 1, 2, 3], [200, 19, 21, 260])
    at, count, _, _ = substrings.seeds_of(words, owner, 20, 6)
    starts = np.concatenate([np.arange(a, a + c) for a, c in zip(at, count)])
    assert starts.tolist() == [p for p in range(481) if owner[p] == owner[p + 19]]
    substrings._powers.cache_clear()


def test_pieces_end_between_words(monkeypatch):
    monkeypatch.setattr(substrings, "PIECE_BYTES", 5)
    data = "aé  bb\tccc ddddddddd e".encode()
    assert [w for part in substrings.pieces_of(data) for w in part] == data.split()
    begin, count = np.array([1, 3]), np.array([1, 1])
    assert substrings.keep_words(data, begin, count, 1) == (
        5, [{"start": 1, "length": 1}, {"start": 3, "length": 1}], "aé ccc e".encode())


def sorted_batches(rows, size):
    rows = sorted(rows, key=lambda r: (r["key1"], r["key2"], r["id"] is not None, r["id"] or 0, r["start"]))
    return [pa.RecordBatch.from_pylist(rows[i:i + size], pa.schema([
        ("key1", pa.int64()), ("key2", pa.int64()), ("id", pa.int64()), ("text_id", pa.int32()), ("start", pa.int32()),
        ("windows", pa.int32()), ("late", pa.bool_())])) for i in range(0, len(rows), size)]


@pytest.mark.parametrize("size", [1, 2, 3, 1000])
def test_seeds_of_a_frequent_anchor_pass_in_batches_of_any_size(size):
    choose = random.Random(size)
    rows = [dict(key1=choose.choice([1, 1, 1, 2, choose.randrange(3, 9)]), key2=choose.randrange(3), windows=1, text_id=0,
                 id=choose.choice([None, *range(20)]), start=choose.randrange(3), late=False) for _ in range(200)]
    out = [r for b in substrings.match_seeds(iter(sorted_batches(rows, size))) for r in b.to_pylist()]
    place = lambda r: (r["id"] is not None, r["id"] or 0, r["start"])
    groups, anchors, expected = {}, {}, []
    for r in rows:
        groups.setdefault((r["key1"], r["key2"]), []).append(place(r))
        anchors.setdefault(r["key1"], set()).add(r["key2"])
    for r in rows:
        late = place(r) > min(groups[r["key1"], r["key2"]])
        if late or len(anchors[r["key1"]]) > 1:
            expected.append((*place(r), late))
    assert sorted((*place(r), r["late"]) for r in out) == sorted(expected)


def test_query_against_all_windows(spark):
    from hashlib import sha256
    docs = queries.table(spark, SF_DIR, "documents").select("doc_id", "text").collect()
    expected = {i: (n, sum(s for _, s in spans), sha256(kept.encode()).hexdigest()) for i, n, spans, kept in slow(map(tuple, docs))}
    got = {r[0]: tuple(r)[1:] for r in queries.op13_substring_dedup(spark, SF_DIR).collect()}
    assert got == expected
