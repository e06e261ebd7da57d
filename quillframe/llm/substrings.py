"""Repeated passages across documents by seeds and extension.

A winnowed anchor is the run of ``GRAM_WORDS`` words with the least hash in a
window. Neighbouring windows share their anchor, and all that choose one make a
seed, whose context is the words they cover. Seeds meet by their anchors. A seed
whose context was there before is a repeat as a whole. Where an anchor has
several contexts, repeats end inside them: there the first seed of each context
is extended, word by word, to the windows it has in common with others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from quillframe.scratch import written

#: Words of a repeat, at least, and of an anchor.
WINDOW_WORDS, GRAM_WORDS = 20, 6
#: Window starts whose anchors are looked for at a time.
BLOCK_WORDS = 1 << 20
PIECE_BYTES = 4 << 20
#: Words whose hashes a worker remembers.
MEMORY_WORDS = 500_000

SPANS = "array<struct<start: int, length: int>>"

_WHITE = frozenset(b" \t\n\r\x0b\x0c")
_K, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_word_hash = _WordHashes().__getitem__


def pieces_of(data: bytes) -> Iterator[list[bytes]]:
    """Words of UTF-8 bytes, unchanged, in lists of bounded length."""
    at = 0
    while at < len(data):
        end = min(at + PIECE_BYTES, len(data))
        while end < len(data) and data[end - 1] not in _WHITE:
            end += 1
        yield data[at:end].split()
        at = end


def word_hashes(data: bytes) -> np.ndarray:
    parts = [np.fromiter(map(_word_hash, words), np.uint64, len(words)) for words in pieces_of(data)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _runs_at(words: np.ndarray, starts: np.ndarray, size: int, factor: np.uint64) -> np.ndarray:
    """Hashes of the runs of ``size`` words from each start on."""
    found = np.zeros(len(starts), np.uint64)
    for i in range(size):
        found = found * factor + words[starts + i]
    return _mixed(found)


def _least_in(values: np.ndarray, size: int) -> np.ndarray:
    """Place of the first least value among the ``size`` from each place on."""
    place, span = np.arange(len(values)), 1
    while span < size:
        step = min(span, size - span)
        left, right = place[:-step], place[step:]
        place = np.where(values[right] < values[left], right, left)
        span += step
    return place


@lru_cache(maxsize=2)
def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the factor and of its inverse, modulo 2**64."""
    factors = np.full(count, _K, np.uint64), np.full(count, pow(int(_K), -1, 1 << 64), np.uint64)
    for f in factors:
        f[0] = 1
    return tuple(np.multiply.accumulate(f) for f in factors)


def seeds_of(words: np.ndarray, owner: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(first window, number of windows, anchor, context) of each seed.

    ``owner`` says whose a word is; no window reaches from one to another.
    """
    found = []
    powers, inverse = _powers(BLOCK_WORDS + window)
    for low in range(0, len(words) - window + 1, BLOCK_WORDS):
        part, whose = words[low:low + BLOCK_WORDS + window - 1], owner[low:low + BLOCK_WORDS + window - 1]
        starts = np.flatnonzero(whose[:len(part) - window + 1] == whose[window - 1:])
        if not len(starts):
            continue
        grams = _runs_at(part, np.arange(len(part) - gram + 1), gram, _K)
        place = _least_in(grams, window - gram + 1)[starts]
        opens = np.ones(len(starts), bool)
        opens[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(opens)
        count = np.diff(np.append(first, len(starts)))
        begin, place = starts[first], place[first]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * powers[:len(part)])])
        region = (sums[begin + count - 1 + window] - sums[begin]) * inverse[begin]
        shape = count.astype(np.uint64) * np.uint64(window) + (place - begin).astype(np.uint64)
        found.append((begin + low, count, grams[place], _mixed(region ^ _mixed(shape))))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(column) for column in zip(*found))


def _late(keys: tuple[np.ndarray, ...], rank: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rows of which one with the same keys stands earlier by (rank, start)."""
    order = np.lexsort((start, rank, *keys))
    opens = np.zeros(len(order), bool)
    opens[:1] = True
    for column in keys:
        opens[1:] |= column[order[1:]] != column[order[:-1]]
    first = order[np.maximum.accumulate(np.where(opens, np.arange(len(order)), 0))]
    found = np.zeros(len(order), bool)
    found[order] = (rank[order] != rank[first]) | (start[order] != start[first])
    return found


def _joined(total: int, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of places that overlap or touch as one; (begin, count) of each."""
    turn = np.zeros(total + 1, np.int32)
    np.add.at(turn, begin, 1)
    np.add.at(turn, begin + count, -1)
    edges = np.flatnonzero(np.diff((np.cumsum(turn) > 0).astype(np.int8), prepend=0))
    return edges[::2], edges[1::2] - edges[::2]


class _Batch:
    """The words of a batch of documents, one after the other."""

    def __init__(self, ids: pa.Array, texts: list[bytes]):
        self.rank = pc.rank(ids, "ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
        hashes = [word_hashes(t) for t in texts]
        count = np.array([len(h) for h in hashes], np.int64)
        self.words = np.concatenate([np.zeros(0, np.uint64), *hashes])
        self.begins = np.cumsum(count) - count
        self.owner = np.repeat(np.arange(len(texts)), count)

    def rows(self, columns: list[pa.Array], key1, key2, at, windows, late, names) -> pa.RecordBatch:
        """Rows for the places that aren't known to be repeats, and joined rows for those that are."""
        known, size = _joined(len(self.words), at[late], windows[late])
        place = np.concatenate([at[~late], known])
        doc = self.owner[place]
        none = np.zeros(len(known), np.uint64)
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([key1[~late], _mixed(known.astype(np.uint64))]).view(np.int64)),
            pa.array(np.concatenate([key2[~late], none]).view(np.int64)),
            *[c.take(pa.array(doc)) for c in columns],
            pa.array((place - self.begins[doc]).astype(np.int32)),
            pa.array(np.concatenate([windows[~late], size]).astype(np.int32)),
            pa.array(np.concatenate([np.zeros((~late).sum(), bool), np.ones(len(known), bool)])),
        ], names=names)


def _found_schema(docs: DataFrame, keys: bool) -> StructType:
    fields = StructType.fromDDL("start int, windows int, late boolean").fields
    key = StructType.fromDDL("key1 bigint, key2 bigint").fields if keys else []
    return StructType([*key, docs.schema["id"], docs.schema["text_id"], *fields])


class _Firsts:
    """Goes through rows sorted by (key1, key2, id, start), batch by batch, and
    tells which have an earlier one with the same keys."""

    def __init__(self):
        self.keys = self.id = self.start = None

    def mark(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(late, opens): ``opens`` marks the first row of a pair of keys."""
        key1, key2, ids, start = (batch.column(c) for c in ("key1", "key2", "id", "start"))
        key1, key2, start = key1.to_numpy(), key2.to_numpy(), start.to_numpy()
        opens = np.ones(len(key1), bool)
        opens[1:] = (key1[1:] != key1[:-1]) | (key2[1:] != key2[:-1])
        opens[0] = self.keys != (key1[0], key2[0])
        first = np.maximum.accumulate(np.where(opens, np.arange(len(key1)), -1))
        code = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
        late = (code != code[first]) | (start != start[first])
        before = first < 0
        if before.any():
            same = pc.index_in(ids, value_set=self.id).is_valid().to_numpy(zero_copy_only=False)
            late[before] = (~same | (start != self.start))[before]
        if first[-1] >= 0:
            self.keys, self.id, self.start = (key1[-1], key2[-1]), ids.slice(int(first[-1]), 1), start[first[-1]]
        return late, opens


def _without_keys(batch: pa.RecordBatch, late: np.ndarray | None = None) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n not in ("key1", "key2")]
    columns = [pa.array(late) if n == "late" and late is not None else batch.column(n) for n in names]
    return pa.RecordBatch.from_arrays(columns, names=names)


def match_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seeds sorted by anchor and context: repeats, and seeds to be extended.

    Of an anchor with one context nothing more than the context can repeat. The
    first seed of the anchor waits until a second context turns up.
    """
    firsts, anchor, contexts, waiting = _Firsts(), None, 0, []
    for batch in batches:
        known = batch.column("late")
        if pc.any(known).as_py():
            yield _without_keys(batch.filter(known))
        batch = batch.filter(pc.invert(known))
        if not batch.num_rows:
            continue
        late, opens = firsts.mark(batch)
        if late.any():
            yield _without_keys(batch.filter(pa.array(late)), np.ones(late.sum(), bool))
        key = batch.column("key1").to_numpy()
        change = np.ones(len(key), bool)
        change[1:] = key[1:] != key[:-1]
        change[0] = key[0] != anchor
        group = np.cumsum(change)  # 0: the anchor that the last batch ended with
        number = np.bincount(group, weights=opens, minlength=group[-1] + 1).astype(np.int64)
        number[0] += contexts
        if number[0] > 1:
            yield from (_without_keys(b) for b in waiting)
        several = number > 1
        chosen = ~late & several[group]
        if chosen.any():
            yield _without_keys(batch.filter(pa.array(chosen)))
        if group[-1] > 0 or several[0]:
            waiting = []
        if not several[-1]:
            waiting.append(batch.filter(pa.array(~late & (group == group[-1]))))
        anchor, contexts = key[-1], int(min(number[-1], 2))


def match_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows sorted by their hashes: those that are repeats."""
    firsts = _Firsts()
    for batch in batches:
        known = batch.column("late")
        if pc.any(known).as_py():
            yield _without_keys(batch.filter(known))
        batch = batch.filter(pc.invert(known))
        if batch.num_rows and (late := firsts.mark(batch)[0]).any():
            yield _without_keys(batch.filter(pa.array(late)), np.ones(late.sum(), bool))


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("key1").sortWithinPartitions("key1", "key2", "id", "start")


def _bytes_of(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _packed(docs: DataFrame) -> DataFrame:
    """Texts compressed, since they are shuffled as they are; null ones stay null."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary())
            packed = pa.array([None if x is None else press(x) for x in texts.to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], names=[*batch.schema.names[:-1], "packed"])

    return docs.mapInArrow(pack, StructType([*docs.schema.fields[:-1], StructField("packed", BinaryType())]))


def _unpack(column: pa.Array) -> list[bytes]:
    """Texts of a column of packed ones; a null text has no words."""
    expand = zstandard.ZstdDecompressor().decompress
    return [b"" if x is None else expand(x) for x in column.to_pylist()]


def _seeds(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Seeds of all documents; what repeats inside a batch is known at once."""
    schema = _found_schema(docs, keys=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = _Batch(batch.column("id"), _bytes_of(batch.column("text")))
            at, windows, anchor, context = seeds_of(held.words, held.owner, window, gram)
            doc = held.owner[at]
            late = _late((context, anchor), held.rank[doc], at - held.begins[doc])
            columns = [batch.column("id"), batch.column("text_id")]
            yield held.rows(columns, anchor, context, at, windows, late, schema.names)

    return docs.mapInArrow(run, schema)


def _extended(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """Every window of the seeds to be extended, by two hashes of its words."""
    schema = _found_schema(docs, keys=True)
    lists = wanted.groupBy("id", "text_id").agg(
        F.collect_list(F.struct("start", "windows")).alias("seeds")).select(
        F.col("id").alias("of"), F.col("text_id").alias("of_text"), "seeds")
    both = _packed(docs).join(
        lists, F.col("id").eqNullSafe(F.col("of")) & (F.col("text_id") == F.col("of_text"))).drop("of", "of_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            held = _Batch(batch.column("id"), _unpack(batch.column("packed")))
            seeds = batch.column("seeds")
            owner = seeds.value_parent_indices().to_numpy()
            begin = seeds.flatten().field("start").to_numpy().astype(np.int64) + held.begins[owner]
            count = seeds.flatten().field("windows").to_numpy().astype(np.int64)
            at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
            keys = [_runs_at(held.words, at, window, k) for k in (_K, _K2)]
            doc = held.owner[at]
            late = _late(tuple(keys), held.rank[doc], at - held.begins[doc])
            yield held.rows([batch.column("id"), batch.column("text_id")], *keys, at, np.ones(len(at), np.int64), late, schema.names)

    return both.mapInArrow(run, schema)


def repeated_windows(docs: DataFrame, window: int = WINDOW_WORDS, gram: int = GRAM_WORDS) -> DataFrame:
    """(id, text_id, start, windows): starts of windows that are there earlier.

    ``docs`` has (id, text_id, text), where ``text_id`` tells texts of one id
    apart. ``windows`` consecutive ones begin at ``start``.
    """
    matched = written(
        _in_order(_seeds(docs, window, gram)).mapInArrow(match_seeds, _found_schema(docs, keys=False)), "seeds")
    inside = _in_order(_extended(docs, matched.where(~F.col("late")), window)).mapInArrow(
        match_windows, _found_schema(docs, keys=False))
    return matched.where("late").unionByName(inside).drop("late")


def keep_words(data: bytes, begin: np.ndarray, count: np.ndarray, window: int) -> tuple[int, list[dict], bytes]:
    """(number of words, spans in repeated windows, the other words joined by a space)."""
    size = count + (window - 1)
    begin, size = _joined(int((begin + size).max(initial=0)), begin, size)
    spans = list(zip(begin.tolist(), (begin + size).tolist()))
    kept, at, k = [], 0, 0
    for words in pieces_of(data):
        here, end = at, at + len(words)
        while k < len(spans) and spans[k][0] < end:
            start, stop = spans[k]
            if start > here:
                kept.append(b" ".join(words[here - at:start - at]))
            here = min(stop, end)
            if stop > end:
                break
            k += 1
        if here < end:
            kept.append(b" ".join(words[here - at:]))
        at = end
    return at, [{"start": s, "length": e - s} for s, e in spans], b" ".join(kept)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   window: int = WINDOW_WORDS, gram: int = GRAM_WORDS) -> DataFrame:
    """Every document with its n_words, the ``removed`` spans, and ``kept`` in place of its text.

    A window is ``window`` consecutive words of one document. It repeats if the
    same words start earlier: in a document of a smaller id, or further in front
    of the same one. Words of repeated windows are removed, and the others joined
    by one space; all windows are judged on the texts as they come.

    A null text has no words, like an empty one, and its kept text is empty; a
    text shorter than a window keeps all words. A null id is smaller than all
    others. Rows of one id are judged as one document by their ids and starts:
    equal rows keep the same words, and windows of equal starts don't remove each
    other. Columns of the added names are replaced, others stay whatever their
    names; without rows there are no rows.

    Words are compared by 64-bit hashes, windows of extended seeds by 128 bits;
    two different contexts around one anchor are taken for equal with a chance
    of 2**-64.
    """
    if not 0 < gram <= window:
        raise ValueError("an anchor has at least one word and at most those of a window")
    base = docs.select(
        F.col(doc_id).alias("id"), F.hash(F.col(text)).alias("text_id"), F.col(text).alias("text"))
    repeats = repeated_windows(base, window, gram).groupBy("id", "text_id").agg(
        F.collect_list(F.struct("start", "windows")).alias("repeats")).select(
        F.col("id").alias("of"), F.col("text_id").alias("of_text"), "repeats")
    added = StructType.fromDDL(f"n_words bigint, removed {SPANS}, kept string")
    own = [c for c in docs.columns if c not in added.names and c != text]
    # the other columns travel as one, so none of them can clash
    rows = _packed(docs.select(
        F.struct(*own).alias("row"), F.col(doc_id).alias("id"), F.hash(F.col(text)).alias("text_id"),
        F.col(text).alias("text")))
    both = rows.join(
        repeats, F.col("id").eqNullSafe(F.col("of")) & (F.col("text_id") == F.col("of_text")), "left"
    ).select("row", "packed", "repeats")
    schema = StructType([both.schema["row"], *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            lists, found = batch.column("repeats"), []
            for i, data in enumerate(_unpack(batch.column("packed"))):
                begin = count = none
                if lists[i].is_valid:
                    begin, count = (lists[i].values.field(c).to_numpy().astype(np.int64) for c in ("start", "windows"))
                found.append(keep_words(data, begin, count, window))
            n_words, removed, kept = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([
                batch.column("row"),
                pa.array(n_words, pa.int64()),
                pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))),
                pa.array(kept, pa.binary()).cast(pa.string()),
            ], names=schema.names)

    return both.mapInArrow(run, schema).select("row.*", *added.names)
