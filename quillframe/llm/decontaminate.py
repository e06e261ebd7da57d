"""Benchmark decontamination by suffix arrays of the training texts.

A batch of documents is a shard. The shard's words become numbers, its suffix
array is sorted, and the windows of all benchmark texts are looked up in it by
binary search. Found occurrences are followed to their longest verbatim match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType,
)

from quillframe.llm.files import shared_file
from quillframe.scratch import scratch_path

WINDOW_WORDS = 13
#: A document is contaminated if one word in so many, or more, is hit.
ONE_IN = 20
#: Words of benchmark texts that a task holds at a time.
BLOCK_WORDS = 1_000_000
#: Bytes of a text whose words are made at a time.
PIECE_BYTES = 4 << 20

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_WORD_BYTES = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(128, 256))

ADDED = [
    StructField("n_words", LongType()),
    StructField("n_hit", LongType()),
    StructField("items", ArrayType(StringType())),
    StructField("longest_words", IntegerType()),
    StructField("spans", ArrayType(StructType([StructField("start", IntegerType()), StructField("length", IntegerType())]))),
    StructField("contaminated", BooleanType()),
]


def words_of(data: bytes) -> Iterator[list[bytes]]:
    """Lower-cased words of UTF-8 bytes, in lists of bounded length."""
    at = 0
    while at < len(data):
        end = min(at + PIECE_BYTES, len(data))
        piece = data[at:end].lower()
        while end < len(data) and piece[-1] in _WORD_BYTES:
            more = data[end:end + 4096].lower()
            cut = next((i for i, b in enumerate(more) if b not in _WORD_BYTES), len(more) - 1)
            piece, end = piece + more[:cut + 1], end + cut + 1
        yield _WORD.findall(piece)
        at = end


class Block:
    """Some benchmark texts: their words as numbers, and their distinct windows."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        numbers, windows = [0], {}
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            first, size = len(numbers), min(window, len(ids))
            numbers += [*ids, 0]
            for p in range(len(ids) - size + 1):
                windows.setdefault(tuple(ids[p:p + size]), []).append((item, first + p))
        self.numbers = np.array(numbers, np.int32)
        self.items = [sorted({i for i, _ in owners}) for owners in windows.values()]
        self.ends = np.flatnonzero(self.numbers == 0)
        owners = [np.unique(np.searchsorted(self.ends, [p for _, p in o])) for o in windows.values()]
        self.owners = np.array([len(o) for o in owners], np.int64)
        self.texts = np.concatenate([np.zeros(0, np.int64), *owners])
        self.begins = np.cumsum(self.owners) - self.owners
        self.sizes = np.array([len(w) for w in windows], np.int64)
        self.words = np.zeros((len(windows), window), np.int32)
        for row, w in zip(self.words, windows):
            row[:len(w)] = w
        self.depth = max([len(w) for _, w in items], default=0)

    def texts_with(self, rows: np.ndarray) -> np.ndarray:
        """Numbers of the words of all texts that have one of these windows, a 0 before each."""
        each = self.owners[rows]
        at = np.arange(each.sum()) + np.repeat(self.begins[rows] - (np.cumsum(each) - each), each)
        texts = np.unique(self.texts[at])
        return np.concatenate([np.zeros(0, np.int32), *(self.numbers[self.ends[t - 1]:self.ends[t]] for t in texts.tolist())])


def _blocks(store: fs.FileSystem, path: str, window: int, block_words: int) -> Iterator[Block]:
    """The stored benchmark texts, a bounded number of words at a time."""
    held, count = [], 0
    for found in sorted(store.get_file_info(fs.FileSelector(path)), key=lambda f: f.path):
        if not found.path.endswith(".parquet"):
            continue
        with store.open_input_file(found.path) as file:
            for batch in pq.ParquetFile(file).iter_batches(batch_size=1024):
                for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    words = [w for part in words_of((text or "").encode()) for w in part]
                    if not words:
                        continue
                    held.append((item, words))
                    count += len(words)
                    if count >= block_words:
                        yield Block(held, window)
                        held, count = [], 0
    if held:
        yield Block(held, window)


def suffix_array(numbers: np.ndarray, depth: int) -> np.ndarray:
    """Places sorted by the ``depth`` numbers from them on, by prefix doubling."""
    rank, step = numbers.astype(np.int64), 1
    while True:
        follow = np.zeros(len(rank), np.int64)
        follow[:-step] = rank[step:]
        values, rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + follow, return_inverse=True)
        step *= 2
        if step >= depth or len(values) == len(rank):
            return np.argsort(rank, kind="stable")


def longest_common(texts: np.ndarray, starts: np.ndarray, others: np.ndarray) -> np.ndarray:
    """For every start in ``texts``, how far the longest match in ``others`` goes.

    Zeros match nothing. Both are sorted as one suffix array by prefix doubling;
    the longest match of a suffix is with the nearest of ``others`` before or
    after it. How far two suffixes agree is read off the ranks of all doublings,
    from the longest step down, so time and memory grow with the words and not
    with the pairs that match.
    """
    joint = np.concatenate([texts, np.zeros(1, texts.dtype), others, np.zeros(1, texts.dtype)]).astype(np.int64)
    zero = np.flatnonzero(joint == 0)
    joint[zero] = joint.max(initial=0) + 1 + np.arange(len(zero))
    ranks, step = [np.unique(joint, return_inverse=True)[1]], 1
    while ranks[-1].max(initial=0) + 1 < len(joint) and step < len(joint):
        follow = np.zeros(len(joint), np.int64)
        follow[:-step] = ranks[-1][step:] + 1
        ranks.append(np.unique(ranks[-1] * (len(joint) + 1) + follow, return_inverse=True)[1])
        step *= 2
    order = np.argsort(ranks[-1], kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    other = order > len(texts)
    before = np.maximum.accumulate(np.where(other, np.arange(len(order)), -1))
    after = np.minimum.accumulate(np.where(other, np.arange(len(order)), len(order))[::-1])[::-1]
    longest = np.zeros(len(starts), np.int64)
    for near in (before[place[starts]], after[place[starts]]):
        found = (near >= 0) & (near < len(order))
        a, b = starts[found], order[near[found]]
        begin = a.copy()
        for level in range(len(ranks) - 1, -1, -1):
            inside = (a < len(joint)) & (b < len(joint))
            same = np.zeros(len(a), bool)
            same[inside] = ranks[level][a[inside]] == ranks[level][b[inside]]
            a, b = a + (same << level), b + (same << level)
        longest[found] = np.maximum(longest[found], a - begin)
    return longest


def _edge(numbers: np.ndarray, order: np.ndarray, block: Block, rows: np.ndarray, upper: bool) -> np.ndarray:
    """For every window the first place in ``order`` not before it, or after all that begin with it."""
    low, high = np.zeros(len(rows), np.int64), np.full(len(rows), len(order), np.int64)
    wanted, sizes = block.words[rows], block.sizes[rows]
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) // 2
        at = order[middle]
        before = np.zeros(len(open_), bool)
        equal = np.ones(len(open_), bool)
        for k in range(wanted.shape[1]):
            here = numbers[np.minimum(at + k, len(numbers) - 1)]
            there = wanted[open_, k]
            live = equal & (k < sizes[open_])
            before |= live & (here < there)
            equal &= ~live | (here == there)
        if upper:
            before |= equal
        low[open_] = np.where(before, middle + 1, low[open_])
        high[open_] = np.where(before, high[open_], middle)
    return low


class Shard:
    """Hits of a batch of texts; blocks of benchmark texts come one after the other."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.n_words = np.zeros(len(texts), np.int64)
        self.hits: np.ndarray | None = None
        self.items: list[set[str]] = [set() for _ in texts]
        self.longest = np.zeros(len(texts), np.int64)

    def _numbers(self, vocabulary: dict[bytes, int]) -> np.ndarray:
        """Words of all texts, 0 for those that no benchmark text has, and a 0 after each text."""
        parts = []
        for i, text in enumerate(self.texts):
            count = 0
            for words in words_of(text):
                parts.append(np.fromiter(map(vocabulary.get, words, repeat(0)), np.int32, len(words)))
                count += len(words)
            parts.append(np.zeros(1, np.int32))
            self.n_words[i] = count
        self.first = np.concatenate([[0], np.cumsum(self.n_words + 1)])
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def search(self, block: Block) -> None:
        numbers = self._numbers(block.vocabulary)
        if self.hits is None:
            self.hits = np.zeros(len(numbers) + 1, bool)
        if not len(numbers) or not len(block.sizes):
            return
        # Only runs of benchmark words at least as long as a window can hold one:
        # suffixes that begin elsewhere can't match and are left out of the array.
        edge = np.flatnonzero(np.diff((numbers != 0).astype(np.int8), prepend=0, append=0))
        begin, end = edge[::2], edge[1::2]
        long = end - begin >= block.sizes.min()
        begin, end = begin[long], end[long]
        if not len(begin):
            return
        size = end - begin + 1  # with the 0 behind each run
        offset = np.cumsum(size) - size
        source = np.arange(size.sum()) + np.repeat(begin - offset, size)
        runs = numbers[source]
        runs[offset + size - 1] = 0
        order = suffix_array(runs, block.depth)
        known = np.zeros(len(block.vocabulary) + 1, bool)
        known[runs] = True
        known[0] = True  # also fills up short windows
        rows = np.flatnonzero(known[block.words].all(axis=1))
        if not len(rows):
            return
        low, high = (_edge(runs, order, block, rows, upper) for upper in (False, True))
        found = high > low
        rows, low, high = rows[found], low[found], high[found]
        if not len(rows):
            return
        count = high - low
        row = np.repeat(rows, count)
        at = order[np.arange(count.sum()) + np.repeat(low - (np.cumsum(count) - count), count)]
        place = source[at]
        turn = np.zeros(len(self.hits) + 1, np.int32)
        np.add.at(turn, place, 1)
        np.add.at(turn, place + block.sizes[row], -1)
        self.hits |= np.cumsum(turn)[:-1] > 0
        doc = np.searchsorted(self.first, place, side="right") - 1
        for d, w in np.unique(np.stack([doc, row], axis=1), axis=0).tolist():
            self.items[d].update(block.items[w])
        # a short text ends with its window; others go on, and match on from there
        size = block.sizes[row]
        full = size == block.words.shape[1]
        size[full] = longest_common(runs, at[full], block.texts_with(np.unique(row[full])))
        np.maximum.at(self.longest, doc, size)

    def columns(self, one_in: int) -> list[pa.Array]:
        hits = self.hits if self.hits is not None else np.zeros(0, bool)
        n_hit, spans = [], []
        for i in range(len(self.texts)):
            own = hits[self.first[i]:self.first[i] + self.n_words[i]] if len(hits) else hits
            n_hit.append(int(own.sum()))
            edges = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)) if n_hit[-1] else []
            spans.append([{"start": int(s), "length": int(e - s)} for s, e in zip(edges[::2], edges[1::2])])
        if self.hits is None:  # without benchmark texts nothing has been counted yet
            self._numbers({})
        total = self.n_words.tolist()
        return [
            pa.array(total, pa.int64()), pa.array(n_hit, pa.int64()),
            pa.array([sorted(x) for x in self.items], pa.list_(pa.string())),
            pa.array(self.longest.tolist(), pa.int32()),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))),
            pa.array([h > 0 and one_in * h >= n for h, n in zip(n_hit, total)], pa.bool_()),
        ]


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                       item_text: str = "text", window: int = WINDOW_WORDS, one_in: int = ONE_IN,
                       block_words: int = BLOCK_WORDS) -> DataFrame:
    """Adds to every document which benchmark texts it holds and where.

    n_words, n_hit (words inside an occurrence of a window), items (ids as
    sorted strings), longest_words (longest verbatim match), spans of hit words
    (start and length in words), contaminated. Words are runs of letters,
    digits and non-ASCII characters with A-Z lower-cased. A text shorter than a
    window is one window. Null and empty texts have no words and are clean; a
    null item id counts as empty; repeated rows are judged alike; an empty
    benchmark hits nothing. Columns of the added names are replaced.

    Benchmark texts are written to shared storage once, and every task goes
    through them in blocks of bounded size, so nothing is broadcast and their
    number isn't limited.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "benchmark")
    benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text"),
    ).write.parquet(path)
    names = {f.name for f in ADDED}
    kept = [c for c in docs.columns if c not in names]
    schema = StructType([*(docs.schema[c] for c in kept), *ADDED])
    places, text_place = [docs.columns.index(c) for c in kept], docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = shared_file(path)
        only: list[Block] = []  # kept if there is just one
        for batch in batches:
            shard = Shard([x or b"" for x in batch.column(text_place).cast(pa.binary()).to_pylist()])
            if only:
                shard.search(only[0])
            else:
                count = 0
                for block in _blocks(store, root, window, block_words):
                    shard.search(block)
                    count += 1
                    only = [block] if count == 1 else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(p) for p in places] + shard.columns(one_in), names=schema.names)

    return docs.mapInArrow(run, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that aren't contaminated, with their own columns."""
    found = find_contamination(docs.select("*"), benchmark, **options)
    return found.where(~F.col("contaminated")).select(*docs.columns)
