"""BPE encoding and decoding with the files of public tokenizers.

A word is a doubly linked list of symbols. Merges wait in a priority queue by
rank and place; an entry whose symbols have changed since is stale and skipped.
Decoding concatenates the strings of the vocabulary.
"""

from __future__ import annotations

import heapq
import json
import struct
import sys
import types
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

#: Words and parts of words whose ids a worker remembers; the older half is dropped beyond it.
CACHE_WORDS = 300_000
#: Result bytes after which a task passes a batch on.
BATCH_BYTES = 16 << 20

#: Characters that ``str.split`` takes for white space and the pattern does not.
_NOT_SPACE = regex.compile("[\x1c-\x1f]")

# What the library's tables have beyond Unicode 15.1, as first and last
# code points. Found by splitting every single code point with \p{L} and \p{N} and
# lower-casing it.
NEWER_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
    (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
    (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
    (0x1E5F0, 0x1E5F0),
]
NEWER_NUMBERS = [
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
    (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
]
#: Capitals as first, last and the first one's small letter.
NEWER_CAPITALS = [
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B),
    (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
]
# Marks, and one vowel sign, that the library's NFC doesn't know. It neither
# moves them nor joins anything across them.
UNMOVED = [
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C),
    (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27),
    (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070),
    (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E),
    (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99),
    (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1),
    (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
]
_UNMOVED = regex.compile("([" + "".join(f"{chr(first)}-{chr(last)}" for first, last in UNMOVED) + "])")
_NEWER_SMALL = {c: small + c - first for first, last, small in NEWER_CAPITALS for c in range(first, last + 1)}


def _known(c: str) -> str:
    """A character of the library's class of ``c``: itself, or a letter, number or sign for one Python doesn't know."""
    if unicodedata.category(c) != "Cn":
        return c
    within = lambda runs: any(first <= ord(c) <= last for first, last in runs)
    return "a" if within(NEWER_LETTERS) else "0" if within(NEWER_NUMBERS) else "\ue000"


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(extra)) for b in range(256)]


class _Words(dict):
    """Packed ids by word, computed when missing, in two generations."""

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.limit, self.older = compute, max(2, limit) // 2, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.compute(word)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Tokenizer:
    """Encodes and decodes as a tokenizer file says.

    Reads the parts that such a file may have of these kinds: NFC, white space
    and lower-case normalizers, a split pattern whose matches are kept, byte
    level characters, a BPE model with an end-of-word suffix, added tokens that
    are searched in the raw text, no decoder. Another part raises ValueError.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        parts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        steps = [p["type"] for p in parts]
        split, level = parts if len(parts) == 2 else ({}, {})
        known = (
            kinds == ["NFC", "Replace", "Lowercase"] and steps == ["Split", "ByteLevel"]
            and split["invert"] and split["behavior"] == "Removed"
            and not level["add_prefix_space"] and not level["use_regex"]
            and model["type"] == "BPE" and not model["continuing_subword_prefix"] and not model["byte_fallback"]
            and not model["dropout"] and not model["ignore_merges"] and spec["decoder"] is None
            and not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        )
        if not known:
            raise ValueError(f"{path} asks for steps that aren't covered")
        self.vocabulary: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        v = self.vocabulary
        self.merges = {(v[a], v[b]): (rank, v[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [""] * (1 + max([*v.values(), *self.added.values()]))
        for text, i in [*v.items(), *self.added.items()]:
            self.strings[i] = text
        self._pattern = regex.compile(split["pattern"]["Regex"])
        self._added = regex.compile("|".join(map(regex.escape, self.added))) if self.added else None
        characters = byte_characters()
        self._ids = [v[c] for c in characters]
        self._last_ids = [v[c + self.suffix] for c in characters]
        self._words = _Words(self._word, cache_words)

    def encode(self, text: str) -> bytes:
        """Ids of a text, packed as little-endian unsigned 32-bit integers."""
        if self._added is None or not self._added.search(text):
            return self._plain(text)
        parts, at = [], 0
        for found in self._added.finditer(text):
            parts += [self._plain(text[at:found.start()]), self.added[found.group()].to_bytes(4, "little")]
            at = found.end()
        return b"".join([*parts, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """The vocabulary's strings of packed ids, with spaces between them."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = "".join(unicodedata.normalize("NFC", part) for part in _UNMOVED.split(text))
            # lower-cased one by one: a final sigma isn't treated apart
            text = text.replace("Σ", "σ")
        text = text.lower()
        # No match of the pattern holds white space, so words can be taken one by one.
        words = text.split() if not _NOT_SPACE.search(text) else regex.split(r"\p{White_Space}+", text)
        return b"".join(map(self._words.__getitem__, words))

    def _word(self, word: str) -> bytes:
        if word.isalpha():
            return self._piece(word)  # one match of the pattern
        known = word
        if not word.isascii():
            word = word.translate(_NEWER_SMALL)
            known = "".join(map(_known, word))
        parts = [word[m.start():m.end()] for m in self._pattern.finditer(known)]
        # a part that is split again stays whole, so words and parts share one memory
        return self._piece(word) if len(parts) == 1 else b"".join(map(self._words.__getitem__, parts))

    def _piece(self, piece: str) -> bytes:
        ids = self._merged(piece)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _merged(self, piece: str) -> list[int]:
        """Ids of one piece, by the merges of least rank first, leftmost among equals."""
        data = piece.encode("utf-8")
        symbol = [self._ids[b] for b in data]
        symbol[-1] = self._last_ids[data[-1]]
        n = len(symbol)
        if n < 2:
            return symbol
        find, push, pop = self.merges.get, heapq.heappush, heapq.heappop
        right = [*range(1, n), -1]
        left = [*range(-1, n - 1)]
        queue = [
            (found[0], i, found[1], a, b)
            for i, (a, b) in enumerate(zip(symbol, symbol[1:])) if (found := find((a, b)))
        ]
        heapq.heapify(queue)
        while queue:
            _, i, joined, first, second = pop(queue)
            j = right[i]
            if symbol[i] != first or j < 0 or symbol[j] != second:
                continue  # stale
            symbol[i], symbol[j] = joined, -1
            right[i] = after = right[j]
            if after >= 0:
                left[after] = i
                if found := find((joined, symbol[after])):
                    push(queue, (found[0], i, found[1], joined, symbol[after]))
            before = left[i]
            if before >= 0 and (found := find((symbol[before], joined))):
                push(queue, (found[0], before, found[1], symbol[before], joined))
        return [s for s in symbol if s >= 0]


def opened(path: str) -> Tokenizer:
    """One tokenizer for each worker and file, with its memory of words.

    The package's functions travel by value and are new in every task, so what
    a worker keeps between tasks is held beside them.
    """
    memory = sys.modules.setdefault("_quillframe_worker", types.ModuleType("_quillframe_worker")).__dict__
    if path not in memory:
        memory[path] = Tokenizer(path)
    return memory[path]


def _with_columns(df: DataFrame, source: str, added: list[StructField], compute) -> DataFrame:
    """Adds computed columns to all others, passing on bounded batches."""
    kept = [c for c in df.columns if c not in {f.name for f in added}]
    schema = StructType([*(df.schema[c] for c in kept), *added])
    place = df.columns.index(source)
    places = [df.columns.index(c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, made, start, held = batch.column(place), [], 0, 0
            for i, value in enumerate(values):
                made.append(compute(value.as_py()))
                held += sum(len(x) for x in made[-1] if isinstance(x, (bytes, str)))
                if held >= BATCH_BYTES or i + 1 == len(values):
                    rows = batch.slice(start, i + 1 - start)
                    arrays = [rows.column(p) for p in places]
                    types = {BinaryType: pa.binary(), StringType: pa.string(), LongType: pa.int64()}
                    arrays += [pa.array(x, types[type(f.dataType)]) for x, f in zip(zip(*made), added)]
                    yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
                    made, start, held = [], i + 1, 0

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds token_ids (packed little-endian unsigned 32-bit integers) and n_tokens.

    A null text is an empty one, which has no tokens. A column of those names is
    replaced. ``path`` names the tokenizer's file on every executor.
    """
    def compute(value):
        ids = opened(path).encode(value or "")
        return ids, len(ids) // 4

    return _with_columns(
        df, text, [StructField("token_ids", BinaryType()), StructField("n_tokens", LongType())], compute)


def decode(df: DataFrame, path: str, token_ids: str = "token_ids") -> DataFrame:
    """Adds decoded, the text of packed ids; null ids are an empty text."""
    return _with_columns(
        df, token_ids, [StructField("decoded", StringType())],
        lambda ids: (opened(path).decode(ids or b""),))
