"""Language identification by mixtures of languages within a document.

Letter trigrams give each word a likelihood in every language. Expectation
maximisation estimates the proportions of languages in a document, and the set
of languages is the one of largest penalised likelihood.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quillframe.llm.files import shared_file
from quillframe.scratch import scratch_path

#: Trigrams share this many counters; so do their first two letters.
SLOTS = 1 << 16
#: Labelled documents of each language that the counts are taken from, about.
SAMPLE_DOCUMENTS = 3000
#: Weight of the even distribution mixed into each conditional probability.
SMOOTHING = 2.0
LETTERS = 64.0
ITERATIONS, TOLERANCE = 25, 1e-3
#: Characters that are scored at a time.
PIECE_CHARS = 1 << 20
UNDETERMINED = "und"

ADDED = [StructField("lang_pred", StringType()), StructField("lang_score", DoubleType())]


def letter_table() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Grams:
    """Slots of the letters of lower-cased texts."""

    def __init__(self):
        self.letters = letter_table()

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Trigram slot and context slot of each letter, and where words begin among them."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(self.letters[codes], codes, 0).astype(np.uint64)
        padded = np.concatenate([np.zeros(2, np.uint64), codes, np.zeros(1, np.uint64)])
        # a letter after a boundary has no letter two before it
        one, here = padded[1:-1], padded[2:]
        two = np.where(one == 0, 0, padded[:-2])
        context = two * np.uint64(0x9E3779B97F4A7C15) + one * np.uint64(0xC2B2AE3D27D4EB4F)
        whole = context + here * np.uint64(0x165667B19E3779F9)
        # a boundary after a word counts as its last letter
        used = (here != 0) | (one != 0)
        shift = np.uint64(48)
        mix = lambda x: ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> shift
        starts = np.flatnonzero((here != 0) & (one == 0))
        places = np.cumsum(used) - 1
        return mix(whole[used]).astype(np.int64), mix(context[used]).astype(np.int64), places[starts]


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces that end between words."""
    at = 0
    while at < len(text):
        end = min(at + PIECE_CHARS, len(text))
        while end < len(text) and text[end - 1].isalpha():
            end += 1
        yield text[at:end]
        at = end


def log_likelihoods(grams: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Log of each trigram's chance after its context; counts are slots by languages.

    Returned as two tables whose difference it is: trigram minus context.
    """
    return (
        np.log(grams + SMOOTHING / LETTERS).astype(np.float32),
        np.log(contexts + SMOOTHING).astype(np.float32),
    )


def mixtures(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the chosen languages for each document.

    ``words`` has a row of log likelihoods for each word, ``first`` the first
    word of each document; every document has a word.
    """
    top = words.max(axis=1, keepdims=True)
    chance = np.exp(words - top)
    size = np.diff(np.append(first, len(words)))
    document = np.repeat(np.arange(len(first)), size)

    def fitted(share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each document stops by its own change, so it doesn't matter which others are there."""
        live, own, of, starts, count = np.arange(len(first)), chance, document, first, size
        for _ in range(ITERATIONS):
            before = share[live]
            each = own * before[of]
            total = each.sum(axis=1, keepdims=True)
            share[live] = np.add.reduceat(each / np.maximum(total, 1e-30), starts) / count[:, None]
            moved = np.abs(share[live] - before).max(axis=1) >= TOLERANCE
            if not moved.any():
                break
            if not moved.all():
                live, own, count = live[moved], own[moved[of]], count[moved]
                of, starts = np.repeat(np.arange(len(live)), count), np.cumsum(count) - count
        total = np.maximum((chance * share[document]).sum(axis=1), 1e-30)
        return share, np.add.reduceat(np.log(total), first)

    languages = words.shape[1]
    every, _ = fitted(np.full((len(first), languages), 1 / languages))
    order = np.argsort(-every, axis=1, kind="stable")
    best, worth = None, None
    for k in range(1, languages + 1):
        allowed = np.zeros((len(first), languages))
        np.put_along_axis(allowed, order[:, :k], 1 / k, axis=1)
        share, likelihood = fitted(allowed)
        penalised = likelihood - 0.5 * (k - 1) * np.log(size)
        if best is None:
            best, worth = share, penalised
            continue
        better = penalised > worth
        best[better], worth[better] = share[better], penalised[better]
    return best, worth


class Model:
    """Trigram tables of the learned languages."""

    def __init__(self, languages: list[str], grams: np.ndarray, contexts: np.ndarray):
        self.languages = languages
        self.whole, self.context = log_likelihoods(grams, contexts)
        self.slots = Grams()

    def words(self, text: str) -> np.ndarray:
        """Log likelihood of each word of a text in every language."""
        parts = []
        for piece in _pieces(text.lower()):
            grams, contexts, starts = self.slots.of(piece)
            if len(starts):
                parts.append(np.add.reduceat(self.whole[grams] - self.context[contexts], starts))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)), np.float32)

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        """Language and its proportion for each text."""
        held, sizes = [], []

        def scored() -> Iterator[tuple[str, float]]:
            full = [w for w in held if len(w)]
            shares = iter(())
            if full:
                first = np.cumsum([0, *(len(w) for w in full[:-1])])
                shares = iter(mixtures(np.concatenate(full), first)[0])
            for words in held:
                if not len(words):
                    yield UNDETERMINED, 0.0
                else:
                    share = next(shares)
                    yield self.languages[int(share.argmax())], float(min(1.0, share.max()))

        # short texts are taken together, their characters in one array
        for text in texts:
            words = self.words(text) if text and self.languages else np.zeros((0, max(1, len(self.languages))), np.float32)
            held.append(words)
            sizes.append(len(words))
            if sum(sizes) >= PIECE_CHARS // 8:
                yield from scored()
                held, sizes = [], []
        yield from scored()


def learn(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang",
          sample_documents: int = SAMPLE_DOCUMENTS, id_column: str = "doc_id") -> str:
    """Counts trigrams by language; returns the shared folder they are in.

    Only rows that are ``usable``, with a text and a language, are read. Of each
    language about ``sample_documents`` are taken, chosen by a hash of id and
    text, each with its whole text. Counters are summed before the shuffle, and
    their number is bounded by slots and languages.
    """
    spark = docs.sparkSession
    rows = docs.where(usable & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(id_column), F.col(text)).alias("place"))
    # A count for each language, which the plan has as literals: texts are not shuffled by so few keys.
    totals = [x for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect() for x in (r.lang, r.n)]
    n = F.create_map(*map(F.lit, totals))[F.col("lang")] if totals else F.lit(1)
    sample = rows.where(
        F.pmod("place", F.lit(1 << 30)) < F.lit(sample_documents) / n * (1 << 30)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, sums = Grams(), {}
        for batch in batches:
            for own, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tables = sums.setdefault(own, np.zeros((2, SLOTS), np.int64))
                for piece in _pieces(value.lower()):
                    grams, contexts, _ = slots.of(piece)
                    tables[0] += np.bincount(grams, minlength=SLOTS)
                    tables[1] += np.bincount(contexts, minlength=SLOTS)
        for own, tables in sums.items():
            kind, slot = np.nonzero(tables)
            yield pa.RecordBatch.from_arrays(
                [pa.array([own] * len(slot), pa.string()), pa.array(kind.astype(np.int32)), pa.array(slot.astype(np.int32)),
                 pa.array(tables[kind, slot])], names=["lang", "kind", "slot", "n"])

    path = scratch_path(spark, "language-counts")
    (sample.mapInArrow(count, "lang string, kind int, slot int, n long")
     .groupBy("lang", "kind", "slot").agg(F.sum("n").alias("n")).write.parquet(path))
    return path


def load(path: str) -> Model:
    """The model of a folder of counts."""
    store, root = shared_file(path)
    files = [f.path for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet")]
    tables = []
    for name in sorted(files):
        with store.open_input_file(name) as file:
            tables.append(pq.read_table(file))
    counts = pa.concat_tables(tables) if tables else None
    values = counts.column("lang").to_numpy() if counts else np.zeros(0, object)
    languages = sorted(set(values))
    found = np.zeros((2, SLOTS, len(languages)))
    if languages:
        place = np.searchsorted(np.array(languages, object), values)
        found[counts.column("kind").to_numpy(), counts.column("slot").to_numpy(), place] = counts.column("n").to_numpy()
    return Model(languages, *found)


def identify(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Adds lang_pred and lang_score, the proportion of that language's words.

    Null texts and texts without a letter are ``und`` with score 0, and so is
    everything if nothing was learned. Ties go to the first language by name.
    Whole texts are read, rows stay as they are, columns of the added names are
    replaced.
    """
    kept = [c for c in docs.columns if c not in {f.name for f in ADDED}]
    schema = StructType([*(docs.schema[c] for c in kept), *ADDED])
    places, text_place = [docs.columns.index(c) for c in kept], docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            model = model or load(model_path)
            found = list(model.predict(batch.column(text_place).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(p) for p in places), pa.array([x for x, _ in found], pa.string()),
                 pa.array([y for _, y in found], pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)
