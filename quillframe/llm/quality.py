"""Text quality by a convolutional network over bytes, in numpy.

Filters of eight bytes run over the whole document. Their largest responses in
overlapping chunks go through a small hidden layer, whose mean and largest
values over all chunks give one probability.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from numpy.lib.stride_tricks import sliding_window_view
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillframe.llm.files import shared_file
from quillframe.scratch import scratch_path

#: Labelled documents of each class that are learned from, at most.
SAMPLE_PER_CLASS = 1500
#: Longer texts aren't learned from; they are scored like any other.
SAMPLE_TEXT_BYTES = 200_000
FILTERS, WIDTH, HIDDEN = 24, 8, 24
#: Half a chunk; chunks overlap by one half.
BLOCK = 256
EPOCHS, BATCH_DOCUMENTS, RATE, DECAY = 10, 32, 4e-3, 1e-4
#: Blocks whose responses are held at a time.
GROUP = 64
#: Bytes of texts that are cut into blocks at a time.
PIECE_BYTES = 1 << 20
SEED = 7
SCORE = StructField("quality_score", DoubleType())


def blocks_of(data: bytes) -> np.ndarray:
    """Rows of ``BLOCK`` bytes and the few that follow them, filled up with zeros."""
    n = max(1, -(-len(data) // BLOCK))
    padded = np.zeros(n * BLOCK + WIDTH - 1, np.uint8)
    padded[:len(data)] = np.frombuffer(data, np.uint8)
    return sliding_window_view(padded, BLOCK + WIDTH - 1)[::BLOCK]


def fill_of(size: int) -> np.ndarray:
    """Share of each chunk's bytes that a text of ``size`` bytes has.

    A short chunk has small largest responses for want of bytes; the hidden
    layer can tell that from a chunk that says one thing over and over.
    """
    n = max(1, -(-size // BLOCK))
    starts = np.arange(max(1, n - 1)) * BLOCK
    return (np.minimum(size - starts, 2 * BLOCK) / (2 * BLOCK)).astype(np.float32)


class Network:
    """Parameters: tap tables (width, 256, filters), a hidden layer and an output layer."""

    def __init__(self, parameters: dict[str, np.ndarray]):
        self.p = parameters

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Network:
        return cls({
            "taps": rng.normal(0, 0.35, (WIDTH, 256, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "hidden": rng.normal(0, 0.3, (FILTERS + 1, HIDDEN)).astype(np.float32),
            "hidden_bias": np.zeros(HIDDEN, np.float32),
            "out": rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32),
            "out_bias": np.zeros(1, np.float32),
        })

    def pairs(self) -> list[np.ndarray]:
        """Two taps as one table over pairs of bytes."""
        taps = self.p["taps"]
        return [(taps[k][:, None, :] + taps[k + 1][None, :, :]).reshape(1 << 16, -1) for k in range(0, WIDTH, 2)]

    @staticmethod
    def responses(blocks: np.ndarray, pairs: list[np.ndarray], places: bool):
        """Largest response of each filter in each block, and where it is."""
        best = np.empty((len(blocks), pairs[0].shape[1]), np.float32)
        at = np.empty(best.shape, np.int64) if places else None
        for start in range(0, len(blocks), GROUP):
            part = blocks[start:start + GROUP].astype(np.uint16)
            codes = (part[:, :-1] << 8) | part[:, 1:]
            total = pairs[0][codes[:, :BLOCK]]
            for k in range(1, len(pairs)):
                total += pairs[k][codes[:, 2 * k:2 * k + BLOCK]]
            if places:
                where = total.argmax(axis=1)
                at[start:start + GROUP] = where
                best[start:start + GROUP] = np.take_along_axis(total, where[:, None, :], 1)[:, 0]
            else:
                best[start:start + GROUP] = total.max(axis=1)
        return best, at

    def logit(self, best: np.ndarray, size: int) -> float:
        """Log odds of one document from its blocks' responses and its bytes."""
        chunks = np.maximum(best[:-1], best[1:]) if len(best) > 1 else best
        seen = np.concatenate([np.maximum(chunks + self.p["bias"], 0), fill_of(size)[:, None]], axis=1)
        hidden = np.maximum(seen @ self.p["hidden"] + self.p["hidden_bias"], 0)
        doc = np.concatenate([hidden.mean(axis=0), hidden.max(axis=0)])
        return float(doc @ self.p["out"] + self.p["out_bias"][0])


def _step(net: Network, docs: list[np.ndarray], sizes: list[int], labels: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean log loss of some documents."""
    p, grads = net.p, {k: np.zeros_like(v) for k, v in net.p.items()}
    blocks = np.concatenate(docs)
    best, at = Network.responses(blocks, net.pairs(), True)
    back = np.zeros_like(best)
    first = 0
    for doc, size, label in zip(docs, sizes, labels):
        own = best[first:first + len(doc)]
        if len(own) > 1:
            later = own[1:] > own[:-1]
            chunks = np.where(later, own[1:], own[:-1])
        else:
            later, chunks = None, own
        seen = np.concatenate([np.maximum(chunks + p["bias"], 0), fill_of(size)[:, None]], axis=1)
        hidden = np.maximum(seen @ p["hidden"] + p["hidden_bias"], 0)
        top = hidden.argmax(axis=0)
        feature = np.concatenate([hidden.mean(axis=0), hidden.max(axis=0)])
        error = (1 / (1 + np.exp(-(feature @ p["out"] + p["out_bias"][0]))) - label) / len(docs)
        grads["out"] += error * feature
        grads["out_bias"] += error
        to_hidden = np.repeat(error * p["out"][None, :HIDDEN] / len(hidden), len(hidden), axis=0)
        to_hidden[top, np.arange(HIDDEN)] += error * p["out"][HIDDEN:]
        to_hidden *= hidden > 0
        grads["hidden"] += seen.T @ to_hidden
        grads["hidden_bias"] += to_hidden.sum(axis=0)
        to_seen = ((to_hidden @ p["hidden"].T) * (seen > 0))[:, :-1]
        grads["bias"] += to_seen.sum(axis=0)
        if later is None:
            back[first:first + 1] += to_seen
        else:
            back[first:first + len(doc) - 1] += np.where(later, 0, to_seen)
            back[first + 1:first + len(doc)] += np.where(later, to_seen, 0)
        first += len(doc)
    row, filter_ = np.nonzero(back)
    value, place = back[row, filter_], at[row, filter_]
    for k in range(WIDTH):
        flat = blocks[row, place + k].astype(np.int64) * FILTERS + filter_
        grads["taps"][k] += np.bincount(flat, value, 256 * FILTERS).reshape(256, FILTERS).astype(np.float32)
    return grads


def fit(texts: list[bytes], labels: list[int], epochs: int = EPOCHS) -> Network:
    """A network trained by Adam on whole texts, the same for the same rows in the same order."""
    rng = np.random.default_rng(SEED)
    net = Network.fresh(rng)
    docs, labels = [blocks_of(t) for t in texts], np.array(labels, np.float32)
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    steps = epochs * -(-len(docs) // BATCH_DOCUMENTS)
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for start in range(0, len(order), BATCH_DOCUMENTS):
            chosen = order[start:start + BATCH_DOCUMENTS]
            grads = _step(net, [docs[i] for i in chosen], [len(texts[i]) for i in chosen], labels[chosen])
            t += 1
            rate = RATE * (1 - (t - 1) / steps)
            for k, g in grads.items():
                g = g + DECAY * net.p[k]
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.001 * (g * g - square[k])
                net.p[k] = net.p[k] - rate * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.999**t)) + 1e-8)
    return net


# Spark --------------------------------------------------------------------

def learn(docs: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id", label: str = "quality",
          sample_per_class: int = SAMPLE_PER_CLASS) -> str:
    """Trains on a bounded sample of labelled documents; returns the model's shared folder.

    Of each label (0 and 1) the ``sample_per_class`` rows with the smallest hash
    of their id are taken, and of these the documents of up to
    ``SAMPLE_TEXT_BYTES``. Scores are corrected for the classes' true shares
    among all labelled rows, which are counted. A class without rows makes the
    score constant: the share of ones, counted with one row of each class added.
    """
    spark = docs.sparkSession
    given = labels.where(F.col(label).isin(0, 1) & F.col(id_column).isNotNull()).select(
        F.col(id_column).alias("id"), F.col(label).cast("int").alias("label"), F.xxhash64(id_column).alias("place"))
    totals = {r.label: r["count"] for r in given.groupBy("label").count().collect()}
    of_class = lambda k: given.where(F.col("label") == k).orderBy("place", "id").limit(sample_per_class)
    # at most two rows of numbers for each sampled document: small whatever the input
    chosen = of_class(0).unionByName(of_class(1))
    sample = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")).where(
        F.octet_length("text") <= SAMPLE_TEXT_BYTES).join(F.broadcast(chosen), "id").select("place", "id", "label", "text")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(
            {r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(4)))})
        found = [sum(r[2] == k for r in rows) for k in (0, 1)]
        if all(found):
            shift = np.log(np.array([totals[1] / totals[0] * found[0] / found[1]]))
            model = _packed(**fit([r[3] for r in rows], [r[2] for r in rows]).p, shift=shift)
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    prior = _packed(constant=np.array([(totals.get(1, 0) + 1) / (sum(totals.values()) + 2)]))
    path = scratch_path(spark, "quality-model")
    sample.repartition(1).mapInArrow(train, "model binary").unionByName(
        spark.createDataFrame([(bytearray(prior),)], "model binary")).write.parquet(path)
    return path


def _packed(**arrays: np.ndarray) -> bytes:
    file = io.BytesIO()
    np.savez(file, **arrays)
    return file.getvalue()


class Scorer:
    """Scores texts by the model of a folder."""

    def __init__(self, path: str):
        store, root = shared_file(path)
        parts = []
        for found in store.get_file_info(fs.FileSelector(root)):
            if found.path.endswith(".parquet"):
                with store.open_input_file(found.path) as file:
                    parts += pq.read_table(file).column(0).to_pylist()
        models = [dict(np.load(io.BytesIO(x))) for x in parts]
        # the prior is there always, the network if it could be trained
        self.constant = next(float(m["constant"][0]) for m in models if "constant" in m)
        for model in models:
            if "shift" in model:
                self.constant, self.shift = None, float(model.pop("shift")[0])
                self.net = Network(model)
                self.pairs = self.net.pairs()

    def _best(self, data: bytes) -> np.ndarray:
        """Responses of every block of a text, cut piece by piece."""
        step = PIECE_BYTES // BLOCK * BLOCK
        parts = []
        for at in range(0, max(1, len(data)), step):
            cut = blocks_of(data[at:at + step + WIDTH - 1])
            parts.append(Network.responses(cut[:step // BLOCK], self.pairs, False)[0])
        return np.concatenate(parts)

    def score(self, texts: list[bytes | None]) -> list[float]:
        if self.constant is not None:
            return [self.constant] * len(texts)
        logits = [self.net.logit(self._best(t or b""), len(t or b"")) + self.shift for t in texts]
        return (1 / (1 + np.exp(-np.clip(np.array(logits, np.float64), -500, 500)))).tolist()


def score_quality(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Adds quality_score, the probability that the label is 1.

    Null texts count as empty ones, which have a score too. Whole texts are
    read; equal texts have equal scores; rows stay as they are, and a column of
    that name is replaced.
    """
    kept = [c for c in docs.columns if c != SCORE.name]
    schema = StructType([*(docs.schema[c] for c in kept), SCORE])
    places, text_place = [docs.columns.index(c) for c in kept], docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            scorer = scorer or Scorer(model_path)
            found = scorer.score(batch.column(text_place).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(p) for p in places), pa.array(found, pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)
