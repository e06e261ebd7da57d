"""Batch embedding of texts."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

from quillframe.scratch import written
from quillframe.session import bound_batches
from quillframe.sources import storage
from quillframe.spreading import spread

BATCH_SIZE = 128
WIDTH = 64
STORED = "digest string, embedding array<float>"


def hashed_words(width: int = WIDTH) -> Callable:
    """Local default model: word counts hashed into ``width`` slots, unit length.

    A hosted model is another function of the same kind: it returns
    ``predict(texts) -> matrix`` and runs once per Python worker.
    """

    def make_predict():
        from collections import Counter
        from hashlib import md5

        words = re.compile(r"[A-Za-z0-9_]+")
        slots: dict[str, int] = {}

        def slot(word: str) -> int:
            if word not in slots:
                if len(slots) > 500_000:
                    slots.clear()
                slots[word] = int(md5(word.encode()).hexdigest()[:8], 16) % width
            return slots[word]

        def predict(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), width))
            for row, text in enumerate(texts):
                for word, count in Counter(words.findall(text or "")).items():
                    out[row, slot(word.lower())] += count
            norms = np.sqrt((out**2).sum(axis=1))
            return (out / np.where(norms == 0, 1, norms)[:, None]).astype(np.float32)

        return predict

    return make_predict


def embedder(make_predict: Callable | None = None, batch_size: int = BATCH_SIZE) -> Callable[[Column], Column]:
    """The model as a column function.

    Marked nondeterministic so that Catalyst runs it once: it would otherwise
    copy the call into every filter it derives for the embedding.
    """
    model = predict_batch_udf(
        make_predict or hashed_words(), return_type=ArrayType(FloatType()), batch_size=batch_size
    )
    return model.asNondeterministic()


def with_embedding(df: DataFrame, text: str = "document", make_predict: Callable | None = None) -> DataFrame:
    """Add ``embedding``; null texts count as empty."""
    bound_batches(df.sparkSession)
    return spread(df).withColumn("embedding", embedder(make_predict)(F.coalesce(F.col(text), F.lit(""))))


def embed_distinct(df: DataFrame, text: str, make_predict: Callable | None = None, root: str | None = None) -> DataFrame:
    """(text, embedding), each distinct text embedded once, and once for all runs with a store at ``root``."""
    return stored_or_new(df.select(text).distinct(), root, text, make_predict)


def with_stored_embedding(df: DataFrame, root: str, text: str = "document", make_predict: Callable | None = None) -> DataFrame:
    """``with_embedding`` that asks the model for texts whose embedding ``root`` doesn't hold.

    What is new is appended there by content hash before anything is made of it,
    so neither a later run nor the repeat of a failed one pays for it again. One
    folder belongs to one model. Equal texts are one call; null texts count as
    empty. Texts meet stored embeddings by their digests and aren't shuffled but
    for those that are new.
    """
    spark = df.sparkSession
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    stored = storage.load_log(spark, root, STORED, "digest", "embedding")
    wanted = df.select(digest.alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    missing = written(wanted.join(stored.select("digest"), "digest", "left_anti").dropDuplicates(["digest"]), "to-embed")
    if not missing.isEmpty():
        storage.save_version(with_embedding(missing, "text", make_predict).select("digest", "embedding"), root)
    kept = storage.load_log(spark, root, STORED, "digest", "embedding").withColumnRenamed("digest", "_digest")
    return df.join(kept, digest == F.col("_digest")).drop("_digest")


def stored_or_new(df: DataFrame, root: str | None, text: str, make_predict: Callable | None = None) -> DataFrame:
    """Adds ``embedding``, through the store at ``root`` if there is one."""
    return with_stored_embedding(df, root, text, make_predict) if root else with_embedding(df, text, make_predict)
