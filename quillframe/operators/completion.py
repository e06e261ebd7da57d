"""Batch application of a text model, with retries recorded as columns.

Where a failed call has to wait before it is sent again, the failed prompts are
a table of their own and go to the next round. The back-off lies between rounds,
on the driver, so no task holds a slot while it waits, and every attempt is on
record: a run that dies goes on with the round it was in.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillframe import schemas
from quillframe.scratch import scratch_path, written
from quillframe.session import bound_batches
from quillframe.sources.storage import path_exists
from quillframe.spreading import spread

# Fixed values.
MAX_RETRIES = 5
BACKOFF_SECONDS = 5
CALL_SIZE = 16

#: Status of a prompt that failed and has attempts left.
OPEN = "open"


def _attempt(complete: Callable, prompts: list[str]) -> list:
    """One call; a raised error stands for every prompt of the call."""
    try:
        replies = list(complete(prompts))
    except Exception as problem:
        return [problem] * len(prompts)
    if len(replies) != len(prompts):
        return [ValueError("one reply per prompt expected")] * len(prompts)
    return replies


def _with_retries(complete: Callable, prompts: list[str], max_retries: int) -> pd.DataFrame:
    result = pd.DataFrame(
        {"text": None, "attempts": 0, "status": "failed", "error": None},
        index=range(len(prompts)),
        dtype=object,
    )
    open_rows = list(range(len(prompts)))
    for attempt in range(1, max_retries + 2):
        replies = _attempt(complete, [prompts[i] for i in open_rows])
        still_open = []
        for i, reply in zip(open_rows, replies):
            if isinstance(reply, BaseException):
                result.loc[i] = [None, attempt, "failed", str(reply)]
                still_open.append(i)
            else:
                result.loc[i] = [reply, attempt, "completed", None]
        open_rows = still_open
        if not open_rows:
            break
    return result


def _side_by_side(work: Callable, items: Iterator, most: int) -> Iterator:
    """Results of ``work`` in order, with at most ``most`` calls under way."""
    if most == 1:
        yield from map(work, items)
        return
    with ThreadPoolExecutor(most) as pool:
        running = deque()
        for item in items:
            if len(running) == most:
                yield running.popleft().result()
            running.append(pool.submit(work, item))
        while running:
            yield running.popleft().result()


def complete_prompts(
    prompts: DataFrame,
    make_complete: Callable[[], Callable[[list[str]], list]],
    prompt: str = "prompt",
    max_retries: int = MAX_RETRIES,
    backoff: float = BACKOFF_SECONDS,
    call_size: int = CALL_SIZE,
    tasks: int | None = None,
) -> DataFrame:
    """Every distinct prompt once: (prompt_hash, text, attempts, status, error).

    ``make_complete`` runs once per task and returns ``complete(list of prompts)
    -> list of replies``; an exception in the list, or raised, is retried for
    the prompts concerned. A failure is a row with status ``failed``, so it
    never ends up among the texts. Tasks can be repeated by Spark: write the
    result once and join on the hash. ``tasks`` sets how many calls run side by
    side, for a model that is slow compared to the size of its prompts.

    Without a back-off the task tries again at once. With one, or for a table
    that outlives the run, the work is done in rounds (``complete_in_rounds``).
    """
    if backoff > 0:
        return complete_in_rounds(
            prompts, make_complete, scratch_path(prompts.sparkSession, "replies"), prompt, max_retries, backoff, call_size, tasks)
    bound_batches(prompts.sparkSession)
    distinct = with_prompt_hash(prompts, prompt).groupBy("prompt_hash").agg(F.first(prompt).alias("prompt"))

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        complete = make_complete()
        for batch in batches:
            for low in range(0, len(batch), call_size):
                call = batch.iloc[low:low + call_size].reset_index(drop=True)
                replies = _with_retries(complete, call["prompt"].tolist(), max_retries)
                yield pd.concat([call[["prompt_hash"]], replies], axis=1)

    shared = distinct.repartition(tasks) if tasks else spread(distinct)
    return shared.mapInPandas(apply, "prompt_hash string, " + schemas.COMPLETION)


def complete_in_rounds(
    prompts: DataFrame,
    make_complete: Callable[[], Callable[[list[str]], list]],
    root: str,
    prompt: str = "prompt",
    max_retries: int = MAX_RETRIES,
    backoff: float = BACKOFF_SECONDS,
    call_size: int = CALL_SIZE,
    tasks: int | None = None,
    in_flight: int = 1,
    wait: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Replies of all distinct prompts: (prompt_hash, text, attempts, status, error), kept in ``root``.

    Each round sends every open prompt once and appends the outcome to the table
    of attempts in ``root``. Prompts that failed are the next round's, after a
    pause of ``backoff`` times the attempt, in which no task runs. A task has at
    most ``in_flight`` calls under way. Prompts completed in an earlier run are
    not sent again, those that a run left ``open`` go on with their next attempt,
    and those that failed for good start anew.
    """
    spark = prompts.sparkSession
    bound_batches(spark)
    known = _latest(_replies(spark, root)).select(
        "prompt_hash", F.when(F.col("status") == OPEN, F.col("attempts")).otherwise(0).alias("made"))
    asked = with_prompt_hash(not_completed(prompts, _replies(spark, root), prompt), prompt)
    pending = written(
        asked.groupBy("prompt_hash").agg(F.first(prompt).alias("prompt")).join(known, "prompt_hash", "left").select(
            "prompt_hash", "prompt", F.coalesce("made", F.lit(0)).alias("made")), "prompts")
    pending = pending.where(F.col("made") <= max_retries)

    def attempt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        complete = make_complete()
        calls = (batch.iloc[low:low + call_size].reset_index(drop=True)
                 for batch in batches for low in range(0, len(batch), call_size))

        def outcome(call: pd.DataFrame) -> pd.DataFrame:
            replies, tries = _attempt(complete, call["prompt"].tolist()), call["made"] + 1
            failed = [isinstance(reply, BaseException) for reply in replies]
            status = ["completed" if not f else OPEN if t <= max_retries else "failed" for f, t in zip(failed, tries)]
            return pd.DataFrame({
                "prompt_hash": call["prompt_hash"], "text": [None if f else reply for f, reply in zip(failed, replies)],
                "attempts": tries, "status": status, "error": [str(reply) if f else None for f, reply in zip(failed, replies)]})

        yield from _side_by_side(outcome, calls, in_flight)

    schema = "prompt_hash string, " + schemas.COMPLETION
    while True:
        shared = pending.repartition(tasks) if tasks else spread(pending)
        shared.mapInPandas(attempt, schema).write.mode("append").parquet(root)
        left = _latest(_replies(spark, root)).where(F.col("status") == OPEN).select(
            "prompt_hash", F.col("attempts").alias("now"))
        pending = written(pending.join(left, "prompt_hash").select(
            "prompt_hash", "prompt", F.col("now").alias("made")), "prompts")
        most = pending.agg(F.max("made")).first()[0]
        if most is None:
            break
        wait(backoff * most)
    everything = with_prompt_hash(prompts, prompt).select("prompt_hash").distinct()
    return _latest(_replies(spark, root)).join(everything, "prompt_hash", "left_semi")


def complete_durably(
    prompts: DataFrame, make_complete: Callable, root: str, prompt: str = "prompt", **options
) -> DataFrame:
    """``complete_in_rounds`` with a table of attempts that later runs find.

    Replies are appended before anything is made of them, so a run that dies
    afterwards calls the model for none of them again. A reply appended twice, by
    runs side by side, counts once: the first by text.
    """
    return complete_in_rounds(prompts, make_complete, root, prompt, **options)


def _latest(replies: DataFrame) -> DataFrame:
    """One row a prompt: its reply, or its last attempt."""
    best = F.struct((F.col("status") != "completed").alias("unanswered"), (-F.col("attempts")).alias("_before"),
                    "text", "attempts", "status", "error")
    return replies.groupBy("prompt_hash").agg(F.min(best).alias("_best")).select(
        "prompt_hash", "_best.text", "_best.attempts", "_best.status", "_best.error")


def _replies(spark: SparkSession, root: str) -> DataFrame:
    schema = "prompt_hash string, " + schemas.COMPLETION
    if not path_exists(spark, root):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(root)


def with_prompt_hash(df: DataFrame, prompt: str = "prompt") -> DataFrame:
    return df.withColumn("prompt_hash", F.sha2(F.col(prompt), 256))


def not_completed(prompts: DataFrame, results: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Prompts without a completed reply in the results table."""
    done = results.where(F.col("status") == "completed").select("prompt_hash")
    return with_prompt_hash(prompts, prompt).join(done, "prompt_hash", "left_anti").drop("prompt_hash")


def completed_texts(keyed: DataFrame, results: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Replies back on the keyed prompts; failures stay behind."""
    done = results.where(F.col("status") == "completed").select("prompt_hash", "text")
    return with_prompt_hash(keyed, prompt).drop(prompt).join(done, "prompt_hash").drop("prompt_hash")
