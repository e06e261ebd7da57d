"""Retrieval: queries to hits, hits to a context that fits a budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillframe.functions.prompts import context_budget
from quillframe.functions.text import token_count
from quillframe.operators import code, embedding, packing, search
from quillframe.scratch import written


def ranked_tokens(queries: DataFrame, vectors: DataFrame, k: int = search.DEFAULT_K, metric: str = "l2") -> DataFrame:
    """(query_id, rank, id, tokens) of the hits, without their documents.

    The hits are written, so the search runs once and the joins know how small
    they are. Token counts come with the vector table; where it has none they
    are counted once per document that was hit.
    """
    hits = written(search.nearest(queries, vectors, k, metric), "hits")
    if "tokens" not in vectors.columns:
        hit_ids = hits.select("id").distinct()
        vectors = vectors.join(hit_ids, "id", "left_semi").withColumn("tokens", token_count(F.col("document")))
    return hits.join(vectors.select("id", "tokens"), "id").select("query_id", "rank", "id", "tokens")


def retrieved_context(queries: DataFrame, vectors: DataFrame, k: int = search.DEFAULT_K, metric: str = "l2") -> DataFrame:
    """(query_id, context) for queries with a ``budget``; no hit is an empty context.

    Hits are packed by their token counts; documents join the kept ones only.
    """
    ranked = ranked_tokens(queries, vectors, k, metric).join(
        queries.select("query_id", "budget"), "query_id"
    )
    kept = packing.pack_ranked(ranked, ["query_id"], F.col("budget"))
    packed = search.attach_documents(kept, vectors)
    texts = packing.context_text(packed, ["query_id"])
    return queries.select("query_id").join(texts, "query_id", "left").select(
        "query_id", F.coalesce("context", F.lit("")).alias("context")
    )


def hit_lists(ranked: DataFrame, vectors: DataFrame, budgets: DataFrame | None = None) -> DataFrame:
    """(query_id, hits): at most k documents per query with their running tokens.

    With ``budgets`` (query_id, budget), hits that no file sharing the query has
    room for are left out before their documents are attached.
    """
    running = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    summed = ranked.withColumn("running", F.sum("tokens").over(running))
    if budgets is not None:
        most = budgets.groupBy("query_id").agg(F.max("budget").alias("_most"))
        summed = summed.join(most, "query_id").where("running <= _most").drop("_most")
    hit = F.struct("rank", "running", "document")
    return search.attach_documents(summed, vectors).groupBy("query_id").agg(
        F.array_sort(F.collect_list(hit)).alias("hits")
    )


def fitting(hits: Column, budget: Column) -> Column:
    """Context of the hits that fit: always a prefix of the list."""
    kept = F.filter(hits, lambda h: h["running"] <= budget)
    pieces = F.transform(kept, lambda h: F.concat(h["document"], F.lit(packing.SEPARATOR)))
    return F.coalesce(F.array_join(pieces, ""), F.lit(""))


def import_contexts(
    parsed: DataFrame,
    files: DataFrame,
    vectors: DataFrame,
    package: str,
    make_predict: Callable | None = None,
    k: int = search.DEFAULT_K,
    metric: str = "l2",
    embeddings: str | None = None,
) -> DataFrame:
    """(path, query, context): the names a file imports retrieve its context.

    Files with the same imports share one query, so the search runs over
    distinct query texts. Files differ only in budget: each takes the prefix of
    the shared hit list that fits, without a window per file. ``embeddings`` is
    the folder of a store of embeddings.
    """
    asked = code.import_query(parsed, package).join(
        files.select("path", context_budget(F.col("content")).alias("budget")), "path"
    )
    query_id = F.sha2("query", 256).alias("query_id")
    distinct = embedding.embed_distinct(asked, "query", make_predict, embeddings)
    queries = written(distinct.select(query_id, "embedding"), "queries")
    budgets = asked.select(query_id, "budget")
    lists = hit_lists(ranked_tokens(queries, vectors, k, metric), vectors, budgets)
    return asked.withColumn("query_id", query_id).join(lists, "query_id", "left").select(
        "path", "query", fitting(F.col("hits"), F.col("budget")).alias("context")
    )
