"""From questions to answers in one plan: rewrites, both routes for each, fusion, context, answer and its judgement."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.config import DEFAULT, Settings
from corpusloom.functions import policy
from corpusloom.operators import answers, retrieval
from corpusloom.providers import ExtractiveGenerator, Generator

#: Fixed value: what is said where nothing was found.
NOTHING_FOUND = "根据提供的上下文，无法找到相关信息"


def search_rewrites(chunks: DataFrame, vectors: DataFrame, routes: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """query_id, rank, chunk_id, score and rrf_score: what is best over all rewrites of a question.

    ``routes`` has query_id, route (from 0, below the number of rewrites that
    are allowed), route_query, vector (null: searched by words alone) and years.  All
    rewrites of all questions are searched as one set of queries; each keeps
    the best of its fused hits, and those lists are fused with equal weight.
    """
    own, most = settings.retrieval, settings.retrieval.max_rewrites
    single = F.col("query_id") * most + F.col("route")
    asked = routes.select(single.alias("query_id"), F.col("route_query").alias("query"), "vector", "years")
    hits = retrieval.hybrid(chunks, vectors, asked, replace(own, top_k=own.route_top_k, rerank=False))
    listed = hits.select(F.floor(F.col("query_id") / most).alias("query_id"), F.pmod("query_id", F.lit(most)).alias("route"), "chunk_id", "score", "rank")
    return retrieval.rerank(retrieval.keep_best(retrieval.multi_route_rrf(listed, 2 * own.top_k, own.rrf_k)), own)


def contexts(found: DataFrame, chunks: DataFrame, merged: bool = False, window: int = DEFAULT.policy.page_window) -> DataFrame:
    """query_id and context: the chunks found under their labels, in the order of their ids; or, ``merged``, neighbouring ones as one passage."""
    hit = retrieval.live(chunks).join(found.select("query_id", "chunk_id"), "chunk_id")
    if merged:
        return answers.contexts(answers.merge_adjacent(hit, ("query_id", "document_id"), window), ("query_id",))
    parts = F.array_sort(F.collect_list(F.struct("chunk_id", policy.labelled(F.array("chunk_id"), F.col("content")).alias("t"))))
    return hit.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n").alias("context"))


def answer(questions: DataFrame, routes: DataFrame, chunks: DataFrame, vectors: DataFrame, generator: Generator | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """``questions`` (query_id, query) with chunk_ids, context, answer, confidence, is_refused and cited, the ids the answer names.

    A question of which nothing is found is refused with a fixed text; one
    without a vector goes by words alone.  At most ``top_k`` passages come together for a question.
    """
    found = search_rewrites(chunks, vectors, routes, settings)
    kept = found.join(retrieval.live(chunks).select("chunk_id", "content"), "chunk_id")
    ranked = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "content")))
    passages = kept.groupBy("query_id").agg(F.transform(ranked, lambda p: F.struct(p["chunk_id"].alias("chunk_id"), p["content"].alias("content"))).alias("passages"))
    given = questions.join(passages, "query_id", "left").join(contexts(found, chunks), "query_id", "left")
    said = (generator or ExtractiveGenerator()).answer(given, "query", "passages")
    empty = F.col("passages").isNull()
    text = F.when(empty, NOTHING_FOUND).otherwise(F.col("answer"))
    out = said.withColumn("answer", text).withColumn("chunk_ids", F.coalesce(F.col("passages.chunk_id"), F.array().cast("array<long>")))
    judged = out.withColumn("confidence", F.when(empty, 0.0).otherwise(policy.confidence(F.col("answer")))).withColumn("is_refused", empty | policy.is_refused(F.col("answer"), settings.policy))
    return judged.withColumn("cited", F.filter(policy.citations(F.col("answer")), lambda c: c.isNotNull())).drop("passages")
