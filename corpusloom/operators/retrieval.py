"""Hybrid retrieval: keyword and vector routes, year filter, rank fusion and hydration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.config import DEFAULT, Retrieval
from corpusloom.functions.text import preview, tokens
from corpusloom.session import kept

BROADCAST_TERMS = 100_000  # query terms up to which their weights go to every task; more are joined by term
QUERY_BLOCK = 1024  # query vectors that a task holds


def live(chunks: DataFrame, tenant: Column | None = None) -> DataFrame:
    """Chunks that aren't deleted, of one tenant if one is given."""
    out = chunks.where(~F.col("is_deleted"))
    return out if tenant is None else out.where(F.col("tenant") == tenant)


def _top(df: DataFrame, by: tuple[str, ...], k: int, *order: Column) -> DataFrame:
    """Ranks from 1 and the first k of each key; Spark cuts each partition to k before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def _split(chunks: DataFrame, text: str) -> DataFrame:
    """chunk_id and t, the tokens, of chunks that have any; the generator keeps Spark from splitting a text once for each use."""
    return chunks.select("chunk_id", F.explode(F.array(tokens(F.col(text)))).alias("t")).where(F.size("t") > 0)


def postings(chunks: DataFrame, text: str = "content") -> DataFrame:
    """chunk_id, term, tf and dl, the chunk's tokens; chunks without tokens have none."""
    split = _split(chunks, text)
    terms = split.select("chunk_id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    return terms.groupBy("chunk_id", "term").agg(F.count("*").alias("tf"), F.first("dl").cast("long").alias("dl"))


def corpus_stats(posts: DataFrame) -> DataFrame:
    """One row: n chunks with tokens, their total and mean length."""
    lengths = posts.groupBy("chunk_id").agg(F.first("dl").alias("dl"))
    return lengths.agg(F.count("*").alias("n"), F.sum("dl").alias("total"), F.avg("dl").alias("avgdl"))


def weigh_terms(frequencies: DataFrame, n: int, epsilon: float = DEFAULT.retrieval.bm25_epsilon) -> DataFrame:
    """term, df and idf from term and df; a negative idf becomes ``epsilon`` times the mean of all."""
    raw = frequencies.withColumn("raw", F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw")).scalar()
    return raw.select("term", "df", F.when(F.col("raw") < 0, epsilon * mean).otherwise(F.col("raw")).alias("idf"))


def term_idf(posts: DataFrame, n: int, epsilon: float = DEFAULT.retrieval.bm25_epsilon) -> DataFrame:
    return weigh_terms(posts.groupBy("term").agg(F.count("*").alias("df")), n, epsilon)


def bm25(chunks: DataFrame, queries: DataFrame, k: int, settings: Retrieval = DEFAULT.retrieval, text: str = "content") -> DataFrame:
    """query_id, chunk_id, score, rank: the k best chunks of positive score for each query (query_id, query).

    Query tokens count as often as they stand.  Ties of the rounded score go to
    the smaller id.  Texts are split once, into a table.  Only the tokens that a query asks for are shuffled, once by
    chunk, which serves both sums; document frequencies are summed before the shuffle, whose
    result serves their mean and the join.
    """
    split = kept(_split(chunks, text).select("chunk_id", F.size("t").cast("long").alias("dl"), "t"), "tokens")
    stats = split.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    frequencies = split.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = weigh_terms(frequencies, stats["n"], settings.bm25_epsilon)
    terms = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    weighted = terms.join(idf, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"))
    if terms.count() <= BROADCAST_TERMS:
        weighted = F.broadcast(weighted)
    wanted = split.select("chunk_id", "dl", F.explode("t").alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    posts = wanted.repartition("chunk_id").groupBy("chunk_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    saturation = F.col("tf") * (settings.bm25_k1 + 1) / (F.col("tf") + settings.bm25_k1 * (1 - settings.bm25_b + settings.bm25_b * F.col("dl") / float(stats["avgdl"] or 1)))
    scored = posts.join(weighted, "term").groupBy("query_id", "chunk_id").agg(F.sum(F.col("weight") * saturation).alias("score"))
    scored = scored.withColumn("score", F.round("score", 9)).where("score > 0")
    return _top(scored, ("query_id",), k, F.desc("score"), F.asc("chunk_id"))


def sound(vector: Column) -> Column:
    """Whether a vector has components, and only finite ones."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """query_id, chunk_id, distance (l2: squared) or cosine, score, rank: exact neighbours of a stated query set.

    ``vectors`` has chunk_id and vector, ``queries`` query_id and vector.  Both
    are shuffled: queries in blocks of some ``QUERY_BLOCK``, vectors in as many
    parts as keep all cores busy, and a task holds one block against one part
    and passes on its k best only.  So vectors are copied once for each block of
    queries, and nothing goes through the driver.  A vector that is null, empty or
    has a null or non-finite component takes no part, nor does one of another
    size than a query's; by cosine a zero one doesn't either.
    """
    as_double = lambda df, key: df.where(sound(F.col("vector"))).select(F.col(key).alias("id"), F.size("vector").alias("size"), F.col("vector").cast("array<double>").alias("vector"))
    asked = as_double(queries, "query_id").distinct()
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    parts = max(1, -(-vectors.sparkSession.sparkContext.defaultParallelism // blocks))
    copies = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    questions = asked.select("id", "size", "vector", F.lit(True).alias("asks"), dealt(blocks).alias("block"), copies("part", parts))
    known = as_double(vectors, "chunk_id").join(F.broadcast(asked.select("size").distinct()), "size", "left_semi")
    stored = known.select("id", "size", "vector", F.lit(False).alias("asks"), dealt(parts).alias("part"), copies("block", blocks))
    met = questions.unionByName(stored).repartition(max(blocks * parts, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "block", "part")
    found = met.sortWithinPartitions("block", "part", "size", F.desc("asks")).select("block", "part", "size", "asks", "id", "vector").mapInArrow(_block_search(k, metric), "query_id long, chunk_id long, distance double")
    similarity = F.when(F.lit(metric == "l2"), 1 / (1 + F.col("distance"))).otherwise(F.col("distance"))
    ranked = found.withColumn("score", F.round(similarity, 9)).withColumn("distance", F.round("distance", 9))
    order = (F.asc("distance") if metric == "l2" else F.desc("distance"), F.asc("chunk_id"))
    return _top(ranked, ("query_id",), k, *order)


def _block_search(k: int, metric: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come by block, part and size, a block's queries before the vectors that are held against them."""

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy().reshape(len(column), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids, asked = None, [], []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in (0, 1, 2)] + [batch.column(3).to_numpy(zero_copy_only=False)], axis=1).astype(np.int64)
            edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1), True])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if place != tuple(keys[a, :3]):
                    place, ids, asked = tuple(keys[a, :3]), [], []
                part = batch.slice(a, b - a)
                if keys[a, 3]:
                    ids.append(part.column(4).to_numpy())
                    asked.append(matrix(part.column(5)))
                elif ids:
                    yield _nearest(np.concatenate(ids), np.concatenate(asked), part.column(4).to_numpy(), matrix(part.column(5)), k, metric)

    return run


def _nearest(ids: np.ndarray, asked: np.ndarray, chunk: np.ndarray, rows: np.ndarray, k: int, metric: str) -> pa.RecordBatch:
    measure = np.zeros((len(asked), len(rows)))
    for d in range(rows.shape[1]):  # in the order of the components, so every engine gets the same sum
        measure += (asked[:, d, None] - rows[None, :, d]) ** 2 if metric == "l2" else asked[:, d, None] * rows[None, :, d]
    sign = 1
    if metric == "cosine":
        norms = np.sqrt((asked**2).sum(axis=1))[:, None] * np.sqrt((rows**2).sum(axis=1))[None, :]
        measure = np.where(norms > 0, measure / np.where(norms > 0, norms, 1), np.nan)
        sign = -1
    keyed = np.where(np.isnan(measure), np.inf, sign * np.round(measure, 9))
    kth = np.partition(keyed, k - 1, axis=1)[:, k - 1 : k] if len(rows) > k else np.full((len(asked), 1), np.finfo(float).max)
    i, j = np.nonzero(keyed <= kth)
    return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(chunk[j]), pa.array(measure[i, j])], ["query_id", "chunk_id", "distance"])


def year_filter(hits: DataFrame, chunks: DataFrame, asked: DataFrame, least: int = DEFAULT.retrieval.min_year_hits) -> DataFrame:
    """Hits whose year is asked for or unknown, or whose content names an asked year.

    ``asked`` has query_id and years.  A query without years keeps all hits, as
    does one that would keep fewer than ``least`` different chunks over its routes.
    """
    known = hits.join(chunks.select("chunk_id", "year", "content"), "chunk_id").join(asked, "query_id", "left")
    named = F.exists("years", lambda y: F.contains(F.col("content"), y.cast("string")))
    allowed = F.col("year").isNull() | F.array_contains("years", F.col("year")) | named
    unasked = F.col("years").isNull() | (F.size("years") == 0)
    marked = known.withColumn("allowed", F.coalesce(allowed, F.lit(False)))
    enough = F.size(F.collect_set(F.when(F.col("allowed"), F.col("chunk_id"))).over(Window.partitionBy("query_id"))) >= least
    return marked.withColumn("enough", enough).where(unasked | F.col("allowed") | ~F.col("enough")).select(*hits.columns)


def weighted_rrf(hits: DataFrame, settings: Retrieval = DEFAULT.retrieval) -> DataFrame:
    """Fuse a vector and a keyword route (columns query_id, route, chunk_id, score, rank).

    Ranks are counted anew within a route.  Where only one route has hits they
    pass with their own scores and no rrf_score.  Ties go to the vector route, then to its order.
    """
    in_route = Window.partitionBy("query_id", "route").orderBy("rank", "chunk_id")
    weight = F.when(F.col("route") == "vector", settings.vector_weight).otherwise(settings.keyword_weight)
    placed = hits.withColumn("place", F.row_number().over(in_route)).withColumn("first", F.struct(F.when(F.col("route") == "vector", 1).otherwise(2).alias("r"), F.col("place").alias("p")))
    fused = placed.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(weight / (settings.rrf_k + F.col("place"))), 9).alias("fused"),
        F.min_by("score", "first").alias("score"),
        F.min("first").alias("first"),
        F.min("first.r").alias("low"),
        F.max("first.r").alias("high"),
    )
    by_query = Window.partitionBy("query_id")
    two = F.min("low").over(by_query) != F.max("high").over(by_query)
    fused = fused.withColumn("rrf_score", F.when(two, F.col("fused")))
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rrf_score"), F.col("first.r"), F.col("first.p"))
    return fused.withColumn("rank", F.row_number().over(order)).select("query_id", "chunk_id", "score", "rrf_score", "rank")


def multi_route_rrf(hits: DataFrame, k: int | None = None, rrf_k: int = DEFAULT.retrieval.rrf_k) -> DataFrame:
    """Fuse any number of routes (query_id, route, chunk_id, score, rank) with equal weights; routes count by number for ties."""
    in_route = Window.partitionBy("query_id", "route").orderBy("rank", "chunk_id")
    placed = hits.withColumn("place", F.row_number().over(in_route))
    fused = placed.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(1.0 / (rrf_k + F.col("place"))), 9).alias("rrf_score"),
        F.min_by("score", F.struct("route", "place")).alias("score"),
        F.min(F.struct("route", "place")).alias("first"),
    )
    ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "first")))
    return (ranked if k is None else ranked.where(F.col("rank") <= k)).select("query_id", "chunk_id", "score", "rrf_score", "rank")


def keep_best(hits: DataFrame) -> DataFrame:
    """Of a query's hits with one chunk_id the first by rank, ranked anew."""
    best = _top(hits.withColumnRenamed("rank", "_place"), ("query_id", "chunk_id"), 1, F.asc("_place")).drop("rank")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_place", "chunk_id"))).drop("_place")


def rerank(hits: DataFrame, settings: Retrieval = DEFAULT.retrieval) -> DataFrame:
    """The hits that go on: as many of the best as a reranker would keep where one is asked for, else ``top_k``."""
    return hits.where(F.col("rank") <= (settings.rerank_top_k if settings.rerank else settings.top_k))


def hydrate(hits: DataFrame, chunks: DataFrame, how: str = "inner") -> DataFrame:
    """Hits with document_id, year, pages, content and a preview; ``how="left"`` keeps hits without a chunk."""
    return hits.join(chunks.select("chunk_id", "document_id", "year", "page_start", "content"), "chunk_id", how).withColumn("preview", preview(F.col("content")))


def hybrid(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, settings: Retrieval = DEFAULT.retrieval) -> DataFrame:
    """Queries (query_id, query, vector, years) to their top chunks with fused scores.

    Deleted chunks are left out before anything is ranked, so none takes a place in the result.
    """
    stored = live(chunks)
    known = vectors.join(stored.select("chunk_id"), "chunk_id", "left_semi")
    near = knn(known, queries, settings.route_top_k).select("query_id", F.lit("vector").alias("route"), "chunk_id", "score", "rank")
    worded = bm25(stored, queries, settings.route_top_k, settings).select("query_id", F.lit("keyword").alias("route"), "chunk_id", "score", "rank")
    hits = year_filter(near.unionByName(worded), stored, queries.select("query_id", "years"), settings.min_year_hits)
    fused = rerank(weighted_rrf(hits, settings), settings)
    return hydrate(fused, stored).select("query_id", "rank", "chunk_id", "document_id", "year", F.round("score", 6).alias("score"), F.round("rrf_score", 6).alias("rrf_score"), "preview")
