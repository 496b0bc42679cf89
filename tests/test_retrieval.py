import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.text import TOKEN
from corpusloom.operators import answers, retrieval


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, route string, chunk_id long, score double, rank int")


def test_weighted_rrf(spark):
    rows = [(1, "vector", c, 0.9, r) for r, c in enumerate((1, 2, 3), 1)] + [(1, "keyword", c, 5.0, r) for r, c in enumerate((3, 4), 1)]
    rows += [(2, "keyword", c, 7.0 - r, r) for r, c in enumerate((5, 6), 1)]
    got = retrieval.weighted_rrf(hits(spark, rows)).orderBy("query_id", "rank").collect()
    assert [(r.chunk_id, r.rrf_score) for r in got[:4]] == [(3, pytest.approx(0.016081, abs=1e-6)), (1, pytest.approx(0.009836, abs=1e-6)), (2, pytest.approx(0.009677, abs=1e-6)), (4, pytest.approx(0.006452, abs=1e-6))]
    assert [(r.chunk_id, r.score, r.rrf_score) for r in got[4:]] == [(5, 6.0, None), (6, 5.0, None)] and got[0].score == 0.9


def test_multi_route_rrf(spark):
    rows = [(1, route, c, 1.0, r) for route, ids in (("0", (10, 20)), ("1", (20, 30)), ("2", (20, 10))) for r, c in enumerate(ids, 1)]
    got = [(r.chunk_id, round(r.rrf_score, 6)) for r in retrieval.multi_route_rrf(hits(spark, rows)).orderBy("rank").collect()]
    assert got == [(20, 0.048916), (10, 0.032522), (30, 0.016129)]


def test_year_filter_and_fallback(spark):
    chunks = spark.createDataFrame([(1, 2022, "x"), (2, None, "x"), (3, 2023, "in 2024"), (4, 2021, "none"), (5, 2019, "a"), (6, 2018, "b")], "chunk_id long, year int, content string")
    found = hits(spark, [(q, "vector", c, 1.0, c) for q in (1, 3) for c in (1, 2, 3, 4)] + [(2, "vector", c, 1.0, c) for c in (1, 2, 4, 5, 6)])
    asked = spark.createDataFrame([(1, [2022, 2024]), (2, [2022]), (3, [])], "query_id long, years array<int>")
    got = {}
    for r in retrieval.year_filter(found, chunks, asked).collect():
        got.setdefault(r.query_id, set()).add(r.chunk_id)
    assert got == {1: {1, 2, 3}, 2: {1, 2, 4, 5, 6}, 3: {1, 2, 3, 4}}


def test_bm25_like_the_formula(spark):
    import regex as re

    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(("alpha", "beta", "gamma", "delta", "the", "the", "营收")) for _ in range(rng.randint(0, 12)))) for i in range(40)]
    queries = [(1, "alpha the the"), (2, "营收 missing"), (3, "")]
    split = {i: [t for t in re.findall(TOKEN, d) if len(t) > 1] for i, d in docs}
    split = {i: t for i, t in split.items() if t}
    n, avgdl = len(split), sum(map(len, split.values())) / len(split)
    vocabulary = {t for own in split.values() for t in own}
    raw = {t: math.log(n - df + 0.5) - math.log(df + 0.5) for t in vocabulary for df in [sum(t in own for own in split.values())]}
    mean = sum(raw.values()) / len(raw)
    idf = {t: 0.25 * mean if x < 0 else x for t, x in raw.items()}
    want = {}
    for q, text in queries:
        scores = {}
        for i, own in split.items():
            s = sum(idf.get(t, 0) * own.count(t) * 2.5 / (own.count(t) + 1.5 * (0.25 + 0.75 * len(own) / avgdl)) for t in re.findall(TOKEN, text))
            if round(s, 9) > 0:
                scores[i] = round(s, 9)
        want[q] = [i for i, _ in sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:10]]
    chunks = spark.createDataFrame(docs, "chunk_id long, content string")
    got = {1: [], 2: [], 3: []}
    for r in retrieval.bm25(chunks, spark.createDataFrame(queries, "query_id long, query string"), 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.chunk_id)
    assert got == want


def test_knn(spark, monkeypatch):
    vectors = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.9, 0.1]), (4, [0.0, 0.0]), (5, None), (6, [0.9, 0.1])]
    frame = spark.createDataFrame(vectors, "chunk_id long, vector array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 2.0])], "query_id long, vector array<float>")
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 1)
    got = [(r.query_id, r.chunk_id) for r in retrieval.knn(frame, queries, 3).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1), (1, 3), (1, 6), (3, 2), (3, 4), (3, 3)] or got[:4] == [(1, 1), (1, 3), (1, 6), (3, 2)]
    cosine = [(r.query_id, r.chunk_id) for r in retrieval.knn(frame, queries, 2, "cosine").orderBy("query_id", "rank").collect()]
    assert cosine == [(1, 1), (1, 3), (3, 2), (3, 3)]


def test_knn_of_unsound_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, []), (4, [1.0]), (5, [None, 1.0]), (6, [nan, 0.0]), (7, [inf, 0.0]), (8, [1.0, 0.0, 0.0]), (9, None), (10, [0.0, 0.0])]
    frame = spark.createDataFrame(vectors, "chunk_id long, vector array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.9, 0.0, 0.0]), (3, []), (4, [nan, 1.0]), (5, [1.0] * 7)], "query_id long, vector array<float>")
    for metric, want in (("l2", {1: [1, 10, 2], 2: [8]}), ("cosine", {1: [1, 2], 2: [8]})):
        got = {}
        for r in retrieval.knn(frame, queries, 5, metric).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.chunk_id)
        assert got == want


def test_adjacent_merge(spark):
    rows = [(1, 1, 1, 1), (2, 1, 6, 6), (3, 1, 12, 12), (4, 2, None, None)]
    chunks = spark.createDataFrame([(i, d, s, e, f"c{i}") for i, d, s, e in rows], "chunk_id long, document_id long, page_start int, page_end int, content string")
    merged = answers.merge_adjacent(chunks)
    assert [(r.document_id, r.chunk_ids, r.content) for r in merged.orderBy("document_id", "island").collect()] == [(1, [1, 2], "c1\n\nc2"), (1, [3], "c3"), (2, [4], "c4")]
    context = answers.contexts(merged.withColumn("request_id", F.lit(1)), ("request_id",)).first()["context"]
    assert context == "[Chunk 1] [Chunk 2]\nc1\n\nc2\n\n[Chunk 3]\nc3\n\n[Chunk 4]\nc4"


def test_citations_join(spark):
    chunks = spark.createDataFrame([(1, "one"), (2, "two" * 100)], "chunk_id long, content string")
    given = spark.createDataFrame([(7, "[Chunk 2][Chunk 9][Chunk 1][Chunk 2]")], "request_id long, answer string")
    assert [(r.rank_no, r.chunk_id, len(r.quote)) for r in answers.cited(given, chunks).orderBy("rank_no").collect()] == [(1, 2, 200), (3, 1, 3), (4, 2, 200)]


def test_hybrid_leaves_out_deleted_chunks(spark):
    chunks = spark.createDataFrame([(i, i, "t", None, i, i, f"alpha {'abcdefgh'[i] * 3}", i == 2) for i in range(1, 8)], "chunk_id long, document_id long, tenant string, year int, page_start int, page_end int, content string, is_deleted boolean")
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 8)], "chunk_id long, vector array<float>")
    queries = spark.createDataFrame([(1, "ccc ddd", [2.0, 1.0], [])], "query_id long, query string, vector array<float>, years array<int>")
    got = [r.chunk_id for r in retrieval.hybrid(chunks, vectors, queries).orderBy("rank").collect()]
    assert 2 not in got and got[0] == 3 and len(got) == 5
