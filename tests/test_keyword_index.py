"""The kept index answers as a search over the texts does, after any updates and merges."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import retrieval
from corpusloom.operators.keyword_index import KeywordIndex
from corpusloom.store import Store

WORDS = "alpha beta gamma delta the the the 营收 报告 zeta".split()


def ranked(frame):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in frame.collect())


@pytest.mark.parametrize("seed", [1])
def test_like_a_search_over_the_texts(spark, tmp_path, seed):
    rng, texts = random.Random(seed), {}
    index = KeywordIndex(Store(spark, str(tmp_path / "index")), buckets=5, width=16, fan=2)
    queries = spark.createDataFrame([(1, "alpha the the"), (2, "营收 missing zeta"), (3, ""), (4, "beta gamma delta 报告")], "query_id long, query string")
    for number in range(3):
        add = {rng.randint(0, 120): " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12))) for _ in range(60)}
        remove = [] if number == 0 else rng.sample(range(150), 25)
        remove = [i for i in remove if i not in add]
        frame = spark.createDataFrame([*add.items(), (None, "alpha")], "chunk_id long, content string")
        for _ in range(1 + number % 2):  # a batch that comes again changes nothing
            index.update(frame, spark.createDataFrame([(i,) for i in remove], "chunk_id long"), ("s", number))
        texts = {i: t for i, t in {**texts, **add}.items() if i not in remove}
        if number % 2:
            index.merge()
        chunks = spark.createDataFrame(list(texts.items()), "chunk_id long, content string")
        assert ranked(index.search(queries, 7, seeds=1)) == ranked(retrieval.bm25(chunks, queries, 7))
    assert len(index.store.snapshot().notes["index"]["segments"]) < 3


def test_only_buckets_of_asked_terms_are_read(spark, tmp_path):
    index = KeywordIndex(Store(spark, str(tmp_path / "index")), buckets=16)
    index.update(spark.createDataFrame([(i, f"common word{'abcdefgh'[i % 8]} alpha") for i in range(50)], "chunk_id long, content string"))
    found = index.search(spark.createDataFrame([(1, "alpha")], "query_id long, query string"), 3)
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan or "PartitionFilters: [(bucket" in plan


def test_empty_index(spark, tmp_path):
    index = KeywordIndex(Store(spark, str(tmp_path / "index")))
    index.update(spark.createDataFrame([(1, None), (2, "")], "chunk_id long, content string"))
    assert index.search(spark.createDataFrame([(1, "alpha")], "query_id long, query string"), 3).count() == 0
    index.update(spark.createDataFrame([(1, "alpha beta"), (3, "gamma delta"), (4, "zeta eta")], "chunk_id long, content string"))
    assert [r.chunk_id for r in index.search(spark.createDataFrame([(1, "alpha")], "query_id long, query string"), 3).collect()] == [1]
    index.update(remove=spark.createDataFrame([(1,)], "chunk_id long"))
    assert index.search(spark.createDataFrame([(1, "alpha")], "query_id long, query string").where(F.lit(True)), 3).count() == 0
