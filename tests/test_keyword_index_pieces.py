"""What the kept index shuffles and leaves on disk, and its blocks when they are made in parts."""

import os
import random
from collections import Counter

import pyarrow as pa

from corpusloom.operators import keyword_index, retrieval
from corpusloom.operators.keyword_index import KeywordIndex
from corpusloom.session import shared_dir
from corpusloom.store import Store


def ranked(frame):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in frame.collect())


def test_blocks_made_in_parts_have_every_posting(monkeypatch):
    rng = random.Random(7)
    texts = {i: [rng.choice(["a", "b", "中", "dd"]) for _ in range(rng.randint(1, 9))] for i in sorted(rng.sample(range(-40, 90), 60))}
    for size in (1, 7, 1 << 20):
        monkeypatch.setattr(keyword_index, "SLICE", size)
        batches = [pa.record_batch({"chunk_id": pa.array(list(part), pa.int64()), "t": pa.array([texts[i] for i in part])}) for part in ([*texts][:25], [*texts][25:])]
        found = {}
        for batch in keyword_index._blocks_of(16)(keyword_index._counted(iter(batches))):
            for term, place, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = len(packed) // 3
                for offset, tf, dl in zip(packed[:n], packed[n : 2 * n], packed[2 * n :], strict=True):
                    assert 0 <= offset < 16 and (place * 16 + offset, term) not in found
                    found[place * 16 + offset, term] = (tf, dl)
        assert found == {(i, w): (n, len(t)) for i, t in texts.items() for w, n in Counter(t).items()}


def test_blocks_are_shuffled_by_range_and_no_copies_stay(spark, tmp_path):
    before = set(os.listdir(f"{shared_dir(spark)}/corpusloom")) if os.path.isdir(f"{shared_dir(spark)}/corpusloom") else set()
    texts = {i: f"common word{'abcdefgh'[i % 8]} alpha beta" for i in range(60)}
    frame = lambda x: spark.createDataFrame(list(x.items()), "chunk_id long, content string")
    store = Store(spark, str(tmp_path / "index"))
    index = KeywordIndex(store, buckets=4, width=16, fan=2)
    index.update(frame(texts))
    index = KeywordIndex(store, buckets=4, width=5, fan=2)  # ranges stay as they are
    index.update(frame({i: "alpha alpha gamma" for i in range(0, 40, 3)}), spark.createDataFrame([(5,), (59,), (1000,)], "chunk_id long"))
    index.update(frame({7: "alpha"}))
    left = {i: "alpha" if i == 7 else "alpha alpha gamma" if i < 40 and i % 3 == 0 else t for i, t in texts.items() if i not in (5, 59)}
    queries = spark.createDataFrame([(1, "alpha gamma"), (2, "common worda beta")], "query_id long, query string")
    found = index.search(queries, 9, seeds=1)
    plan = found._jdf.queryExecution().toString()
    assert "hashpartitioning(range" in plan and "hashpartitioning(query_id#" in plan
    assert not [x for x in plan.split("\n") if "Exchange hashpartitioning(query_id" in x and ("range" in x or "chunk_id" in x)]
    want = ranked(retrieval.bm25(frame(left), queries, 9))
    assert ranked(found) == want
    made = {x.rpartition("-")[0] for x in set(os.listdir(f"{shared_dir(spark)}/corpusloom")) - before}
    assert not made & {"index-tokens", "index-counts", "index-merged", "index-gone"}
    index.update(frame({7: "alpha"}))
    assert index.merge() and index.store.expire() and ranked(index.search(queries, 9, seeds=1)) == want
