import hashlib
import random

from corpusloom.llm import substrings
from tests.llm.helpers import documents, corpus, words


def brute(rows, size):
    first = {}
    for doc, text, *_ in rows:
        w = words(text)
        if doc is not None:
            for i in range(len(w) - size + 1):
                key = tuple(w[i : i + size])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text, *_ in rows:
        w = words(text)
        gone = set()
        if doc is not None:
            for i in range(len(w) - size + 1):
                if first[tuple(w[i : i + size])] < doc:
                    gone |= set(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((-1 if doc is None else doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def found(frame):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in frame.collect())


def test_like_brute_force(spark):
    rows = corpus()
    assert found(substrings.remove_repeats(documents(spark, rows))) == brute(rows, 13)
    assert sum(r[2] for r in brute(rows, 13)) > 200


def test_short_windows_and_small_slices(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))), None, None, None) for i in range(80)]
    for name, value in (("SLICE", 300), ("MAX_RUN", 3), ("BUCKET_BYTES", 200)):
        monkeypatch.setattr(substrings, name, value)
    for size in (3, 6):
        assert found(substrings.remove_repeats(documents(spark, rows), window=size)) == brute(rows, size)


def test_large_bucket_goes_on_window_by_window():
    import numpy as np

    w = [f"w{i}" for i in range(20)]
    packed = np.array([" ".join(w).encode(), " ".join(w[2:]).encode()], object)
    columns = (np.array([5, 9]), np.array([1, 2]), np.array([0, 7]), np.array([8, 6], np.int32), np.zeros(2, np.uint8))
    batch = substrings.pa.RecordBatch.from_pydict({"bucket": [1], "blob": [substrings._pack(*columns, packed.tolist())]})
    limit, substrings.BUCKET_BYTES = substrings.BUCKET_BYTES, 10
    try:
        rows = [r for b in substrings._in_buckets(iter([batch]), 13) for r in b.to_pylist()]
    finally:
        substrings.BUCKET_BYTES = limit
    assert len(rows) == 8 + 6 and len({r["wkey"] for r in rows}) == 8
    assert {r["start"] for r in rows if r["doc_id"] == 9} == set(range(7, 13))


def test_empty_table(spark):
    assert substrings.remove_repeats(documents(spark, [])).count() == 0


def test_small_buckets_and_a_hot_one(spark):
    rng = random.Random(5)
    passage = " ".join(f"p{rng.randint(0, 999)}" for _ in range(60))
    rows = [(i, " ".join([*(rng.choice(("a", "b", "c")) + str(rng.randint(0, 40)) for _ in range(rng.randint(5, 60))), passage if i % 3 else "alone"]), None, None, None) for i in range(300)]
    for bucket_bytes, mean_bucket in ((400, 150), (1 << 20, 100)):
        assert found(substrings.remove_repeats(documents(spark, rows).repartition(12), bucket_bytes=bucket_bytes, mean_bucket=mean_bucket)) == brute(rows, 13)


def test_number_of_buckets_follows_the_input(spark):
    """At any size few windows are worked off one by one."""
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    for n in (100, 200, 400, 800):
        rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(400)), None, None, None) for i in range(n)]
        keyed = documents(spark, rows).select("doc_id", substrings.F.xxhash64("text").alias("text_hash"), "text")
        one_by_one = substrings.met_in_buckets(keyed, bucket_bytes=40_000, mean_bucket=10_000).where("wkey is not null").count()
        assert one_by_one <= 0.01 * n * 388


def test_common_grams_come_last(spark, monkeypatch):
    """A common phrase gathers no bucket, and a passage in most documents sends one string a slice to its own."""
    import numpy as np

    for name, value in (("SAMPLE", 1.0), ("LEAST", 50), ("HOT_GRAMS", 2000)):
        monkeypatch.setattr(substrings, name, value)
    rng = random.Random(7)
    vocabulary, phrase = [f"w{i}" for i in range(2000)], ["at", "the", "end", "of"]
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(200):
        text = [x for _ in range(12) for x in (*rng.choices(vocabulary, k=6), *phrase)]
        rows.append((i, " ".join(text + (passage if i % 3 else [])), None, None, None))
    rows += [(7, "", None, None, None), (8, None, None, None, None), (None, rows[3][1], None, None, None)]
    docs = documents(spark, rows).repartition(3)
    common = substrings.common_grams(docs)
    assert len(common) == 1 + 3 + 37  # of the phrase, over its end, of the passage
    part = substrings.pa.RecordBatch.from_pydict({"d": list(range(200)), "h": list(range(200)), "t": [r[1] for r in rows[:200]]})
    held = {order: max(len(substrings._unpack(blob)[0]) for b, blob in substrings._super_kmers(part, 13, 64, grams) if b >= 0) for order, grams in (("hash", common[:0]), ("last", common))}
    known = [blob for b, blob in substrings._super_kmers(part, 13, 64, common) if b < 0]
    assert len(known) == 1 and held["last"] <= 2 * 200 * 12 * 10 / 5 / 64
    rows_known = [r for b in substrings._in_buckets(iter([substrings.pa.RecordBatch.from_pydict({"bucket": [-5], "blob": known})]), 13) for r in b.to_pylist()]
    assert len(rows_known) == sum(1 for i in range(200) if i % 3) - 1
    assert all(r["start"] <= 116 and r["stop"] == 160 for r in rows_known)  # the word before may be an earlier document's as well
    assert np.all(np.diff(common.astype(object)) > 0)
    assert found(substrings.remove_repeats(docs)) == brute(rows, 13)
