import random

import numpy as np
import xxhash

from corpusloom.llm import simhash
from corpusloom.llm.components import components, contract
from tests.llm.helpers import corpus, documents, words


def brute_print(text):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in words(text)]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union_find(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints_like_brute_force(spark):
    for _, text, *_ in corpus():
        assert simhash.fingerprint(text or "") == brute_print(text)


def test_near_duplicates_like_brute_force(spark):
    rows = corpus()
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    prints = [int(r.fingerprint, 16) for r in got]
    assert sorted(prints) == sorted(brute_print(t) for _, t, *_ in rows)
    root = union_find([(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3], range(len(prints)))
    ids = {}
    for i, r in enumerate(got):
        ids.setdefault(root[i], []).append(r.doc_id)
    for i, r in enumerate(got):
        assert r.component_id == min((x for x in ids[root[i]] if x is not None), default=None)


def test_golay_keys_meet_at_one_and_two_bits():
    rng = np.random.default_rng(0)
    word = rng.integers(0, 1 << 23, 500)
    home, further = simhash.golay_keys(word)
    assert ((further >= 0).all(axis=1) | (further < 0).all(axis=1)).all()
    for bits in (0, 1, 2):
        other = word.copy()
        for i in range(len(other)):
            for b in rng.choice(23, bits, replace=False):
                other[i] ^= 1 << int(b)
        home2, further2 = simhash.golay_keys(other)
        for i in range(len(word)):
            a, b = {home[i], *further[i]} - {-1}, {home2[i], *further2[i]} - {-1}
            assert a & b and (bits == 2 or home2[i] in a)


def dense(n=700, seed=1):
    rng = random.Random(seed)
    centre = rng.getrandbits(64)
    flip = lambda x, k: x ^ sum(1 << b for b in rng.sample(range(64), k))
    near = {flip(centre, rng.randint(0, 5)) for _ in range(n)}
    far = {rng.getrandbits(64) for _ in range(n)}
    return np.array(sorted(near | far | {flip(x, 3) for x in list(far)[:50]}), np.uint64)


def test_links_keep_every_component(spark, monkeypatch):
    fps = dense()
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    want = union_find([(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[:i]) <= 3)], range(len(fps)))
    roots = {r.node: r.root for r in components(simhash.links(frame)).collect()}
    label = [roots.get(int(x), int(x)) for x in fps.view(np.int64)]
    groups = {}
    for i, x in enumerate(label):
        groups.setdefault(x, set()).add(i)
    expected = {}
    for i, x in want.items():
        expected.setdefault(x, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_large_buckets_are_passed_on_and_compared_in_blocks():
    fps = dense(300)
    key, index, home = simhash.bucket_keys(fps)
    order = np.argsort(key, kind="stable")
    columns = [simhash.pa.array(key[order]), simhash.pa.array(fps[index[order]].view(np.int64)), simhash.pa.array(home[order])]
    whole = simhash.pa.RecordBatch.from_arrays(columns, ["key", "fp", "home"])
    limit, simhash.BUCKET_ROWS = simhash.BUCKET_ROWS, 20
    try:
        out = [r for b in simhash._links(iter([whole.slice(a, 97) for a in range(0, len(key), 97)])) for r in b.to_pylist()]
    finally:
        simhash.BUCKET_ROWS = limit
    passed = {}
    for r in out:
        if r["key"] is not None:
            passed.setdefault(r["key"], []).append((r["u"], r["home"]))
    sizes = dict(zip(*np.unique(key, return_counts=True), strict=True))
    assert {k: len(v) for k, v in passed.items()} == {k: n for k, n in sizes.items() if n > 20} and passed
    u, v = [np.array([r[c] for r in out if r["key"] is None], np.int64) for c in ("u", "v")]
    for rows in passed.values():
        block = simhash._block_links(simhash.pd.DataFrame(rows, columns=["u", "home"]))
        u, v = np.r_[u, block["u"]], np.r_[v, block["v"]]
    nodes, roots = contract(u, v)
    own = dict(zip(nodes.tolist(), roots.tolist(), strict=True))
    want = union_find([(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[:i]) <= 3)], range(len(fps)))
    got = [own.get(int(x), int(x)) for x in fps.view(np.int64)]
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(0, len(fps), 7) for j in range(len(fps)))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (300, 300), (None, 5), (500, 501), (500, 502), (500, 503), (503, 504)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {200: 100} | {i: 500 for i in (501, 502, 503, 504)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_of_each_stays(spark):
    frame = documents(spark).withColumn("fingerprint", simhash.F.lit("x")).withColumn("component_id", simhash.F.lit(0))
    out = simhash.keep_one_each(frame)
    lead = {r.component_id for r in simhash.near_duplicates(documents(spark)).where("doc_id is not null").collect()}
    assert out.columns == frame.columns and {r.doc_id for r in out.where("doc_id is not null").collect()} == lead
    assert out.where("doc_id is null").count() == 1


def test_empty_table(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
