import random

import numpy as np

from corpusloom.llm import nearcopies, simhash
from tests.llm.helpers import corpus, documents, words
from tests.llm.test_simhash import union_find


def brute_set(text):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in words(text)]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_leaders(rows):
    sets = [brute_set(r[1]) for r in rows]
    near = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    root = union_find([(i, j) for i in range(len(rows)) for j in range(i) if near(sets[i], sets[j])], range(len(rows)))
    ids = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[root[i]] = min(ids.get(root[i], r[0]), r[0])
    return set(ids.values())


def near_corpus():
    """Twenty texts, each with four copies that differ in a few words, and chains whose ends aren't near."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for _ in range(20):
        base = [word() for _ in range(rng.randint(60, 200))]
        rows.append(base)
        for k in range(1, 5):
            copy = list(base)
            for at in rng.sample(range(len(base)), max(1, k * len(base) // 250)):
                copy[at] = word()
            rows.append(copy)
        rows.append(rows[-1][:-6] + [word() for _ in range(6)])
    rng.shuffle(rows)
    return [(i, " ".join(x), None, None, None) for i, x in enumerate(rows)]


def test_keep_one_each_like_brute_force(spark):
    rows = near_corpus()
    got = {r.doc_id for r in simhash.keep_one_each(documents(spark, rows)).collect()}
    assert got == brute_leaders(rows)
    prints = {r.component_id for r in simhash.near_duplicates(documents(spark, rows)).collect()}
    assert len(prints) > len(got)  # three bits leave near copies


def test_odd_rows_like_brute_force(spark):
    rows = corpus()
    got = {r.doc_id for r in simhash.keep_one_each(documents(spark, rows)).collect() if r.doc_id is not None}
    assert got == brute_leaders(rows)


def test_nearly_all_pairs_meet_at_the_threshold():
    rng = np.random.default_rng(2)
    met = 0
    for _ in range(1000):
        x = rng.integers(0, 1 << 63, 225, np.uint64)
        met += bool((nearcopies.band_keys(x[:200]) == nearcopies.band_keys(np.r_[x[:200][25:], x[200:]])).any())  # 175 of 225: 0.78
    assert met >= 980


def test_many_blocks_under_one_key(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "BLOCK_ROWS", 2)
    rows = near_corpus()
    assert {r.doc_id for r in simhash.keep_one_each(documents(spark, rows)).collect()} == brute_leaders(rows)


def test_links_between_components_like_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(20):
        base = rng.integers(0, 1 << 63, 60, np.uint64)
        sets = [np.unique(np.r_[rng.choice(base, rng.integers(53, 60), replace=False), rng.integers(0, 1 << 63, rng.integers(0, 5), np.uint64)]) for _ in range(30)]
        sig, root = rng.permutation(30), rng.integers(0, 4, 30)
        pairs = [(i, j) for i in range(30) for j in range(i) if root[i] != root[j] and nearcopies.similar(sets[i], sets[j])]
        want = union_find([(sig[i], sig[j]) for i, j in pairs], range(30))
        got = union_find(list(zip(*(x.tolist() for x in nearcopies.cross_links(sets, sig, root)))), range(30))
        assert want == got and pairs
