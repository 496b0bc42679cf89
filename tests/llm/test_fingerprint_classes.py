"""The near-duplicate stage finds near copies by their fingerprints, also without keys of shingles."""

import random

import numpy as np

import corpus_pipeline
from corpusloom.llm import nearcopies, simhash
from tests.llm.helpers import documents
from tests.llm.test_nearcopies import brute_leaders, brute_set, near_corpus
from tests.llm.test_simhash import brute_print, union_find


def chains():
    """Texts of 300 words, each one or a few words and at most three bits from the one before; the ends aren't near copies."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = []
    for _ in range(3):
        own = [word() for _ in range(300)]
        texts.append(own)
        for at in range(5, 290, 19):
            near = own
            while near is own or (brute_print(" ".join(near)) ^ brute_print(" ".join(own))).bit_count() > 3:
                near = own[:at] + [word()] + own[at + 1 :]
            own = near
            texts.append(own)
    rng.shuffle(texts)
    return [(i, " ".join(x), "en", "s", None) for i, x in enumerate(texts)]


def leaders_by_fingerprint(rows):
    """The leading documents where only pairs of one class of fingerprints are held against each other."""
    prints, sets, n = [brute_print(r[1]) for r in rows], [brute_set(r[1]) for r in rows], range(len(rows))
    own = union_find([(i, j) for i in n for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3], n)
    near = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    root = union_find([(i, j) for i in n for j in range(i) if own[i] == own[j] and near(sets[i], sets[j])], n)
    return {min(rows[j][0] for j in n if root[j] == root[i]) for i in n}


def kept(spark, rows):
    return {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, documents(spark, rows), "").collect()}


def test_fingerprints_alone(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "band_keys", lambda own: np.zeros(0, np.int64))
    rows = chains()
    assert kept(spark, rows) == leaders_by_fingerprint(rows) == brute_leaders(rows) and len(brute_leaders(rows)) == 3
    sets = [brute_set(r[1]) for r in rows]
    assert any(min(5 * len(a & b) - 4 * len(a | b) for b in sets if a & b) < 0 for a in sets)  # a class's texts aren't all near its lead
    rows = near_corpus()
    assert kept(spark, rows) == leaders_by_fingerprint(rows) and len(rows) > len(leaders_by_fingerprint(rows)) > len(brute_leaders(rows))


def test_one_class_of_texts_that_are_not_alike(spark, monkeypatch):
    """Fingerprints propose and shingles decide."""
    monkeypatch.setattr(simhash, "fingerprint", lambda text: 7)
    rows = near_corpus()
    assert kept(spark, rows) == brute_leaders(rows)


def test_texts_without_words(spark):
    rows = [(i, t, "en", "s", None) for i, t in enumerate(["", None, " \n", "one", "two"])]
    assert kept(spark, rows) == {0, 3, 4}
