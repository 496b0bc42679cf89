"""Codes and codebooks against a plain version, with ties, repeated rows, odd sizes and unusable vectors."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from corpusloom.llm import vectorcodes

SCHEMA = "vec_id long, embedding array<float>, label int"


def data(n=300, size=32, seed=3):
    rng = random.Random(seed)
    rows = [(i, [rng.choice((0.0, 0.5, -0.25, rng.gauss(0, 0.2))) for _ in range(size)], rng.choice((None, 0, 1))) for i in range(n)]
    rows += [rows[5]] * 100 + [(n, None, 1), (n + 1, [math.nan] + [0.0] * (size - 1), 1), (n + 2, [None] + [0.0] * (size - 1), 0), (n + 3, [math.inf] * size, 0), (None, [0.1] * size, None)]
    rng.shuffle(rows)
    return rows


def plain(rows, parts=16, entries=64, rounds=2):
    size = next(len(r[1]) for r in rows if r[1] is not None)
    kept = [(i, [math.floor(Fraction(float(np.float32(x))) * 256) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    edges = [k * size // parts for k in range(parts + 1)]
    cut = [[tuple(v[a:b]) for a, b in zip(edges, edges[1:])] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    distance = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    nearest = lambda p, x: min((distance(x, c), j) for j, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            owners = {}
            for c in cut:
                owners.setdefault(nearest(p, c[p])[1], []).append(c[p])
            books[p] = [tuple(sum(x) // len(owners[j]) for x in zip(*owners[j])) if j in owners else c for j, c in enumerate(books[p])]
    found = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    sums = {}
    for (_, _, label), f in zip(kept, found, strict=True):
        sums[label] = sums.get(label, 0) + sum(d for d, _ in f)
    name = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted(((i, "".join(f"{j:02x}" for _, j in f), sum(d for d, _ in f), sums[label], name) for (i, _, label), f in zip(kept, found, strict=True)), key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


@pytest.mark.parametrize("size", [32, 35, 5])
def test_like_the_plain_version(spark, size, monkeypatch):
    monkeypatch.setattr(vectorcodes, "COMPONENTS", 50 * size)
    rows = data(size=size)
    assert got(vectorcodes.compress(spark.createDataFrame(rows, SCHEMA).repartition(3))) == plain(rows)


def test_fewer_vectors_than_entries(spark):
    rows = data(n=20)[:30]
    assert got(vectorcodes.compress(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_walk_in_blocks():
    rng = np.random.default_rng(2)
    rows, book = rng.integers(-4, 4, (500, 5)), rng.integers(-4, 4, (9, 5))
    leaves, which, weight = vectorcodes.distinct(rows)
    assert (leaves[which] == rows).all() and weight.sum() == 500 and leaves.tolist() == sorted(map(list, {tuple(r) for r in rows.tolist()}))
    want = ((leaves[:, None] - book[None]) ** 2).sum(axis=2)
    for at_once in (1, 7, 4096):
        nearest, distance = vectorcodes.walk(leaves, book, at_once)
        assert (nearest == want.argmin(axis=1)).all() and (distance == want.min(axis=1)).all()


def test_sizes_apart_and_extremes(spark):
    small, large = data(n=90, size=16), [(1000 + i, [1e30, -1e30, 3e38] + [0.0] * 29, 7) for i in range(3)]
    rows = small + large + [(5000, [], 9), (5001, [], None)]
    found = {r.vec_id: r for r in vectorcodes.compress(spark.createDataFrame(rows, SCHEMA)).collect() if r.vec_id is not None}
    assert (found[1001].error, found[1001].label_error) == (0, 0) and found[1001].code == "00" * 16 and found[5000].error == 0
    assert found[3].codebooks_sha256 == plain(small)[0][4] != found[1001].codebooks_sha256


def test_clashing_columns_and_no_rows(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(data(n=80), SCHEMA)
    more = frame.select("*", *[F.lit("clash").alias(x) for x in "id vector key code error slot total size n part label_error codebooks_sha256".split()])
    assert got(vectorcodes.compress(more)) == got(vectorcodes.compress(frame)) and vectorcodes.compress(more.where("false")).count() == 0
