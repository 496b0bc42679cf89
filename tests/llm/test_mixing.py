"""The mix against a plain version: targets, limits, cuts, the order of the stream, and plans without Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import mixing
from tests.llm.helpers import SCHEMA, corpus, documents, words


def filled(sizes, weights, budget):
    """Targets by pouring: what a full source can't take goes to the others by weight."""
    full = set()
    while True:
        rest = sum(weights[k] for k in sizes if k not in full)
        unit = (budget - sum(3 * sizes[k] for k in full)) / rest if rest else 0
        new = {k for k in sizes if k in full or 3 * sizes[k] <= unit * weights[k]}
        if new == full or not rest:
            return {k: float(3 * sizes[k]) if k in full else unit * weights[k] for k in sizes}
        full = new


def plain(rows, budget=None):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = {s: sum(len(words(r[1])) for r in rows if r[3] == s) for s in sources}
    budget = sum(sizes.values()) if budget is None else budget
    targets = filled(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}, budget)
    out = []
    for s in sources:
        key = lambda r: (hashlib.md5(f"{'' if r[0] is None else r[0]}|{r[1] or ''}".encode()).hexdigest(), r[0] or 0)
        own, sent, left = sorted((r for r in rows if r[3] == s), key=key), [], int(targets[s])
        for _ in range(3):
            for i, r in enumerate(own):
                take = min(len(words(r[1])), left)
                left -= take
                sent.append((i, take))
        out += [(r[0], len(words(r[1])), sizes[s], round(targets[s], 6), sum(t for j, t in sent if j == i)) for i, r in enumerate(own)]
    return sorted(out, key=str)


def got(frame):
    return sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in frame.collect()), key=str)


@pytest.mark.parametrize("rows", [corpus(), corpus()[:1], [(i, None, "en", None, 0) for i in range(4)], [(i, "a b c " * i, "en", None if i == 4 else "ÀZ𐀀é"[i % 4], 0) for i in range(40)]])
def test_like_the_plain_version(spark, rows):
    assert got(mixing.mix(documents(spark, rows))) == plain(rows)


def test_limits_and_budgets(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(0, 90), "en", f"s{int(rng.random() ** 3 * 9)}", 0) for i in range(400)] + [(999, "w " * 9000, "en", "s8", 0)]
    for budget in (None, 100, 40_000):
        found = got(mixing.mix(documents(spark, rows), budget))
        assert found == plain(rows, budget) and all(r[4] <= 3 * r[1] for r in found)
        if budget == 100:
            assert 90 < sum(r[4] for r in found) <= 100


def test_sources_are_mixed_evenly_all_along(spark):
    rows = [(i, "w " * (1 + i % 7), "en", f"s{i % 5}", 0) for i in range(2000)]
    queued, budget = mixing.queue(documents(spark, rows))
    stream = sorted(mixing.stream(queued, budget).collect(), key=lambda r: r.position)
    assert [r.position for r in stream] == [sum(x.words for x in stream[:i]) for i in range(len(stream))]
    assert [r.finish for r in stream] == sorted(r.finish for r in stream) and stream[-1].finish <= 1
    targets = {r.source: r.target for r in queued.select("source", "target").distinct().collect()}
    for part in (0.25, 0.5, 0.75):
        taken = {}
        for r in stream[: int(len(stream) * part)]:
            taken[r.source] = taken.get(r.source, 0) + r.words
        time = stream[int(len(stream) * part)].finish
        assert all(abs(taken[s] - time * t) < 20 for s, t in targets.items())


def test_reruns_agree_and_plans_have_no_python(spark):
    frame = documents(spark)
    assert got(mixing.mix(frame.repartition(7))) == got(mixing.mix(frame.coalesce(1)))
    plan = mixing.mix(frame)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_clashing_columns_and_no_rows(spark):
    frame = documents(spark)
    more = frame.select("*", *[F.lit("clash").alias(x) for x in "key size shuffle slot row target taken copy sent words finish tick position place weight most start before n".split()])
    assert got(mixing.mix(more)) == got(mixing.mix(frame)) and mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
