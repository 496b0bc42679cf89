"""Folds split within a key give what one fold over each key gives."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.config import Resilience
from corpusloom.operators import folds, state


def calls(seed, n=1500, keys="aaaaaaab", failing=0.8, step=9):
    rng, at = random.Random(seed), 0.0
    rows = []
    for i in range(n):
        at += rng.choice((0, 0.25, rng.random() * step))
        rows.append((i, rng.choice(keys), at, rng.random() < (failing if (i // 200) % 2 else 0.2)))
    return rows


def plain(rows, settings):
    machines, out, streaks, seen = {}, {}, {}, set()
    for i, key, at, failed in sorted(rows, key=lambda r: (r[2], r[0])):
        streaks[key] = streaks.get(key, 0) + 1 if failed else 0
        out[i] = (*machines.setdefault(key, state.Breaker()).call(at, failed, settings), streaks[key], "cached" if key in seen else "run")
        if not failed:
            seen.add(key)
    return out


@pytest.fixture
def split(spark):
    """Small tables stay in as many partitions as they are dealt to."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("seed, keys, failing, seconds", [(1, "aaaaaaab", 0.8, 60), (2, "a", 1.0, 7), (3, "abcdefghijklmnop", 0.9, 20), (4, ["a", "a", None], 0.95, 300)])
def test_one_hot_key(spark, split, seed, keys, failing, seconds):
    rows, settings = calls(seed, keys=keys, failing=failing), Resilience(breaker_seconds=seconds)
    want = plain(rows, settings)
    frame = spark.createDataFrame(rows, "id long, key string, at double, failed boolean").repartition(5)
    broken = state.breaker(frame, "key", ("id",), F.col("at"), F.col("failed"), settings)
    assert broken.rdd.getNumPartitions() == 13
    assert {r.id: (r.allowed, r.state) for r in broken.collect()} == {i: x[:2] for i, x in want.items()}
    assert {r.id: r.streak for r in state.failure_streaks(frame, "key", ("at", "id"), F.col("failed")).collect()} == {i: x[2] for i, x in want.items()}
    replayed = state.replay(frame, F.coalesce("key", F.lit("none")), ("at", "id"), ~F.col("failed")).collect()
    assert {r.id: r.action for r in replayed} == {i: x[3] for i, x in want.items()}


@pytest.mark.parametrize("seed", range(60))
def test_summaries_of_blocks_chain(seed):
    """Any cut of one key's calls into blocks: chained summaries give the state that folding them gives."""
    rng = random.Random(seed)
    machine = folds.Breakers(rng.choice((1, 2, 5)), rng.choice((0, 1, 7.5, 60)))
    rows = calls(seed, rng.choice((3, 40, 400)), "a", rng.random(), rng.choice((0.5, 9, 50)))
    at, bad = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    single, settings = state.Breaker(), Resilience(breaker_failures=machine.failures, breaker_seconds=machine.seconds)
    want = [single.call(a, b, settings) for a, b in zip(at, bad)]
    cuts, entry, got = sorted({0, len(at), *(rng.randrange(len(at)) for _ in range(6))}), machine.initial, []
    for a, b in zip(cuts, cuts[1:]):
        columns = [at[a:b], bad[a:b]]
        made, after = machine.run(columns, np.array([0]), entry)
        assert machine.after(json.loads(json.dumps(machine.summary(columns))), entry) == after
        entry = after
        got += list(zip(made[0].to_pylist(), made[1].to_pylist()))
    assert got == want


def test_no_events(spark):
    frame = spark.createDataFrame([], "id long, key string, at double, failed boolean")
    assert state.breaker(frame, "key", ("id",), F.col("at"), F.col("failed")).count() == 0
