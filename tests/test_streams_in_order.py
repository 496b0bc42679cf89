"""Streams with event time give the batch answer, however they are cut into batches and whatever comes late."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.config import Resilience
from corpusloom.operators import state
from corpusloom.streaming import ordered as streaming

START = datetime.datetime(2024, 1, 1)


def replayed(spark, tmp_path, rows, schema, transform, seed, name):
    """The stream of ``rows`` (with ts at the end), late by at most some 8 minutes, cut anywhere; two rows far ahead end it."""
    rng, path = random.Random(seed), str(tmp_path / name)
    rows = sorted(rows, key=lambda r: r[-1].timestamp() + rng.random() * 400)
    cuts = sorted(rng.sample(range(1, len(rows)), 2))
    batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    last = max(r[-1] for r in rows)
    for i in (1, 2):
        batches.append([("end", *rows[0][1:-1], last + datetime.timedelta(days=i))])
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)
    query = transform(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", path + "-checkpoint").trigger(availableNow=True).start()
    assert query.awaitTermination(200)
    return spark.table(name).where(F.col(spark.table(name).columns[0]) != "end").collect()


@pytest.fixture(autouse=True)
def one_partition(spark):
    """A state store and a Python worker for each partition and batch take most of the time."""
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def events(seed, n=150):
    rng, at, out = random.Random(seed), 0.0, []
    for i in range(n):
        at += rng.choice((1, 5, rng.randint(1, 40)))
        out.append((i, rng.choice("aab"), at, rng.random() < 0.85))
    return out


def test_breaker(spark, tmp_path):
    settings, rows = Resilience(breaker_seconds=20), events(4)
    stream = [(k, at, failed, START + datetime.timedelta(seconds=at)) for _, k, at, failed in rows]
    got = replayed(spark, tmp_path, stream, "model string, at double, failed boolean, ts timestamp", lambda s: streaming.breaker(s, settings), 1, "ordered_breaker")
    frame = spark.createDataFrame(rows, "id long, model string, at double, failed boolean")
    want = {(r.model, r.at): (r.allowed, r.state) for r in state.breaker(frame, "model", ("id",), F.col("at"), F.col("failed"), settings).collect()}
    assert {(r.model, r.at): (r.allowed, r.state) for r in got if r.allowed is not None} == want
    told = sorted((r.model, r.at) for r in got if r.allowed is None)
    assert told == sorted((k, at + 20) for (k, at), (allowed, mode) in want.items() if mode == "OPEN" and allowed) and len(told) > 3


def test_idempotency_and_forgetting(spark, tmp_path):
    rng, rows, at = random.Random(3), [], 0
    for i in range(120):
        at += rng.randint(1, 9)
        rows.append((rng.choice("tuv"), i, rng.choice(("request", "request", "success", "failure")), START + datetime.timedelta(seconds=at)))
    want, machines, last = {}, {}, {}
    for task, seq, kind, ts in rows:
        if task in last and (ts - last[task]).total_seconds() > 30:
            machines.pop(task)
        want[seq] = machines.setdefault(task, state.Request()).event(kind)
        last[task] = ts
    got = replayed(spark, tmp_path, rows, "task_id string, seq long, kind string, ts timestamp", lambda s: streaming.idempotent(s, idle=30), 2, "ordered_requests")
    assert {r.seq: r.action for r in got} == want


def test_slots(spark, tmp_path):
    rng, rows, want, merged = random.Random(5), [], {}, {}
    for i in range(60):
        session, slots = rng.choice("pq"), rng.choice(({"year": str(2000 + i)}, {"dept": f" d{i} ", "year": ""}, {}))
        merged.setdefault(session, {}).update({k: v.strip() for k, v in slots.items() if v})
        want[i] = dict(merged[session])
        rows.append((session, i, slots, START + datetime.timedelta(seconds=7 * i)))
    got = replayed(spark, tmp_path, rows, "session_id string, seq long, slots map<string,string>, ts timestamp", lambda s: streaming.session_slots(s), 3, "ordered_slots")
    assert {r.seq: r.slots for r in got} == want
