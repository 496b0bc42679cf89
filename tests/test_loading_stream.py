"""A folder loaded in any split into batches gives the same store; events and table functions in SQL."""

import os
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import tables
from corpusloom.operators import chunking
from corpusloom.providers import FormFeedParser, HashingEmbedder
from corpusloom.sources import sse
from corpusloom.store import Store
from corpusloom.streaming import loading


class Parser(FormFeedParser):
    def pages(self, content):
        if content.startswith(b"broken"):
            raise ValueError("broken")
        return super().pages(content)


def texts(seed):
    rng = random.Random(seed)
    same = "\n\n".join("word " * rng.randint(1, 40) for _ in range(4))
    return {f"f{i}.{'pdf' if i % 2 else 'PDF'}": same if i % 4 == 0 else "broken" if i % 5 == 0 else f"page one {i}\n\n{same[:30]}\fpage two of {i}" for i in range(12)}


def contents(store):
    chunks = loading.live_chunks(store).select("tenant", "file_name", "chunk_no", "page_no", "content", "vector").collect()
    statuses = store.latest("documents", ("document_id",)).groupBy("parse_status").count().collect()
    return sorted(map(str, chunks)), sorted(map(tuple, statuses)), store.read("embeddings").count(), store.read("embeddings").select("content_sha256").distinct().count()


def test_any_split_gives_the_same_store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    files = texts(1)
    for k, (name, text) in enumerate(files.items()):
        (tmp_path / "in" / name).write_bytes(text.encode())
        os.utime(tmp_path / "in" / name, (k, k))
    (tmp_path / "in" / "not.txt").write_text("no")
    found = []
    for size in (100, 5):
        store = Store(spark, str(tmp_path / f"store{size}"))
        for _ in range(2):  # the second run has nothing left to load
            query = loading.load_folder(spark, str(tmp_path / "in"), store, Parser(), HashingEmbedder(8), str(tmp_path / f"checkpoint{size}"), files=size)
            assert query.awaitTermination(200)
        found.append(contents(store))
        log = store.read("index_builds").agg(F.sum("documents"), F.sum("failed"), F.sum("chunks")).first()
        distinct = set(files.values())
        assert log[0] - log[1] == len(distinct) - 1 and log[1] >= 1  # what is broken is tried again when it comes under another name
        want = sum(len([p for page in t.split("\f") for p in chunking.by_paragraphs(page)]) for t in distinct if t != "broken")
        assert log[2] == want == store.read("chunks").count()
    assert found[0] == found[1] and found[0][2] == found[0][3]


def test_overwriting_reuse_and_trying_again(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = lambda *x: spark.createDataFrame([("t", f"d/{n}", m, c.encode()) for n, m, c in x], "tenant string, path string, modified long, content binary")
    give = lambda number, *x: loading.load(store, rows(*x), Parser(), HashingEmbedder(8), ("s", number))
    give(0, ("a", 1, "first"), ("b", 1, "broken"), ("c", 1, "shared"))
    give(1, ("a", 3, "second"), ("b", 2, "mended"), ("d", 1, "shared"))
    give(1, ("a", 9, "never"))  # the batch's number has been
    give(2, ("a", 2, "late"))
    live = {r.file_name: r.content for r in loading.live_chunks(store).collect()}
    assert live == {"a": "second", "b": "mended", "c": "shared", "d": "shared"}
    assert [tuple(r) for r in store.read("index_builds").collect()].count((0, 0, 0, 0)) == 1 and store.version() == 3
    statuses = {r.parse_status for r in store.latest("documents", ("document_id",)).collect()}
    assert statuses == {"parsed", "failed"}


def test_events_as_a_source(spark, tmp_path):
    folder = str(tmp_path / "events")
    spark.dataSource.register(sse.ServerSentEvents)
    rows = [("answer", '{"a": 1}'), (None, "two\nlines"), ("x", "data: odd"), ("y", "")]
    frame = spark.createDataFrame(rows, "event string, data string")
    frame.coalesce(1).write.format("sse").mode("append").save(folder)
    frame.where("event is null").write.format("sse").mode("append").save(folder)
    read = lambda: [(r.event, r.data) for r in spark.read.format("sse").load(folder).orderBy("file", "seq").collect()]
    assert read() == [*rows, rows[1]]
    assert list(sse.parse(': hi\r\n\r\ndata: {"type":"x"}\r\n\r\ndata: [DONE]\n\n')) == [(None, '{"type":"x"}')]
    source = spark.readStream.format("sse").load(folder).select("event", "data")
    for _ in range(2):
        query = source.writeStream.format("sse").option("path", folder + "-copy").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    copied = [(r.event, r.data) for r in spark.read.format("sse").load(folder + "-copy").collect()]
    assert sorted(map(str, copied)) == sorted(map(str, [*rows, rows[1]]))
    frame.limit(1).write.format("sse").mode("overwrite").save(folder)
    assert read() == rows[:1] and not [x for x in os.listdir(folder) if x.startswith(".tmp")]


def test_table_functions(spark):
    tables.register(spark)
    spark.createDataFrame([(1, "one. two.\n\nthree", "x"), (2, None, "y"), (3, "w " * 600, "z")], "id long, body string, extra string").createOrReplaceTempView("docs")
    got = spark.sql("SELECT id, extra, piece, content, start, end FROM chunk_text(TABLE(docs), text => 'body', size => 300, overlap => 0)").collect()
    want = [(i, x, n, *c) for i, t, x in ((1, "one. two.\n\nthree", "x"), (3, "w " * 600, "z")) for n, c in enumerate(chunking.placed_by_paragraphs(t, 300, 0), 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM chunk_text(TABLE(docs))").collect()
    calls = [(m, float(i), (i + len(m)) % 7 != 0) for m in ("a", "bb") for i in range(40)]
    spark.createDataFrame(calls, "model string, at double, failed boolean").createOrReplaceTempView("calls")
    from corpusloom.operators.state import Breaker

    machines = {}
    want = sorted((m, a, *machines.setdefault(m, Breaker()).call(a, f)) for m, a, f in calls)
    got = spark.sql("SELECT model, at, allowed, state FROM breaker_states(TABLE(calls) PARTITION BY model ORDER BY at)").collect()
    assert sorted(map(tuple, got)) == want
