import datetime
import random

from pyspark.sql import functions as F

from corpusloom import providers
from corpusloom.config import Settings
from corpusloom.operators import incremental, state
from corpusloom.sources import readers, sinks
from corpusloom.store import Store
from corpusloom.streaming import state as streaming


def test_files(spark):
    known = spark.createDataFrame([("t", "a", "parsed"), ("t", "b", "pending"), ("u", "c", "parsed")], "tenant string, file_sha256 string, parse_status string")
    incoming = spark.createDataFrame([("t", "a"), ("t", "b"), ("t", "c")], "tenant string, file_sha256 string")
    assert {r.file_sha256: r.action for r in incremental.file_action(incoming, known).collect()} == {"a": "skip", "b": "reparse", "c": "create"}
    assert {r.file_sha256 for r in incremental.new_files(incoming, known).collect()} == {"b", "c"}


def test_reuse_counts_only_what_was_stored_before(spark):
    batch = spark.createDataFrame([(1, "t", "x"), (2, "t", "x"), (3, "t", "y")], "id long, tenant string, content_sha256 string")
    stored = spark.createDataFrame([(9, "t", "y"), (8, "u", "x")], "id long, tenant string, content_sha256 string")
    row = incremental.reuse_counters(incremental.mark_reuse(batch, stored), ("tenant",)).first()
    assert (row.total, row.reused_chunks, row.new_chunks) == (3, 1, 2)


def test_versions(spark):
    digests = spark.createDataFrame([(1, "d"), (2, "e")], "document_id long, content_sha256 string")
    versions = spark.createDataFrame([(1, 1), (1, 2)], "document_id long, version_no int")
    assert {r.document_id: r.version_no for r in incremental.next_versions(digests, versions).collect()} == {1: 3, 2: 1}
    assert [r.version_no for r in incremental.current(versions, "document_id").collect()] == [2]


def test_cascade(spark):
    stored = {
        "documents": spark.createDataFrame([(1,), (2,)], "document_id long"),
        "chunks": spark.createDataFrame([(1, 10), (2, 20)], "document_id long, chunk_id long"),
        "embeddings": spark.createDataFrame([(10,), (20,)], "chunk_id long"),
        "citations": spark.createDataFrame([(10, 1)], "chunk_id long, request_id long"),
    }
    left = incremental.cascade_delete(stored, spark.createDataFrame([(1,)], "document_id long"))
    assert {k: v.count() for k, v in left.items()} == {"documents": 1, "chunks": 1, "embeddings": 1, "citations": 0}
    assert incremental.orphans(left["embeddings"], left["chunks"], "chunk_id").count() == 0


def test_breaker_steps():
    machine = state.Breaker()
    assert [machine.call(t, True)[1] for t in range(5)] == ["CLOSED"] * 4 + ["OPEN"]
    assert machine.call(30, True) == (False, "OPEN")
    assert machine.call(64, True) == (True, "OPEN") and machine.call(100, False) == (False, "OPEN")
    assert machine.call(124, False) == (True, "CLOSED") and machine.failures == 0


def test_breaker_of_many_keys(spark):
    rng = random.Random(6)
    events = [(i, rng.choice("abc"), float(i * rng.randint(1, 9)), rng.random() < 0.8) for i in range(400)]
    want, machines = {}, {}
    for i, key, at, failed in sorted(events, key=lambda e: (e[2], e[0])):
        want[i] = machines.setdefault(key, state.Breaker()).call(at, failed)
    frame = spark.createDataFrame(events, "id long, key string, at double, failed boolean")
    got = {r.id: (r.allowed, r.state) for r in state.breaker(frame, "key", ("at", "id"), F.col("at"), F.col("failed")).collect()}
    assert got == want and len({x[1] for x in got.values()}) >= 2


def test_replay(spark):
    rows = [(1, "a", False), (2, "a", True), (3, "a", False), (4, "b", True)]
    frame = spark.createDataFrame(rows, "seq int, task string, ok boolean")
    got = {r.seq: r.action for r in state.replay(frame, F.col("task"), ("seq",), F.col("ok")).collect()}
    assert got == {1: "run", 2: "run", 3: "cached", 4: "run"}


def stream(spark, tmp_path, rows, schema, transform, name):
    path = str(tmp_path / name)
    for batch in rows:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = transform(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", path + "-checkpoint").trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    return spark.table(name).collect()


def test_streaming_idempotency(spark, tmp_path):
    batches = [[("t", 1, "request"), ("t", 2, "request"), ("u", 1, "request")], [("t", 3, "failure"), ("t", 4, "request"), ("t", 5, "success"), ("t", 6, "request")]]
    got = {(r.task_id, r.seq): r.action for r in stream(spark, tmp_path, batches, "task_id string, seq long, kind string", streaming.idempotent, "idempotent")}
    assert got == {("t", 1): "run", ("t", 2): "duplicate", ("u", 1): "run", ("t", 3): "done", ("t", 4): "run", ("t", 5): "done", ("t", 6): "cached"}


def test_streaming_breaker_is_the_batch_one(spark, tmp_path):
    calls = [("m", float(t), True) for t in range(6)] + [("m", 70.0, False), ("m", 71.0, True)]
    machine = state.Breaker()
    want = [machine.call(a, f) for _, a, f in calls]
    got = stream(spark, tmp_path, [calls[:3], calls[3:]], "model string, at double, failed boolean", streaming.breaker, "breaker")
    assert [(r.allowed, r.state) for r in sorted(got, key=lambda r: r.at)] == want


def test_streaming_slots(spark, tmp_path):
    batches = [[("s", 1, {"year": "2024"})], [("s", 2, {"dept": " A ", "year": ""}), (None, 3, {"year": "1"})]]
    got = stream(spark, tmp_path, batches, "session_id string, seq long, slots map<string,string>", streaming.session_slots, "slots")
    assert {r.seq: r.slots for r in got} == {1: {"year": "2024"}, 2: {"year": "2024", "dept": "A"}}


def test_answers_of_batches_count_once(spark, tmp_path):
    path, store = str(tmp_path / "in"), Store(spark, str(tmp_path / "out"))
    for ids in ((0, 1, 2), (2, 3)):
        spark.createDataFrame([(i,) for i in ids], "id long").coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(path)
    said = lambda b: b.distinct().withColumn("answer", F.lit("x"))
    for checkpoint in ("c", "d"):  # the second run sends the same batches again
        streaming.answer_batches(source, said, store, "answers", ("id",), str(tmp_path / checkpoint)).awaitTermination(90)
        assert sorted(r.id for r in store.latest("answers", ("id",)).collect()) == [0, 1, 2, 3]
    assert store.version() == 2


def test_first_requests(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    got = stream(spark, tmp_path, [[("a", at), ("a", at)], [("a", at), ("b", at)]], "task_id string, ts timestamp", streaming.first_requests, "firsts")
    assert sorted(r.task_id for r in got) == ["a", "b"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "files").mkdir()
    (tmp_path / "files/a.pdf").write_bytes(b"one\n12\fpage two")
    (tmp_path / "files/b.PDF").write_bytes(b"\xff")
    (tmp_path / "files/c.txt").write_bytes(b"no")
    files = readers.binary_files(spark, str(tmp_path / "files"))
    pages = providers.parse_files(files, providers.FormFeedParser()).collect()
    assert files.count() == 2 and sorted((r.page_no, r.text) for r in pages if r.path.endswith("a.pdf")) == [(1, "one"), (2, "page two")]
    raw = spark.createDataFrame([("s", ': hi\n\ndata: {"type":"answer","answer":"x"}\n\ndata: [DONE]\n\n')], "id string, raw string")
    events = readers.sse_events(raw, "raw", "type string, answer string").collect()
    assert [(r.seq, r.payload.answer) for r in events] == [(1, "x")]
    good, bad = readers.requests(spark.createDataFrame([("q", 5), ("", 5), ("q", 21), (None, 1), ("q" * 1001, 1)], "query string, top_k int"))
    assert good.count() == 1 and bad.count() == 4
    log = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "id int, seq int, status string")
    assert {r.id: r.status for r in sinks.latest(log, ("id",), F.col("seq")).collect()} == {1: "b", 2: "c"}
    sinks.append(log, str(tmp_path / "log"))
    sinks.append(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 6
    assert log.limit(1).select(sinks.sse_line(F.struct("id")).alias("l")).first()["l"] == 'data: {"id":1}\n\n'
    assert [r.b for r in spark.createDataFrame([("/a/b_1.pdf",), ("c:\\x\\y.pdf",)], "u string").select(readers.base_name(F.col("u")).alias("b")).collect()] == ["b_1.pdf", "y.pdf"]


def test_providers(spark):
    frame = spark.createDataFrame([("alpha beta 2024",), ("",), (None,)], "query string")
    vectors = [r.vector for r in providers.HashingEmbedder(8).embed(frame, "query").collect()]
    assert abs(sum(x * x for x in vectors[0]) - 1) < 1e-6 and vectors[1] is None and vectors[2] is None
    assert providers.rewrite(frame).first()["years"] == [2024]
    raw = spark.createDataFrame([('```json\n{"primary_query":"p","rewritten_queries":["a"],"extracted_years":[2023,"2024","x"]}\n```', "q"), ("what?", "q"), ("nothing", "q")], "raw string, q string")
    got = [r.p for r in raw.select(providers.parsed_rewrite(F.col("raw"), F.col("q")).alias("p")).collect()]
    assert got[0].primary_query == "p" and got[0].extracted_years == [2023, 2024] and got[0].rewritten_queries == ["a", "q", "q 详细信息"]
    assert got[1].primary_query == "what?" and got[2].primary_query == "q"
    plain = spark.createDataFrame([("Primary Query: net margin of 2023\nmore", "q"), ("I'd ask 'how much' here", "q")], "raw string, q string")
    assert [r.p.primary_query for r in plain.select(providers.parsed_rewrite(F.col("raw"), F.col("q")).alias("p")).collect()] == ["net margin of 2023", "d ask "]
    passages = spark.createDataFrame([([(1, "x"), (2, "y")],)], "p array<struct<chunk_id:long,content:string>>")
    assert providers.ExtractiveGenerator().answer(passages, "", "p").first()["answer"] == "x [Chunk 1]\ny [Chunk 2]"
    waits, calls = [], iter([TimeoutError("t"), ConnectionError("c"), "ok"])

    def call():
        value = next(calls)
        if isinstance(value, Exception):
            raise value
        return value

    result, events = providers.with_retries(call, waits.append)
    assert result == "ok" and waits == [1, 2] and [e["http_status"] for e in events] == [None, None] and [e["event_type"] for e in events] == ["timeout", "fallback"]


def test_settings():
    assert Settings.from_nested({"retrieval": {"top_k": 7, "unknown": 1}}).retrieval.top_k == 7 and Settings.from_nested({}) == Settings()
