"""Server-sent events in pieces: files are never held whole, and pieces give what the whole text gives."""

import os
import random

import pyarrow as pa
import pytest

from corpusloom.sources import sse

BITS = ["data: a", "data:b", "data", "event: x", "event:", "\n", "\n", "\n\n", "\r\n", "\r", "\r\n\r\n", ": c", "data: [DONE]", "é", "中", " ", "id: 3"]


def test_pieces_give_what_the_whole_text_gives(monkeypatch):
    rng = random.Random(3)
    for _ in range(300):
        raw = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 14))).encode()
        raw = raw[: rng.randint(0, len(raw))] + b"\xe4" * rng.randint(0, 1) + raw
        for size in (1, 3, 1 << 20):
            monkeypatch.setattr(sse, "PIECE_BYTES", size)
            got = [x for text in sse._pieces(pa.BufferReader(raw)) for x in zip(*(c.to_pylist() for c in sse._columns(text)), strict=True)]
            assert got == list(sse.parse(raw.decode("utf-8", "replace"))), raw


@pytest.mark.parametrize("compression", ["none", "gzip", "zstd"])
def test_a_long_file_is_read_and_written_in_pieces(spark, tmp_path, monkeypatch, compression):
    folder = str(tmp_path / "events")
    batches = [pa.record_batch({"event": ["answer"] * 1000, "data": [f'{{"n":{i}}}' + "x" * 990 for i in range(k * 1000, k * 1000 + 1000)]}) for k in range(20)]
    monkeypatch.setattr(sse, "FILE_BYTES", 15_000_000)
    writer = sse._Writer(folder, compression, False)
    writer.commit([writer.write(iter(batches)), writer.write(iter([]))])
    names = sorted(os.listdir(folder))
    assert len(names) == 2 and all(x.endswith(sse.ENDS[compression]) for x in names)
    before, found, n = pa.total_allocated_bytes(), [], 0
    for name in names:
        for seq, batch in enumerate(sse._rows(f"{folder}/{name}")):
            assert batch.nbytes < 3 * sse.PIECE_BYTES and pa.total_allocated_bytes() - before < 12 * sse.PIECE_BYTES, seq
            found += [x.split("}")[0] for x in batch.column("data").to_pylist()]
            n += batch.num_rows
    assert found == [f'{{"n":{i}' for i in range(n)] and n == 20_000
    spark.dataSource.register(sse.ServerSentEvents)
    assert spark.read.format("sse").load(folder).selectExpr("count(*)", "max(seq)", "count(DISTINCT data)").first()[0::2] == (n, n)


def test_odd_events(spark, tmp_path):
    folder = str(tmp_path / "odd")
    spark.dataSource.register(sse.ServerSentEvents)
    rows = [("answer", "a\n\nb"), (None, "x" * 3_000_000), ("", ""), ("e", "中\n")]
    frame = spark.createDataFrame(rows, "event string, data string")
    frame.coalesce(1).write.format("sse").option("compression", "zstd").mode("append").save(folder)
    frame.select("data").coalesce(1).write.format("sse").mode("append").save(folder)
    got = [(r.event, r.data) for r in spark.read.format("sse").load(folder).orderBy("file", "seq").collect()]
    assert got == [*rows, *[(None, d) for _, d in rows]]
    for bad in (frame.selectExpr("event", "nullif(data, '') AS data").write.format("sse"), frame.write.format("sse").option("compression", "lzw")):
        with pytest.raises(Exception, match="an event needs data|compression is one of"):
            bad.mode("append").save(folder)
    assert spark.read.format("sse").load(folder).count() == 8
