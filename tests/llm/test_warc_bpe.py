import gzip
import hashlib
import io

import numpy as np
import public_tokenizers
import tiktoken

from corpusloom.llm import bpe, warc
from corpusloom.llm.common import scratch
from tests.llm.helpers import corpus, documents

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def pages():
    big, other = "<p>" + "é\r\n\r\nWARC/1.1\r\n" * 90, "x" * 1000
    rows = [(i, f"http://a/{i}", big) for i in range(12)] + [(20, "u", other), (21, "u\r\nX: y", other), (22, "u", "x" * 999), (23, "u", "x" * 999), (24, None, None), (25, "", "")]
    return rows + [rows[11], (None, "n", big), (30, "u", "only one " * 200)]


def test_archives_round_trip(spark):
    path = scratch(spark, "test-warc")
    out = warc.rewrite(spark.createDataFrame(pages(), "page_id long, url string, html string"), path).collect()
    want = []
    for page, _, html in pages():
        data = (html or "").encode()
        lead = max((p for p, _, h in pages() if p is not None and (h or "").encode() == data), default=None)
        revisit = len(data) >= 1000 and page != lead
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", lead if revisit else None))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r) for r in out), key=key) == sorted(want, key=key)
    found = spark.read.format("binaryFile").load(path).where("length > 0").count()
    assert found > 0


def test_large_pages_and_small_archives(spark):
    rng = np.random.default_rng(8)
    big = ["".join(map(chr, rng.integers(0x20, 0x3000, 1_500_000))) for _ in range(2)]
    rows = [(i, f"http://a/{i}", big[i % 3]) if i % 3 < 2 else (i, "u", f"small {i}") for i in range(9)]
    path = scratch(spark, "test-warc")
    resolved = warc.resolve(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    warc.write_archives(resolved, path, archive_bytes=1 << 20)
    files = spark.read.format("binaryFile").load(path).where("path like '%part-%'").collect()
    sizes = [[len(list(warc.records(io.BytesIO(x)))) for x in warc.members(memoryview(f.content))] for f in files]
    assert all(max(own) == 1 and own[-1] == 0 for own in sizes) and sum(map(sum, sizes)) == 9 and len(files) > 1
    assert all(gzip.decompress(f.content).count(b"WARC-Record-ID") == sum(own) for f, own in zip(files, sizes))
    got = sorted(tuple(r) for r in warc.join_revisits(warc.read_archives(spark, path)).collect())
    lead = {0: 6, 1: 7}
    assert got == [(i, len(h.encode()), hashlib.sha1(h.encode()).hexdigest(), "revisit" if lead.get(i % 3, i) != i else "response", lead[i % 3] if lead.get(i % 3, i) != i else None) for i, _, h in rows]


def test_more_revisits_than_may_be_broadcast(spark):
    frame = spark.createDataFrame(pages(), "page_id long, url string, html string").withColumn("digest", warc.F.lit(1)).withColumn("first", warc.F.lit(2))
    assert sorted(map(tuple, warc.resolve(frame, broadcast_rows=0).collect()), key=str) == sorted(map(tuple, warc.resolve(frame).collect()), key=str)


def test_no_pages(spark):
    assert warc.rewrite(spark.createDataFrame([], "page_id long, url string, html string"), scratch(spark, "test-warc")).count() == 0


def test_broken_archives_are_errors():
    good = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, b in warc.records(io.BytesIO(good * 2))] == [b"abc"] * 2
    for bad in (b"junk" + good, good[:32]):
        try:
            list(warc.records(io.BytesIO(bad)))
        except ValueError:
            continue
        raise AssertionError("no error")


def long_texts():
    rng = np.random.default_rng(2)
    pieces = ["don't", "é", "漢字", "   ", "\n\n\n", " 12345", "'s", "x" * 90, "\t", "!!!", "a", " word", " ", "\x1c"]
    texts = ["".join(pieces[i] for i in rng.integers(0, len(pieces), n)) for n in (10, 300, 900, 901)]
    return [*texts, "y" * 1000, " " * 700, "z z" * 300, "", "ab " + "\n" * 400 + "c" * 300]


def test_chunks_encode_like_whole_texts(spark):
    ranks = bpe._ranks(RANKS)
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(i, t, None, None, None) for i, t in enumerate(long_texts())] + [(100 + i, t, *r) for i, (_, t, *r) in enumerate(corpus())] + [(None, long_texts()[2], None, None, None)]
    for chunk, overlap in ((64, 40), (200, 17), (32768, 1024)):
        out = bpe.decode(bpe.encode(documents(spark, rows), RANKS, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap), RANKS).collect()
        got = {r.doc_id: r for r in out}
        assert len(out) == len(rows)
        for i, text, *_ in rows:
            ids = whole.encode_ordinary(text or "")
            assert np.frombuffer(got[i].ids, "<u4").tolist() == ids and got[i].n_tokens == len(ids)
            assert bytes(got[i].decoded) == (text or "").encode()


def test_bpe_empty_table(spark):
    assert bpe.encode(documents(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_production_chunks_meet_in_long_texts(spark):
    ranks = bpe._ranks(RANKS)
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {0: " ".join(long_texts()) * 20, 1: "w" * (2 * bpe.CHUNK + 1), 2: ("ab, " * bpe.CHUNK)[: bpe.CHUNK + 1], 3: ("ab, " * bpe.CHUNK)[: bpe.CHUNK]}
    rows = [(i, t, None, None, None) for i, t in texts.items()]
    got = {r.doc_id: r.ids for r in bpe.encode(documents(spark, rows), RANKS, public_tokenizers.PATTERN).collect()}
    for i, text in texts.items():
        assert np.frombuffer(got[i], "<u4").tolist() == whole.encode_ordinary(text)
