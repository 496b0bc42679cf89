import hashlib
import json
import random

from pyspark.sql import functions as F

from corpusloom.operators import chunking, tables
from corpusloom.schemas import TABLE_DATA


def test_sentence_chunks():
    cases = [
        ("aaaa aaaa. bbbb bbbb. cccc cccc.", 20, 5, ["aaaa aaaa.", "aaaa. bbbb bbbb.", "bbbb. cccc cccc."]),
        ("pi 3.14 ok", 5, 5, ["pi 3.", "pi 3. 14 ok"]),
        ("short\n\n" + "z" * 30, 20, 5, ["short", "z" * 30]),
        ("aaaa aaaa. bbbb bbbb. cccc", 20, 0, ["aaaa aaaa.", "aaaa aaaa. bbbb bbbb.", "aaaa aaaa. bbbb bbbb. cccc"]),
        ("甲乙丙。丁戊己。庚辛", 6, 2, ["甲乙丙。", "丙。 丁戊己。", "己。 庚辛"]),
    ]
    for text, size, overlap, want in cases:
        assert list(chunking.by_paragraphs(text, size, overlap)) == want


def test_every_sentence_is_in_a_chunk():
    rng = random.Random(2)
    for _ in range(50):
        sentences = ["".join(rng.choice("ab ") for _ in range(rng.randint(1, 40))).strip() + "." for _ in range(rng.randint(1, 12))]
        whole = " ".join(chunking.by_paragraphs(" ".join(sentences), 60, 20))
        assert all(s in whole for s in sentences if s != ".")


def test_windows_cover_the_text():
    rng = random.Random(3)
    for _ in range(50):
        text = "".join(rng.choice("abc. \n") for _ in range(rng.randint(0, 900)))
        pieces = list(chunking.by_window(text, 100, 20))
        at = 0
        for piece in pieces:
            found = text.index(piece, max(0, at - 120))
            assert not text[at:found].strip() or found <= at
            at = max(at, found + len(piece))
        assert not text[at:].strip()
        assert all(len(p) <= 100 for p in pieces)


def test_table_chunks():
    table = "\n".join("x" * 9 for _ in range(30))
    assert list(chunking.by_table_rows(table, 200)) == [table]
    pieces = list(chunking.by_table_rows(table, 100))
    assert "\n".join(pieces) == table and all(len(p) <= 100 for p in pieces)


def test_elements(spark):
    rows = [(1, 1, 1, "text", "a\n\nb"), (1, 1, 2, "table", "| x |\n| y |"), (1, 2, 1, "text", "c"), (2, 1, 1, "text", None)]
    got = chunking.chunk_elements(spark.createDataFrame(rows, "doc_id long, page_no int, elem_no int, kind string, content string")).orderBy("chunk_no").collect()
    assert [(r.chunk_no, r.content) for r in got] == [(1, "a"), (2, "b"), (3, "| x |\n| y |"), (4, "c")]


def test_outline(spark):
    text = "preamble\n第一章 总则\n body \n\n一、目的\n1. 范围\nx\ny\n（1）其他"
    got = chunking.section_outline(spark.createDataFrame([(1, text), (2, "no heads"), (3, None)], "doc_id long, text string")).orderBy("section_no").collect()
    assert [(r.level, r.title, r.content) for r in got] == [(1, "第一章 总则", "body\n"), (2, "一、目的", ""), (3, "1. 范围", "x\ny\n"), (4, "（1）其他", "")]


def test_markdown_and_hash(spark):
    header, data = ["项目", "2024"], [["营收", "10"], ["成本"]]
    frame = spark.createDataFrame([(1, (header, data, 3, 2)), (2, ([], [["a", "b"], ["1", "2"]], 2, 2)), (3, ([], [], 0, 0)), (4, (header, data[:1], 2, 2))], f"i int, t {TABLE_DATA}")
    got = {r.i: (r.m, r.h) for r in frame.select("i", tables.markdown(F.col("t")).alias("m"), tables.table_sha256(F.col("t")).alias("h")).collect()}
    assert got[1][0] == "| 项目 | 2024 |\n| --- | --- |\n| 营收 | 10 |\n| 成本 |  |"
    assert got[2][0] == "| a | b |\n| --- | --- |\n| 1 | 2 |" and got[3][0] == ""
    assert got[4][1].startswith("5f958c363a822930")
    canonical = json.dumps({"header": header, "data": data, "row_count": 3, "col_count": 2}, sort_keys=True, ensure_ascii=False)
    assert got[1][1] == hashlib.sha256(canonical.encode()).hexdigest()


def test_compaction(spark):
    row = spark.createDataFrame([([["a", "", "b "], ["", None], ["", "c"]],)], "rows array<array<string>>").select(tables.table_data(F.col("rows")).alias("t")).first()["t"]
    assert (row.header, row.data, row.row_count, row.col_count) == (["a", "b"], [["c"]], 2, 2)


def test_carried_headers(spark):
    table = lambda header, data: (header, data, len(data) + 1, len(header))
    rows = [
        (1, 1, 1, table(["项目", "金额"], [["x", "1"]])),
        (1, 2, 1, table(["100", "200"], [["300", "400"]])),
        (1, 3, 1, table(["1", "2", "3"], [])),
        (1, 4, 1, table(["5", "6"], [])),
        (2, 1, 1, table(["1", "2"], [])),
    ]
    got = {(r.doc_id, r.page_no): r for r in tables.carry_headers(spark.createDataFrame(rows, f"doc_id long, page_no int, seq int, table_data {TABLE_DATA}")).collect()}
    assert [got[1, p].injected for p in (1, 2, 3, 4)] == [False, True, False, False] and not got[2, 1].injected
    assert got[1, 2].table_data.header == ["项目", "金额"] and got[1, 2].table_data.data == [["100", "200"], ["300", "400"]] and got[1, 2].table_data.row_count == 3


def test_reading_order(spark):
    rows = [(1, 1, 1, None, None), (1, 1, 2, 50.0, 1.0), (1, 1, 3, None, None), (1, 1, 4, 20.0, 0.0)]
    got = tables.reading_order(spark.createDataFrame(rows, "doc_id long, page_no int, seq int, top double, left double")).orderBy("elem_no").collect()
    assert [r.seq for r in got] == [1, 3, 4, 2]


def test_table_hash_escapes_like_json(spark):
    import hashlib
    import json

    cells = ['a"b\\c', "tab\tnl\nret\r", "\x01\x1f\x0b\x08\x0c", "é项\x7f"]
    made = spark.createDataFrame([([cells, cells[::-1]],)], "rows array<array<string>>").select(tables.table_data(F.col("rows")).alias("t"))
    got = made.select("t", tables.table_sha256(F.col("t")).alias("h")).first()
    value = {"header": list(got.t.header), "data": [list(r) for r in got.t.data], "row_count": got.t.row_count, "col_count": got.t.col_count}
    assert got.h == hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
