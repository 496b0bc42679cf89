import re

from pyspark.sql import functions as F

from corpusloom.functions import text


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first()["y"]


def many(spark, expression, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()
    return [r["y"] for r in rows]


def test_page_noise(spark):
    lines = {"12": True, "123456": True, "12345678901": False, "第 3 页": True, "page 7": True, "3 / 10": True, "营收 10": False, "": False}
    assert many(spark, text.is_page_noise, list(lines)) == list(lines.values())
    assert one(spark, text.drop_page_noise, "a\n12\n\nb") == "a\n\nb"


def test_header_footer(spark):
    lines = {"第 1 页 共 9 页": True, "Page 1 of 9": True, "page 1 of 9": False, "截至2024年12月31日，公司营收10亿元": True, "2024-01-02": True, "1234": True, "12345": False, " ": False}
    assert many(spark, text.is_header_footer, list(lines)) == list(lines.values())


def test_repeated_lines(spark):
    got = one(spark, text.repeated_lines, "a\nb\na\nb\na\n\n\n\n c\n c\n c")
    assert sorted(got) == [" c", "a"]
    assert one(spark, text.clean_text, "a\nb\na\nb\na\n\n\n\nend ") == "b\nb\n\nend"
    assert one(spark, text.clean_text, "") == "" and one(spark, text.clean_text, None) is None


def test_paragraph_types(spark):
    long_line = "x" * 60
    cases = {"第三节 财务": "Title", "一、概述": "Title", "（1）说明": "Title", "Short line": "Title", "Short line.": "NarrativeText", long_line: "NarrativeText", "short\nsecond": "NarrativeText"}
    assert many(spark, text.element_type, list(cases)) == list(cases.values())
    assert one(spark, text.paragraphs, " a \n\n\n\n　b\n\n") == ["a", "b"]


def test_titles(spark):
    assert many(spark, text.is_title_line, ["第一章", "年度报告摘要", "年度报告摘要。", "报告", "plain"]) == [True, True, False, False, False]
    assert one(spark, text.document_title, "\n  short\nA line of good length\nx") == "A line of good length"
    assert one(spark, text.document_title, "a\nb\nc\n2024 年度报告") == "2024 年度报告"
    assert one(spark, text.document_title, "a\nb") is None


def test_tokens_and_years(spark):
    assert one(spark, text.tokens, "营收10亿 abc Ab x 42 é") == ["营收", "10", "abc", "Ab", "42"]
    assert one(spark, text.years, "2021, 1999 2021 3021 20x") == [2021, 1999]


def test_strip_is_like_python(spark):
    values = ["  a ", "　b　", "\t\x0bc\r\n", " d ", "e"]
    assert many(spark, text.strip, values) == [v.strip() for v in values]


def test_hash(spark):
    assert one(spark, text.sha256, "营收").startswith("c5678fcca666b891") and re.fullmatch("[0-9a-f]{64}", one(spark, text.sha256, ""))
