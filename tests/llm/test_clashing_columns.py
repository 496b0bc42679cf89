"""Extra columns with names that the operators use themselves change no result; nor do empty tables fail."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bpe, lines, neighbours, packing, quality, rollups, secrets, simhash, substrings, warc
from corpusloom.llm.common import scratch
from tests.llm.helpers import documents
from tests.llm.test_neighbours import SCHEMA as VECTORS
from tests.llm.test_neighbours import data

CLASHING = (
    "n part parts key value first h g w at from line lines numbers gone start stop k row ids n_tokens decoded c0 c1 k0 kept base found counts spans fp sig own root node u v lead "
    "component_id fingerprint text_hash wkey bucket blob digest id of payload page_bytes record_type refers_to curve data q query_id rank score vec n_words sequence_id offset"
).split()
BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")

OPERATORS = {
    "quality_verdicts": quality.quality_verdicts,
    "keep_good": quality.keep_good,
    "near_duplicates": simhash.near_duplicates,
    "keep_one_each": simhash.keep_one_each,
    "lines": lines.dedup,
    "passages": lambda d: lines.dedup(d, run=None, passages=True),
    "pack": lambda d: packing.pack(d.coalesce(1), WORD_BPE),
    "scan": secrets.scan,
    "redact": secrets.redact,
    "bpe": lambda d: bpe.encode(d, BYTE_BPE, public_tokenizers.PATTERN, chunk=64, overlap=40),
    "count_tokens": lambda d: rollups.count_tokens(d, BYTE_BPE, public_tokenizers.PATTERN, "v1"),
    "later_copies": rollups.later_copies,
    "substrings": substrings.remove_repeats,
}


def with_extras(frame):
    return frame.select("*", *[F.lit("clash").alias(x) for x in CLASHING if x not in frame.columns])


def rows(frame, columns):
    return sorted(map(repr, frame.select(*columns).collect()))


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_documents(spark, name):
    docs = documents(spark).coalesce(1)
    plain = OPERATORS[name](docs)
    kept = OPERATORS[name](with_extras(docs))
    assert rows(kept, plain.columns) == rows(plain, plain.columns) and plain.count()


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_no_documents(spark, name):
    assert OPERATORS[name](with_extras(documents(spark, []))).count() == 0


def test_vectors(spark):
    vectors = spark.createDataFrame(data(n=600), VECTORS)
    search = lambda d: neighbours.nearest(d, F.col("vec_id") % 20 == 0)
    columns = ["query_id", "rank", "vec_id", "score"]
    assert rows(search(with_extras(vectors)), columns) == rows(search(vectors), columns)
    assert search(with_extras(vectors.where("false"))).count() == 0


def test_pages(spark):
    pages = spark.createDataFrame([(i, "u", "same page " * (150 if i % 3 else 2)) for i in range(9)], "page_id long, url string, html string")
    plain = warc.rewrite(pages, scratch(spark, "test-warc"))
    assert rows(warc.rewrite(with_extras(pages), scratch(spark, "test-warc")), plain.columns) == rows(plain, plain.columns)
    assert warc.rewrite(with_extras(pages.where("false")), scratch(spark, "test-warc")).count() == 0
