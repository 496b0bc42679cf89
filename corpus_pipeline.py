"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs.  All but the last return
the columns of ``documents``; where a text changes, ``n_chars`` follows it.
Every stage takes null, empty and very long texts, repeated rows, null and
equal ids, further columns of any name, which go along until the last one, and empty tables, which stay empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import lines, packing, quality, secrets, simhash
from corpusloom.llm.common import cut, table

WORD_BPE = "word_bpe_49k.json"


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go; a null text, which has no words, is one."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines are deleted from the texts; no document goes.  Null texts stay null, and rows without an id are left alone."""
    return _recounted(lines.dedup(docs).drop("n_lines", "n_removed"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays; long and frequent lines that repeat in those are deleted.

    Lines go after the near copies, which would hardly be alike without them;
    and what stays has the first place of each line.  Texts without words are
    copies of each other; a row without an id never leads a group.
    """
    left = cut(simhash.keep_one_each(docs), "pipeline-near-dedup")
    return _recounted(lines.dedup(left, run=None, passages=True).drop("n_lines", "n_removed"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; no document goes, and null texts stay null."""
    return _recounted(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of one length; a null or empty text is its end token alone."""
    return packing.pack(docs, public_tokenizers.path(WORD_BPE))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: Component search, the randomness tests and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
