"""The registered queries opN_<name>: each applies its operator with production parameters to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, lines, merkle, mixing, neighbours, packing, quality, rollups, secrets, simhash, substrings, vectorcodes, warc
from corpusloom.llm.common import cut, scratch, table
from corpusloom.llm.oracles import ORACLE_SQL as ORACLE_SQL

BYTE_BPE = "byte_bpe_50k.tiktoken"
WORD_BPE = "word_bpe_49k.json"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    counts = [secrets.count_kind("base", k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secrets.joined("base"), 256).alias("base_sha256"), secrets.joined("spans").alias("spans"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BYTE_BPE)
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches over all documents: all are inserted, the same batch comes again, later exact copies
    are deleted, and texts with runs of spaces are counted anew without them.  What is taken away and what is added come from the
    same rows, told by id and text, so that repeated and null ids count as the rows they are."""
    new = F.regexp_replace("text", "  +", " ")
    docs = table(spark, sf_dir, "documents").withColumns({"digest": F.unhex(F.sha2("text", 256)), "changes": F.coalesce(new != F.col("text"), F.lit(False))})
    count = lambda d: rollups.count_tokens(d, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN, "byte_bpe_50k/1", keep=("digest", "changes"))
    counts = cut(count(docs), "token-counts")
    path = scratch(spark, "token-rollup")
    for _ in range(2):
        rollups.commit(rollups.inserts(counts), path, 0)
    copies = cut(rollups.later_copies(docs, by_text=True), "later-copies")
    rollups.commit(rollups.deletes(counts.join(copies, ["doc_id", "digest"], "left_semi")), path, 1)
    left = lambda rows: rows.where("changes").join(copies, ["doc_id", "digest"], "left_anti")
    rollups.commit(rollups.revisions(left(counts), count(left(docs).withColumn("text", new))), path, 2)
    return rollups.totals(spark, path)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.rewrite(table(spark, sf_dir, "pages"), scratch(spark, "warc"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proof of every document, and what it says of documents of which half have lost their line ends since."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    now = F.when(hit, F.translate("text", "\n", "")).otherwise(F.col("text"))
    found = merkle.proofs(docs.withColumn("now", merkle.leaf("doc_id", "source", "lang", "n_chars", now)), docs.columns, "source", "doc_id", keep=("now",))
    root, folded = merkle.hexed(F.col("root")), merkle.fold(F.col("now"), F.col("proof"))
    made = found.select(F.col("id").alias("doc_id"), *[merkle.hexed(F.col(c)).alias(c) for c in ("leaf", "subroot")], root.alias("root"), F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(table(spark, sf_dir, "embeddings")).drop("label")


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_cost_balanced_packing": op4_cost_balanced_packing,
    "op5_secret_scan": op5_secret_scan,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_token_rollups": op7_token_rollups,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_warc_revisits": op9_warc_revisits,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_vector_codes": op12_vector_codes,
    "op13_source_mix": op13_source_mix,
}
