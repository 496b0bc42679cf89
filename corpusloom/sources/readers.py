"""Readers of files, tables, requests and event streams.

Anything that needs an outside service sits behind a provider; what is here
runs offline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.policy import valid_request
from corpusloom.functions.text import sha256
from corpusloom.schemas import TABLES


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores.  A file of few row groups is dealt out; a large table is read in enough parts as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, root: str) -> DataFrame:
    return spread(table(spark, root, "documents"))


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the data folder, or one of the engine's own tables with its schema."""
    reader = spark.read.schema(TABLES[name]) if name in TABLES and root.rstrip("/").endswith("_store") else spark.read
    return reader.parquet(f"{root}/{name}.parquet")


def binary_files(spark: SparkSession, path: str, pattern: str = "*.{pdf,PDF}") -> DataFrame:
    """path, length, content and file_sha256 of the files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", "content", F.sha2("content", 256).alias("file_sha256"))


def base_name(uri: Column) -> Column:
    return F.element_at(F.split(uri, r"[/\\]"), -1)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as live chunks with the columns that retrieval uses.

    A document stands for a chunk; ten ids in a row make a file, the language
    is the tenant, and documents labelled toxic count as deleted.
    """
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    toxic = labels.where("toxic = 1").select(F.col("doc_id").alias("toxic_id")).distinct()
    return docs.join(toxic, docs["doc_id"] == F.col("toxic_id"), "left").select(
        F.col("doc_id").alias("chunk_id"),
        F.expr("doc_id div 10").alias("document_id"),
        F.col("lang").alias("tenant"),
        F.when(F.col("doc_id") % 5 != 0, (2020 + F.col("doc_id") % 5)).cast("int").alias("year"),
        (F.col("doc_id") % 40).cast("int").alias("page_start"),
        (F.col("doc_id") % 40 + F.expr("n_chars div 3000")).cast("int").alias("page_end"),
        F.col("text").alias("content"),
        F.col("toxic_id").isNotNull().alias("is_deleted"),
    )


def requests(df: DataFrame, query: str = "query", top_k: str = "top_k") -> tuple[DataFrame, DataFrame]:
    """Valid and invalid chat requests."""
    ok = valid_request(F.col(query), F.col(top_k))
    return df.where(ok), df.where(~ok)


def sse_events(raw: DataFrame, column: str, payload_schema: str) -> DataFrame:
    """One row for each event of server-sent text: seq and its JSON as ``payload``; comments and the end mark are skipped."""
    blocks = raw.select("*", F.posexplode(F.split(F.regexp_replace(column, "\r\n", "\n"), "\n\n")).alias("seq", "block"))
    data = F.array_join(F.transform(F.filter(F.split("block", "\n"), lambda x: x.startswith("data:")), lambda x: F.trim(F.substring(x, 6, 1 << 30))), "\n")
    events = blocks.select(*[c for c in raw.columns if c != column], "seq", data.alias("data")).where((F.col("data") != "") & (F.col("data") != "[DONE]"))
    return events.select("*", F.from_json("data", payload_schema).alias("payload")).drop("data")


def text_hashes(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("content_sha256", sha256(F.col(text)))
