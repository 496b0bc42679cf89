"""Writers: append, persist, audit views and event lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Add rows to a table; readers see the batch only once it is committed."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def truncate(df: DataFrame, path: str) -> None:
    df.limit(0).write.mode("overwrite").parquet(path)


def latest(df: DataFrame, keys: tuple[str, ...], order: Column) -> DataFrame:
    """The last row of each key: an append-only log seen as rows that are updated in place."""
    w = Window.partitionBy(*keys).orderBy(order.desc())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def sse_line(event: Column) -> Column:
    return F.concat(F.lit("data: "), F.to_json(event), F.lit("\n\n"))


def index_build_log(chunks: DataFrame, index_type: str, params: dict[str, str], status: str = "success") -> DataFrame:
    """One log row for each tenant: documents and chunks that an index build covers, and the real parameters."""
    pairs = [F.lit(x) for kv in sorted(params.items()) for x in kv]
    return chunks.groupBy("tenant").agg(F.countDistinct("document_id").alias("doc_count"), F.count("*").alias("chunk_count")).select(
        "tenant", F.lit(index_type).alias("index_type"), F.to_json(F.create_map(*pairs)).alias("params"), "doc_count", "chunk_count", F.lit(status).alias("status")
    )
