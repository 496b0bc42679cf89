"""Loading files as one stream into a store: a micro-batch is one commit, and any split into batches gives the same store.

What a file brings hangs on its content, not on when it comes.  A document is a
tenant's content; a name points at the document of the newest file that had it.
Content that is there isn't parsed again, a vector is made once for each
content of a chunk, and a file that can't be parsed leaves nothing but its status, so that it is tried again when it comes again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import sha256
from corpusloom.operators import chunking, incremental
from corpusloom.providers import Embedder, PdfParser, parse_files
from corpusloom.session import kept
from corpusloom.sources.readers import base_name
from corpusloom.store import DELETED, Append, Changes, Snapshot, Store

NAME = ("tenant", "file_name")
FILES = "path string, modificationTime timestamp, length long, content binary"


def load(store: Store, files: DataFrame, parser: PdfParser, embedder: Embedder, batch: tuple[str, int] | None = None) -> int:
    """Load ``files`` (tenant, path, modified, content) in one commit; the store's version.

    Of files of one name and tenant the newest counts, by modified and then path,
    whether it comes before or after the others.  Tables: files, documents,
    chunks, embeddings (by content) and index_builds, a row for each commit with what it counted as it wrote.
    """
    spark = store.spark
    named = files.select("tenant", base_name(F.col("path")).alias("file_name"), "path", "modified", F.sha2("content", 256).alias("file_sha256"), "content")
    newest = named.groupBy(*NAME).agg(F.max_by(F.struct("path", "modified", "file_sha256", "content"), F.struct("modified", "path")).alias("f")).select(*NAME, "f.*")
    own = kept(newest.withColumn("document_id", sha256(F.concat_ws("|", F.coalesce(F.col("tenant").cast("string"), F.lit("")), "file_sha256"))), "load-files")

    def changes(snapshot: Snapshot) -> Changes:
        there = "files" in snapshot.tables
        wanted = own
        if there:
            held = store.latest("files", NAME, snapshot).select(*NAME, F.struct("modified", "path").alias("held"))
            wanted = own.join(held, list(NAME), "left").where(F.col("held").isNull() | (F.struct("modified", "path") > F.col("held"))).drop("held")
        documents = wanted.groupBy("document_id", "tenant", "file_sha256").agg(F.min_by("content", "path").alias("content"))
        if there:
            parsed = store.latest("documents", ("document_id",), snapshot).where("parse_status = 'parsed'").select("document_id")
            documents = documents.join(parsed, "document_id", "left_anti")
        documents = kept(documents, "load-documents")
        pages = kept(parse_files(documents.select(F.col("document_id").alias("path"), "content"), parser).withColumnRenamed("path", "doc_id"), "load-pages")
        broken = pages.where("failed").select(F.col("doc_id").alias("document_id")).distinct()
        pieces = chunking.explode_chunks(pages.join(broken, pages["doc_id"] == broken["document_id"], "left_anti"), chunking.by_paragraphs, "text", ("doc_id", "page_no"))
        chunks = chunking.number_chunks(pieces).select(F.col("doc_id").alias("document_id"), "chunk_no", "page_no", "content", sha256(F.col("content")).alias("content_sha256"))
        chunks = kept(chunks, "load-chunks")
        stored = store.read("embeddings", snapshot).select("content_sha256") if there else spark.createDataFrame([], "content_sha256 string")
        fresh = chunks.groupBy("content_sha256").agg(F.first("content").alias("content")).join(stored, "content_sha256", "left_anti")
        counted, made = Observation(), Observation()
        marked = incremental.mark_reuse(chunks, stored, ("content_sha256",)).observe(counted, F.count(F.lit(1)).alias("chunks"), F.count_if("reused").alias("reused")).drop("reused")
        status = documents.select("document_id", "tenant", "file_sha256").join(broken.withColumn("broken", F.lit(True)), "document_id", "left")
        status = status.select("document_id", "tenant", "file_sha256", F.when(F.col("broken"), "failed").otherwise("parsed").alias("parse_status"))
        status = status.observe(made, F.count(F.lit(1)).alias("documents"), F.count_if(F.col("parse_status") == "failed").alias("failed"))

        def log() -> DataFrame:
            values = {**counted.get, **made.get}
            return spark.createDataFrame([tuple(values[k] for k in ("documents", "failed", "chunks", "reused"))], "documents long, failed long, chunks long, reused long")

        alive = F.lit(False).alias(DELETED)
        return {
            "files": Append(wanted.select(*NAME, "path", "modified", "document_id", alive)),
            "documents": Append(status.select("*", alive)),
            "chunks": Append(marked),
            "embeddings": Append(embedder.embed(fresh, "content").select("content_sha256", "vector")),
            "index_builds": Append(log),
        }

    return store.commit(changes, batch)


def live_chunks(store: Store) -> DataFrame:
    """tenant, file_name, document_id, chunk_no, page_no, content, content_sha256 and vector of all that names point at now."""
    snapshot = store.snapshot()
    files = store.latest("files", NAME, snapshot).select(*NAME, "document_id")
    chunks = store.read("chunks", snapshot).join(files, "document_id")
    return chunks.join(store.read("embeddings", snapshot), "content_sha256", "left")


def load_folder(spark: SparkSession, folder: str, store: Store, parser: PdfParser, embedder: Embedder, checkpoint: str, tenant: str = "0", pattern: str = "*.{pdf,PDF}", files: int = 1000):
    """Start a query that loads what is in a folder and hasn't been loaded, ``files`` at a time, and ends.

    A micro-batch that comes again after a failure changes nothing, for the store knows its number.
    """
    source = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).load(folder)

    def save(batch: DataFrame, number: int) -> None:
        load(store, batch.select(F.lit(tenant).alias("tenant"), "path", F.col("modificationTime").alias("modified"), "content"), parser, embedder, (f"load:{checkpoint}", number))

    return source.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
