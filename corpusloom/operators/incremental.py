"""Incremental loading by content hash: skips, reuse, versions, counters and cascading deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.readers import base_name
from corpusloom.store import Replace, Snapshot, Store


def new_files(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Files (tenant, file_sha256) that no parsed file of the tenant has."""
    done = known.where("parse_status = 'parsed'").select("tenant", "file_sha256").distinct()
    return incoming.join(done, ["tenant", "file_sha256"], "left_anti")


def file_action(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """``incoming`` with action: skip a parsed file, parse a known one again, create the rest."""
    state = known.groupBy("tenant", "file_sha256").agg(F.max((F.col("parse_status") == "parsed").cast("int")).alias("parsed"))
    joined = incoming.join(state, ["tenant", "file_sha256"], "left")
    return joined.withColumn("action", F.when(F.col("parsed") == 1, "skip").when(F.col("parsed") == 0, "reparse").otherwise("create")).drop("parsed")


def mark_reuse(chunks: DataFrame, stored: DataFrame, keys: tuple[str, ...] = ("tenant", "content_sha256")) -> DataFrame:
    """``chunks`` with reused: whether the store, as it was before this batch, has the content.

    Equal chunks within the batch are all new.
    """
    have = stored.select(*keys).distinct().withColumn("reused", F.lit(True))
    return chunks.join(have, list(keys), "left").withColumn("reused", F.coalesce("reused", F.lit(False)))


def reuse_counters(marked: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return marked.groupBy(*by).agg(F.count("*").alias("total"), F.count_if("reused").alias("reused_chunks"), F.count_if(~F.col("reused")).alias("new_chunks"))


def duplicate_groups(chunks: DataFrame, by: tuple[str, ...] = ("content_sha256",), key: str = "chunk_id") -> DataFrame:
    """by, copies and the smallest key; summed before the shuffle, so no group is gathered."""
    return chunks.groupBy(*by).agg(F.count("*").alias("copies"), F.min(key).alias("first_id"))


def vectors_for(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """The active vector of each chunk by its content, so a reused chunk has one too; ``embeddings`` has content_sha256, embed_model and vector."""
    active = embeddings.where("is_active").groupBy("content_sha256", "embed_model").agg(F.min_by("vector", "id").alias("vector"))
    return chunks.join(active, "content_sha256", "left")


def with_tables(chunks: DataFrame, tables: DataFrame) -> DataFrame:
    """Chunks with the id of the stored table of equal content; the oldest copy owns it."""
    first = tables.groupBy("tenant", "table_sha256").agg(F.min("id").alias("table_id"))
    return chunks.join(first, ["tenant", "table_sha256"], "left")


def content_digest(chunks: DataFrame, by: str, number: str = "chunk_no", text: str = "content") -> DataFrame:
    """Hash of a document's chunks, joined by line ends in order.

    Only one document's chunks come together, which is the size of that document.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), F.col(text).alias("t"))))
    return chunks.groupBy(by).agg(F.count("*").alias("chunk_count"), F.sha2(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n"), 256).alias("content_sha256"))


def next_versions(digests: DataFrame, versions: DataFrame, key: str = "document_id") -> DataFrame:
    """version_no of a new version of each document: one more than the largest so far, from 1."""
    last = versions.groupBy(key).agg(F.max("version_no").alias("last"))
    return digests.join(last, key, "left").withColumn("version_no", (F.coalesce("last", F.lit(0)) + 1).cast("int")).drop("last")


def number_versions(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    return rows.withColumn("version_no", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def current(rows: DataFrame, key: str, number: str = "version_no") -> DataFrame:
    """The rows of each document's latest version."""
    last = F.max(number).over(Window.partitionBy(key))
    return rows.withColumn("_last", last).where(F.col(number) == F.col("_last")).drop("_last")


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """``tables`` without the documents of ``gone`` (document_id) and all that hangs on them, vectors included."""
    ids = gone.select("document_id").distinct()
    out = dict(tables)
    chunks = tables["chunks"].join(ids, "document_id", "left_semi").select("chunk_id").distinct()
    out["documents"] = tables["documents"].join(ids, "document_id", "left_anti")
    out["chunks"] = tables["chunks"].join(ids, "document_id", "left_anti")
    for name in ("doc_versions", "tables"):
        if name in tables:
            out[name] = tables[name].join(ids, "document_id", "left_anti")
    for name in ("embeddings", "citations"):
        if name in tables:
            out[name] = tables[name].join(chunks, "chunk_id", "left_anti")
    return out


def delete_documents(store: Store, gone: DataFrame) -> int:
    """Take documents (document_id) and all that hangs on them out of a store in one commit; the new version.

    A reader sees all of the tables with them or all without.
    """

    def changes(snapshot: Snapshot) -> dict[str, Replace]:
        names = [n for n in ("documents", "chunks", "doc_versions", "tables", "embeddings", "citations") if n in snapshot.tables]
        return {n: Replace(df) for n, df in cascade_delete({n: store.read(n, snapshot) for n in names}, gone).items()}

    return store.commit(changes)


def by_file_name(documents: DataFrame, names: DataFrame) -> DataFrame:
    """tenant, file_name and document_id of the stored document of each name (tenant, file_name); of several the oldest.

    ``documents`` has document_id, tenant and file_uri.  A name is what follows the last slash of either kind.
    """
    named = documents.select("tenant", base_name(F.col("file_uri")).alias("file_name"), "document_id").groupBy("tenant", "file_name").agg(F.min("document_id").alias("document_id"))
    return names.select("tenant", "file_name").distinct().join(named, ["tenant", "file_name"])


def overwrite(tables: dict[str, DataFrame], incoming: DataFrame) -> dict[str, DataFrame]:
    """``tables`` without what files of the same tenant and name had brought, so that ``incoming`` (tenant, file_uri) can be loaded anew."""
    names = incoming.select("tenant", base_name(F.col("file_uri")).alias("file_name"))
    return cascade_delete(tables, by_file_name(tables["documents"], names))


def with_document_defaults(documents: DataFrame) -> DataFrame:
    """Documents with a tenant, a type and a source."""
    defaults = {"tenant_id": F.lit(0), "doc_type": F.lit("annual_report"), "source": F.lit("upload")}
    return documents.withColumns({c: F.coalesce(F.col(c), v) if c in documents.columns else v for c, v in defaults.items()})


def vector_id(store: str, chunk_id: Column) -> Column:
    """The name of a chunk's vector in a vector store."""
    return F.concat(F.lit(f"{store}_"), chunk_id.cast("string"))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose parent is missing."""
    return child.where(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")
