"""Token counts kept as additive totals by source, language and tokenizer version.

Changes are signed: an insert adds a document and its tokens, a delete takes
them away, a revised count takes the old one away and adds the new one.  A
batch of changes is summed by key before it is shuffled and committed under its
id.  A commit reads the totals so far, adds the batch, takes away what the same
id brought before, and writes new totals; so it costs as much as the batch and
the keys, and a batch counts once however often it is sent.

Nothing is changed in place.  A commit writes new folders and then a manifest
that names the current totals, as ``corpusloom.store`` publishes it: readers see
all of it or nothing, and a commit that died leaves folders that no manifest
names.  Which folder a batch has stands in small files for ranges of ids, of which a
commit writes one anew; the manifest names those files.  The file system must rename a file atomically.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.bpe import encoding
from corpusloom.llm.common import cut, filled, join_few
from corpusloom.store import Store

KEYS = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens", "n_chars")
RANGE = 1000  # ids of batches whose folders one file names
_SCHEMA = ", ".join([f"{x} string" for x in KEYS] + [f"{x} long" for x in SUMS])


def count_tokens(docs: DataFrame, path: str, pattern: str, version: str, text: str = "text", id_column: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens, n_chars and the columns ``keep`` for every row; a null text has none of either.

    Rows are counted one by one, whatever else their table has; no rows give none.
    """
    kept = [docs.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path, pattern).encode_ordinary
        for batch in batches:
            counts = [len(encode(x.as_py())) for x in filled(batch.column(4))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(counts, pa.int64()), *batch.columns[5:]], ["doc_id", *KEYS, "n_tokens", "n_chars", *keep])

    source = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col("source"), F.col("lang"), F.lit(version).alias("tokenizer"), F.col(text).alias("text"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"), *keep
    )
    return source.mapInArrow(run, ", ".join(["doc_id long, source string, lang string, tokenizer string, n_tokens long, n_chars long", *[f"{f.name} {f.dataType.simpleString()}" for f in kept]]))


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), "n_tokens", "n_chars")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), *[(-F.col(x)).alias(x) for x in SUMS[1:]])


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    return deletes(old).unionByName(inserts(new))


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """The last version and what it names; version 0, which names nothing, before the first commit."""
    store = Store(spark, path)
    last = store.version()
    return last, store.load(last) if last else {"totals": None, "ranges": {}}


def _publish(spark: SparkSession, path: str, version: int, manifest: dict) -> bool:
    """Make ``manifest`` the given version; False if another commit has taken it."""
    return Store(spark, path).publish(version, manifest)


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(*[F.sum(x).alias(x) for x in SUMS])


def _negative(rows: DataFrame) -> DataFrame:
    return rows.select(*KEYS, *[(-F.col(x)).alias(x) for x in SUMS])


def _stored(spark: SparkSession, path: str, folder: str | None) -> DataFrame:
    return spark.read.schema(_SCHEMA).parquet(f"{path}/{folder}") if folder else spark.createDataFrame([], _SCHEMA)


def commit(changes: DataFrame, path: str, batch_id: int) -> None:
    """Add a batch of signed changes to the totals in ``path``.

    A batch whose id was committed before replaces what that brought.  Commits
    at the same time take turns: one that finds its version taken adds its
    batch to the newer totals.  An empty batch is a batch like any other.
    """
    spark = changes.sparkSession
    batch = f"batches/{batch_id:012d}-{uuid.uuid4().hex}"
    _summed(changes).write.parquet(f"{path}/{batch}")
    store, ids = Store(spark, path), str(batch_id // RANGE)
    while True:
        version, manifest = _manifest(spark, path)
        batches = store.load_file(manifest["ranges"][ids]) if ids in manifest["ranges"] else {}
        before = batches.get(str(batch_id))
        parts = [_stored(spark, path, manifest["totals"]), _stored(spark, path, batch), _negative(_stored(spark, path, before))]
        folder = f"totals/{version + 1:012d}-{uuid.uuid4().hex}"
        _summed(reduce(DataFrame.union, parts)).where(" or ".join(f"{x} <> 0" for x in SUMS)).write.parquet(f"{path}/{folder}")
        named = store.save_file(f"ranges/{ids}-{uuid.uuid4().hex}.json", batches | {str(batch_id): batch})
        if _publish(spark, path, version + 1, {"totals": folder, "ranges": manifest["ranges"] | {ids: named}}):
            return


def compact(spark: SparkSession, path: str, into: str) -> None:
    """The totals of ``path`` as the first batch of a new rollup, which knows no other batch and has no older totals."""
    commit(totals(spark, path), into, 0)


def totals(spark: SparkSession, path: str) -> DataFrame:
    """The totals by source, lang and tokenizer as of the last commit; null keys make groups of their own.

    A key whose documents have all gone is left out.  Without any commit there are no rows.
    """
    return _stored(spark, path, _manifest(spark, path)[1]["totals"])


def later_copies(docs: DataFrame, text: str = "text", id_column: str = "doc_id", by_text: bool = False) -> DataFrame:
    """doc_id of rows whose exact text a smaller doc_id has too; null texts and ids take no part.

    With ``by_text`` also digest, the SHA-256 of the text: rows of one id may have several texts, of which only some are copies.
    """
    digest = F.unhex(F.sha2(F.col(text), 256)).alias("digest")
    keyed = cut(docs.where(F.col(text).isNotNull() & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("doc_id"), digest), "text-digests")
    first = cut(keyed.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "text-copies")
    return join_few(keyed, first, ["digest"], ["doc_id"]).where("doc_id > first").select("doc_id", *(["digest"] if by_text else [])).distinct()
