"""Small helpers that the operators of this subpackage share.

The Arrow helpers work on one record batch inside a task.  The Spark helpers
cut lineage through the shared folder that the cluster names in
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of text that one numpy step looks at; bounds the memory of a task.
SLICE_BYTES = 4 << 20
HOT_KEYS = 1000  # a key with a larger share of all rows than one over this is dealt out in a join


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    Read from ``spark.checkpoint.dir``; a folder of our own is made only where
    that is unset and all runs on one machine, as in tests.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/corpusloom/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    Later steps then start from files that outlive any executor, and what is
    expensive is computed once though several branches read it.
    """
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_few(many: DataFrame, few: DataFrame, keys: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """``many`` joined with ``few``, which has one row for each key and ``n``, how many rows of ``many`` have it.

    A key with over a ``1 / HOT_KEYS`` share of the rows that ``few`` counts is
    dealt out by the columns ``by``, in as many parts as keep a part no larger
    than an even share of a shuffle partition.  There are fewer than
    ``HOT_KEYS`` such keys, whatever the data, so their list is broadcast.
    ``few`` is read several times: it should be a table.  ``n`` isn't in the result.
    """
    total = few.agg(F.sum("n")).first()[0] or 0
    parts = F.ceil(F.col("n") * F.lit(shuffle_partitions(many.sparkSession)) / F.lit(max(total, 1))).cast("int")
    hot = F.broadcast(few.where(F.col("n") * HOT_KEYS > total).select(*keys, parts.alias("parts")))
    dealt = many.join(hot, keys, "left").withColumn("part", F.pmod(F.xxhash64(*by), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    spread = few.drop("n").join(hot, keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(spread, [*keys, "part"], how).drop("part")


def numbered(rows: DataFrame, order: list[str], what: str) -> DataFrame:
    """``rows`` as a table in the order of the columns, with ``place``, how many rows come before each.

    The rows are range-partitioned and counted by partition, so no task has
    them all; the counts, one for each partition, are broadcast.
    """
    at, part = F.col("_at"), F.shiftright("_at", 33)  # Spark's number of a row: its partition, and its place there in 33 bits
    kept = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), what)
    earlier = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    before = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(earlier, F.lit(0)).alias("_before"))
    placed = kept.withColumn("_part", part).join(F.broadcast(before), "_part")
    return placed.withColumn("place", F.col("_before") + at.bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str | int = "text", max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy runs of rows with about ``max_bytes`` of text; a longer row stands alone."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // max_bytes
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def filled(texts: pa.Array) -> pa.Array:
    """Null texts count as empty."""
    return pc.fill_null(texts, "")


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of all texts, in order, and how many each text has."""
    parts = pc.ascii_split_whitespace(filled(texts))
    flat, owner = parts.flatten(), pc.list_parent_indices(parts)
    real = pc.greater(pc.binary_length(flat), 0)
    owner = owner.filter(real).to_numpy()
    return flat.filter(real), np.bincount(owner, minlength=len(texts))


def lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The ``\\n``-split lines of all texts, in order, and the index of the text of each."""
    parts = pc.split_pattern(filled(texts), "\n")
    return parts.flatten(), pc.list_parent_indices(parts).to_numpy()


def codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Equal values get equal integers, exactly; the second result has the values by integer."""
    d = values.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the offsets of the texts in them."""
    texts = filled(texts).cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set from each offset to the next."""
    total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
    return total[offsets[1:]] - total[offsets[:-1]]


def window_hash(code: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each window of ``size`` codes; collisions are possible, so callers compare the codes."""
    n = len(code) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    mixed = (code.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x94D049BB133111EB) + mixed[k : k + n]
        out ^= out >> np.uint64(31)
    return out


def equal_windows(code: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Whether the windows that start at ``a`` and ``b`` have the same codes."""
    same = np.ones(len(a), bool)
    for k in range(size):
        same &= code[a + k] == code[b + k]
    return same
