"""Vectors as short codes: each part of a vector is named by the nearest entry of its own codebook, in whole numbers.

The parts that a slice of vectors has at one position are sorted, so that they
are the leaves of a lexicographic trie over their components, in the order of a
depth-first walk.  The walk keeps, for every node on the way, the distances of
its prefix from all entries; a part adds to those of the longest prefix that it
shares with the one before.  At a leaf the smallest distance gives the entry,
and the part goes into the entry's sum as often as it stands in the slice.
Tasks send on sums only, so learning and coding are scans without a shuffle of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, join_few

SCALE = 256
LARGEST = 1 << 27  # whole numbers beyond count as this, so that distances fit in 64 bits
LEAVES = 2048  # leaves of a trie that are walked at once
COMPONENTS = 1 << 20  # components of a slice of vectors


def bounds(size: int, parts: int) -> list[tuple[int, int]]:
    """Where the parts of a vector start and end: equal ones, or those that differ by one where the size can't be divided."""
    edges = [k * size // parts for k in range(parts + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(vectors.astype(np.float64) * SCALE), -LARGEST, LARGEST).astype(np.int64)


def walk(leaves: np.ndarray, book: np.ndarray, at_once: int = LEAVES) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each leaf, the lower of equals, and its squared distance.

    ``leaves`` are different parts in lexicographic order.  They are walked some
    at a time: of those only prefixes that are new get a vector of distances,
    made from their parent's; the path to the last leaf is kept for the next ones.
    """
    nearest, distance = np.zeros(len(leaves), np.int64), np.zeros(len(leaves), np.int64)
    path = [np.zeros(len(book), np.int64)] * (leaves.shape[1] + 1)
    for a in range(0, len(leaves), at_once):
        own = leaves[a : a + at_once]
        differs = np.ones(own.shape, bool)
        differs[1:] = own[1:] != own[:-1]
        if a:
            differs[0] = own[0] != leaves[a - 1]
        new = np.logical_or.accumulate(differs, axis=1)
        sums, at = path[0][None], np.zeros(len(own), np.int64)
        for d in range(own.shape[1]):
            fresh = np.flatnonzero(new[:, d])
            made = sums[at[fresh]] + (own[fresh, d, None] - book[None, :, d]) ** 2
            shared = not new[0, d]
            sums = np.concatenate([path[d + 1][None], made]) if shared else made
            at = np.cumsum(new[:, d]) - (not shared)
            path[d + 1] = sums[-1]
        best = sums.argmin(axis=1)
        nearest[a : a + at_once], distance[a : a + at_once] = best[at], sums[np.arange(len(sums)), best][at]
    return nearest, distance


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different rows in lexicographic order, which of them each row is, and how often each stands."""
    order = np.lexsort(rows.T[::-1]) if rows.shape[1] else np.arange(len(rows))
    own = rows[order]
    first = np.r_[True, (own[1:] != own[:-1]).any(axis=1)] if len(own) else np.zeros(0, bool)
    which = np.zeros(len(rows), np.int64)
    which[order] = np.cumsum(first) - 1
    return own[first], which, np.bincount(which, minlength=int(first.sum()))


def _slices(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    step = max(1, COMPONENTS // max(size, 1))
    for batch in batches:
        for a in range(0, batch.num_rows, step):
            part = batch.slice(a, step)
            yield part, whole_numbers(part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, size))


def _learned(vectors: DataFrame, size: int, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """The codebooks of vectors (id, vector) of one size, by part."""
    first = vectors.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).collect()
    seeds = whole_numbers(np.array([r["vector"] for r in first], np.float64).reshape(len(first), size))
    places = bounds(size, parts)
    books = [seeds[:, a:b].copy() for a, b in places]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for _, numbers in _slices(batches, 0, size):
            for k, (a, b) in enumerate(places):
                leaves, _, weight = distinct(numbers[:, a:b])
                nearest, _ = walk(leaves, books[k])
                np.add.at(totals[k], nearest, leaves * weight[:, None])
                np.add.at(counts[k], nearest, weight)
        flat = np.concatenate([*[t.ravel() for t in totals], *counts])
        some = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(flat[some])], ["slot", "total"])

    for _ in range(rounds):
        # as many rows as the codebooks have components and entries
        flat = np.zeros(sum(b.size + len(b) for b in books), np.int64)
        for r in vectors.select("vector").mapInArrow(sums, "slot long, total long").groupBy("slot").agg(F.sum("total").alias("total")).collect():
            flat[r["slot"]] = r["total"]
        at, n = 0, sum(b.size for b in books)
        for k, book in enumerate(books):
            total, count = flat[at : at + book.size].reshape(book.shape), flat[n : n + len(book)]
            at, n = at + book.size, n + len(book)
            books[k] = np.where(count[:, None] > 0, total // np.maximum(count, 1)[:, None], book)
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_column: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every vector without null or non-finite components.

    A component x counts as floor(256 x).  The codebooks start as the parts of
    the ``entries`` vectors of smallest id, null ids last and equal ids by
    vector; in each round an entry that is nearest to some parts becomes
    their mean, rounded down.  The code has two hex digits for each part, error is
    the squared distance from what it stands for, and label_error the sum of
    errors of equal labels, nulls together.  Rows are coded one by one, equal
    rows alike.  Vectors of each size have codebooks of their own, one run of
    jobs for each size; an empty vector has code and error 0.  Where the size isn't a multiple of
    ``parts``, parts differ by one component.  Whole numbers beyond 2^27 count as
    that.  A sum of errors that a long can't hold is null.  Other columns, whatever their names, aren't looked at; an empty table gives no rows.
    """
    if not 0 < entries <= 256:
        raise ValueError("two hex digits name at most 256 entries")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = _keyed(vectors, id_column, vector, label).where(F.coalesce(F.forall("vector", finite), F.lit(False)))
    sizes = sorted(r["size"] for r in sound.select(F.size("vector").alias("size")).distinct().collect())
    coded = [_coded(sound.where(F.size("vector") == size), size, _learned(sound.where(F.size("vector") == size), size, parts, entries, rounds), parts) for size in sizes]
    if not coded:
        return vectors.sparkSession.createDataFrame([], f"vec_id long, label {vectors.schema[label].dataType.simpleString()}, code string, error long, label_error long, codebooks_sha256 string")
    codes = cut(reduce(DataFrame.union, coded), "vector-codes")
    errors = cut(codes.groupBy("key").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n")), "vector-errors")
    return join_few(codes, errors, ["key"], ["id", "code"]).select(F.col("id").alias("vec_id"), "label", "code", "error", "label_error", "codebooks_sha256")


def _keyed(vectors: DataFrame, id_column: str, vector: str, label: str) -> DataFrame:
    key = F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("-"))
    return vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("vector"), F.col(label).alias("label"), key.alias("key"))


def _coded(vectors: DataFrame, size: int, books: list[np.ndarray], parts: int) -> DataFrame:
    places, name = bounds(size, parts), digest(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, numbers in _slices(batches, 3, size):
            codes, errors = np.zeros((len(numbers), parts), np.uint8), np.zeros(len(numbers), np.int64)
            for k, (a, b) in enumerate(places):
                leaves, which, _ = distinct(numbers[:, a:b])
                nearest, distance = walk(leaves, books[k])
                codes[:, k], errors = nearest[which], errors + distance[which]
            text = codes.tobytes().hex()
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string()), pa.array(errors)], ["id", "label", "key", "code", "error"])

    source = vectors.select("id", "label", "key", "vector")
    fields = source.drop("vector").schema.add("code", "string").add("error", "long")
    return source.mapInArrow(run, fields).withColumn("codebooks_sha256", F.lit(name))
