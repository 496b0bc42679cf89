"""Nearest neighbours by inner product over shifted space-filling curves.

Vectors get one more component that makes them all equally long, queries a zero
there, so that the largest product is the smallest distance.  A few projections,
each with its own rotation and shift, give every vector and every query a
place on as many Hilbert curves.  Spark range-partitions the rows by curve and
key; a task then compares each query with the key windows next to it, and the
finds of all curves merge.  The curves alone are approximate.  What they find
bounds the rest: blocks of neighbouring keys on the first curve have a centre
and a radius, and a block whose best possible product is no less than a query's
last find is searched too.  So results are whole whatever the data; the better
the curves do, the fewer blocks are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import cut, shuffle_partitions

CURVES = 6
AXES = 6  # projected axes of a curve
BITS = 10  # of a key for each axis
WINDOW = 256  # rows looked at on either side of a query's key
FIT_ROWS = 4096  # vectors, drawn from all, on which projections are fitted (on average; twice as many at most)
MIN_BLOCK = 2048  # rows of a block at least
MAX_BLOCKS = 1024  # blocks at most, but for the last one of each partition
PART = 512  # rows of a block with a bound of their own
QUERIES_IN_TASK = 1 << 16

_HIT = "query_id long, vec_id long, score double"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of n points with whole coordinates of ``bits`` bits (Skilling 2004, vectorised)."""
    x = [c.astype(np.uint64).copy() for c in cells.T]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = np.uint64(q - 1)
        for i in range(n):
            on = (x[i] & np.uint64(q)) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(on, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & np.uint64(q)) != 0, t ^ np.uint64(q - 1), t)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << np.uint64(1) | ((x[i] ^ t) >> np.uint64(b)) & np.uint64(1)
    return key.astype(np.int64)


@dataclass(frozen=True)
class Curves:
    """Projections (curve, dimension, axis) with an origin and a scale for each axis."""

    directions: np.ndarray
    origin: np.ndarray
    scale: np.ndarray

    def keys(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        cells = (vectors @ self.directions[curve] - self.origin[curve]) * self.scale[curve]
        return hilbert(np.clip(cells, 0, (1 << BITS) - 1).astype(np.int64), BITS)


def fit(sample: np.ndarray, curves: int = CURVES, axes: int = AXES, seed: int = 0) -> Curves:
    """The first curve takes the principal axes of the sample, the others random ones; all are shifted."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    axes = min(axes, dim)
    centred = sample - sample.mean(axis=0)
    directions = [np.linalg.svd(centred.T @ centred)[0][:, :axes]]
    directions += [np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, :axes] for _ in range(curves - 1)]
    at = np.stack([sample @ d for d in directions])
    low, spread = at.min(axis=1), np.maximum(np.ptp(at, axis=1), 1e-12)
    margin = rng.uniform(0.05, 0.25, low.shape)  # the shift: cells of different curves have different borders
    return Curves(np.stack(directions), low - margin * spread, (1 << BITS) / (spread * 1.3))


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors over the longest one's length, with one more component that makes each as long as that."""
    scaled = vectors / (longest or 1.0)
    return np.c_[scaled, np.sqrt(np.maximum(0.0, 1 - (scaled**2).sum(axis=1)))]


def as_query(vectors: np.ndarray) -> np.ndarray:
    """Where the lifted vectors lie nearest that have the largest product with each."""
    return np.c_[vectors / np.maximum(np.sqrt((vectors**2).sum(axis=1, keepdims=True)), 1e-300), np.zeros(len(vectors))]


def _sound(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, summed in the order of the components."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def _best(ids: np.ndarray, queries: np.ndarray, least: np.ndarray, others: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Query id, vector id and score of each query's k best among ``rows`` with at least ``least``, itself left out.

    Of rows with one id only the best counts.
    """
    order = np.argsort(others, kind="stable")
    others, rows = others[order], rows[order]
    score = queries @ rows.T
    score[ids[:, None] == others[None, :]] = -np.inf
    slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(score), score, 0)).max(initial=0))
    first = np.flatnonzero(np.r_[True, others[1:] != others[:-1]]) if len(others) else np.zeros(0, np.int64)
    of_ids = score if len(first) == len(others) else np.maximum.reduceat(score, first, axis=1)
    floor = least
    if of_ids.shape[1] > k:
        floor = np.maximum(least, np.partition(of_ids, -k, axis=1)[:, -k])
    i, j = np.nonzero((score >= (floor - slack)[:, None]) & np.isfinite(score))
    s = exact(queries[i], rows[j])
    if len(first) < len(others):
        order = np.lexsort((-s, others[j], i))
        i, j, s = i[order], j[order], s[order]
        lead = np.r_[True, (i[1:] != i[:-1]) | (others[j[1:]] != others[j[:-1]])] if len(i) else np.zeros(0, bool)
        i, j, s = i[lead], j[lead], s[lead]
    order = np.lexsort((others[j], -s, i))
    i, j, s = i[order], j[order], s[order]
    start = np.searchsorted(i, i)
    top = np.arange(len(i)) - start < k
    return ids[i[top]], others[j[top]], s[top]


def _hits(found: list[tuple[np.ndarray, ...]]) -> list[pa.Array]:
    return [pa.array(np.concatenate(x)) for x in zip(*found, strict=True)]


def _matrix(column: pa.Array, dtype: np.dtype, dim: int) -> np.ndarray:
    if not len(column):
        return np.zeros((0, dim))
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, dim).astype(np.float64)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    curves: int = CURVES,
    window: int = WINDOW,
    complete: bool = True,
    min_block: int = MIN_BLOCK,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k vectors of largest inner product with each query but itself.

    Ties go to the smaller id.  A vector that is null, zero, or holds a null or
    non-finite component takes no part, nor does one without id.  Vectors are
    compared with those of as many components only; each such size has curves
    of its own, made one after the other, so sizes should be few.  Vectors with
    the same id aren't candidates of each other, and of those only the best
    counts in a result; two queries with one id make one, with the best of
    both.  Other columns, whatever their names, aren't looked at; an empty
    table gives no rows.  ``complete=False`` leaves the finds of the curves alone.

    Where vectors have no structure no block can be ruled out, and the work is that of
    comparing all queries with all vectors, dealt out in blocks; on clustered vectors it is a fraction of that.
    """
    vectors = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("v"), is_query.alias("q")).where(_sound(F.col("v")) & F.col("vec_id").isNotNull())
    squares = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    sizes = vectors.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.sqrt(F.max(squares)).alias("longest")).orderBy("dim").collect()
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = [_of_size(vectors.where(F.size("v") == x["dim"]), x["dim"], x["n"], x["longest"], k, curves, window, complete, min_block) for x in sizes]
    hits = reduce(DataFrame.union, found)
    if len(found) > 1:  # a query id may have vectors of several sizes
        hits = _top(hits, k)
    return hits.select("query_id", "rank", "vec_id", "score")


def _top(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each query, each vector id once."""
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)


def _of_size(source: DataFrame, dim: int, n: int, longest: float, k: int, curves: int, window: int, complete: bool, min_block: int) -> DataFrame:
    """``nearest`` among the n vectors of ``dim`` components; the longest has length ``longest``."""
    spark = source.sparkSession
    single = isinstance(source.schema["v"].dataType.elementType, T.FloatType)
    dtype = np.dtype(np.float32 if single else np.float64)
    block_rows = max(min_block, -(-n // MAX_BLOCKS))
    drawn = source.select("v") if n <= FIT_ROWS else source.where(F.rand(0) < FIT_ROWS / n).select("v").limit(2 * FIT_ROWS)
    model = fit(lifted(np.array([r["v"] for r in drawn.collect()], np.float64).reshape(-1, dim), longest), curves)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).flatten().to_numpy().reshape(-1, dim)
            data = pa.array([x.tobytes() for x in rows.astype(dtype)], pa.binary())
            asked = np.flatnonzero(pc.fill_null(batch.column(2), False).to_numpy(zero_copy_only=False))
            wide = rows.astype(np.float64)
            for q, own, points in ((False, np.arange(len(rows)), lifted(wide, longest)), (True, asked, as_query(wide[asked]))):
                for c in range(curves if len(own) else 0):
                    at = pa.array(own)
                    flag = pa.array(np.full(len(own), q))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), c, np.int32)), pa.array(model.keys(points, c)), batch.column(0).take(at), flag, data.take(at)], ["curve", "key", "vec_id", "q", "data"])

    placed = source.mapInArrow(place, "curve int, key long, vec_id long, q boolean, data binary")
    sorted_rows = placed.repartitionByRange(shuffle_partitions(spark), "curve", "key", "vec_id").sortWithinPartitions("curve", "key", "vec_id")
    index_schema = f"{_HIT}, block long, size long, centre binary, radius double, ids binary, data binary"

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Finds within the key windows of a partition's curves; of the first curve also its blocks."""
        nulls = lambda n: [pa.nulls(n, x) for x in (pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.binary(), pa.binary())]
        names = [x.split()[0] for x in index_schema.split(", ")]
        made = 0

        def search(ids: np.ndarray, rows: np.ndarray, q: np.ndarray, begin: int, end: int) -> Iterator[pa.RecordBatch]:
            found = []
            for a in range(begin, end, window):
                b = min(a + window, end)
                own = a + np.flatnonzero(q[a:b])
                if len(own):
                    low = max(0, a - window)
                    near = low + np.flatnonzero(~q[low : min(len(ids), b + window)])
                    found.append(_best(ids[own], rows[own], np.full(len(own), -np.inf), ids[near], rows[near], k))
            if found:
                hits = _hits(found)
                yield pa.RecordBatch.from_arrays([*hits, *nulls(len(hits[0]))], names)

        def block(ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
            nonlocal made
            centre = rows.mean(axis=0)
            radius = float(np.sqrt(((rows - centre) ** 2).sum(axis=1)).max())
            made += 1
            values = [TaskContext.get().partitionId() << 32 | made, len(ids), centre.tobytes(), radius, ids.tobytes(), rows.astype(dtype).tobytes()]
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), *(pa.array([v], t) for v, t in zip(values, kinds, strict=True))], names)

        curve, held, done = None, None, 0  # rows of the curve since a window before those that are done
        open_block: list[tuple[np.ndarray, np.ndarray]] = []

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal open_block
            while open_block and (last or sum(len(x[0]) for x in open_block) >= block_rows):
                ids, rows = (np.concatenate(x) for x in zip(*open_block, strict=True))
                yield block(ids[:block_rows], rows[:block_rows])
                open_block = [(ids[block_rows:], rows[block_rows:])] if len(ids) > block_rows else []

        for batch in batches:
            which = batch.column(0).to_numpy()
            for c in np.unique(which):
                part = batch.filter(pa.array(which == c))
                ids, q, rows = part.column(2).to_numpy(), part.column(3).to_numpy(zero_copy_only=False).astype(bool), _matrix(part.column(4), dtype, dim)
                if c != curve:
                    if held is not None:
                        yield from search(*held, done, len(held[0]))
                    yield from blocks(last=True)
                    curve, held, done = c, None, 0
                if c == 0 and not q.all():
                    open_block.append((ids[~q], rows[~q]))
                    yield from blocks(last=False)
                held = (ids, rows, q) if held is None else tuple(np.concatenate(x) for x in zip(held, (ids, rows, q), strict=True))
                end = max(done, (len(held[0]) - window) // window * window)
                if end > done:
                    yield from search(*held, done, end)
                    drop = max(0, end - window)
                    held, done = tuple(x[drop:] for x in held), end - drop
        if held is not None:
            yield from search(*held, done, len(held[0]))
        yield from blocks(last=True)

    index = cut(sorted_rows.mapInArrow(windows, index_schema), "curve-index")
    near = _top(index.where("block is null"), k)
    if complete:
        near = _top(near.unionByName(_rest(source, index, near, k, dim, dtype), allowMissingColumns=True), k)
    return near.select("query_id", "rank", "vec_id", "score")


def _rest(source: DataFrame, index: DataFrame, near: DataFrame, k: int, dim: int, dtype: np.dtype) -> DataFrame:
    """Finds in all blocks that can hold something no worse than a query's k-th find so far."""
    spark = source.sparkSession
    summary = index.where("block is not null").select("block", "centre", "radius").collect()  # MAX_BLOCKS and the number of partitions bound it
    numbers = np.array([r["block"] for r in summary], np.int64)
    centres = np.array([np.frombuffer(r["centre"]) for r in summary]).reshape(-1, dim)
    radii = np.array([r["radius"] for r in summary])

    bounds = near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("last")).select("query_id", F.when(F.col("n") >= k, F.col("last")).otherwise(F.lit(float("-inf"))).alias("least"))
    queries = source.where("q").join(bounds, source["vec_id"] == bounds["query_id"], "left").select("vec_id", F.coalesce("least", F.lit(float("-inf"))).alias("least"), "v").distinct()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2).flatten().to_numpy().reshape(-1, dim)
            wide = rows.astype(np.float64)
            best = wide @ centres.T + np.sqrt((wide**2).sum(axis=1))[:, None] * radii[None, :]
            i, b = np.nonzero(best * (1 + 1e-9 * np.sign(best)) + 1e-12 >= batch.column(1).to_numpy()[:, None])
            data = [x.tobytes() for x in rows.astype(dtype)]
            yield pa.RecordBatch.from_arrays([pa.array(numbers[b]), batch.column(0).take(pa.array(i)), batch.column(1).take(pa.array(i)), pa.nulls(len(i), pa.binary()), pa.array([data[x] for x in i.tolist()], pa.binary())], ["block", "vec_id", "least", "ids", "data"])

    schema = "block long, vec_id long, least double, ids binary, data binary"
    dealt = queries.mapInArrow(deal, schema)
    salts = max(1, -(-queries.count() // QUERIES_IN_TASK))
    blocks = index.where("block is not null").select("block", F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("double").alias("least"), "ids", "data")
    salted = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).unionByName(dealt.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's rows come before the queries that look at it."""
        ids, rows, parts = np.zeros(0, np.int64), np.zeros((0, dim)), []
        for batch in batches:
            is_block = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(is_block | np.r_[True, is_block[:-1]])
            found = []
            for a, b in zip(edges, np.r_[edges[1:], batch.num_rows], strict=True):
                if is_block[a]:
                    ids, rows = np.frombuffer(batch.column(3)[a].as_py(), np.int64), _matrix(batch.column(4).slice(a, 1), dtype, dim)
                    parts = []
                    for s in range(0, len(ids), PART):
                        own = rows[s : s + PART]
                        centre = own.mean(axis=0)
                        parts.append((s, centre, np.sqrt(((own - centre) ** 2).sum(axis=1)).max()))
                    continue
                for q in range(a, b, PART):
                    own = batch.slice(q, min(PART, b - q))
                    asked, least, vectors = own.column(1).to_numpy(), own.column(2).to_numpy(), _matrix(own.column(4), dtype, dim)
                    norms = np.sqrt((vectors**2).sum(axis=1))
                    for s, centre, radius in parts:
                        best = vectors @ centre + norms * radius
                        may = np.flatnonzero(best * (1 + 1e-9 * np.sign(best)) + 1e-12 >= least)
                        if len(may):
                            found.append(_best(asked[may], vectors[may], least[may], ids[s : s + PART], rows[s : s + PART], k))
            if found:
                yield pa.RecordBatch.from_arrays(_hits(found), ["query_id", "vec_id", "score"])

    met = salted.repartition(shuffle_partitions(spark), "block", "salt").sortWithinPartitions("block", "salt", F.col("ids").isNull()).select("block", "vec_id", "least", "ids", "data")
    return met.mapInArrow(search, _HIT)
