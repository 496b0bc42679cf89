"""A keyword index that is kept: chunks are added and taken away, and searched without reading their texts again.

Each update writes a segment: for every term, blocks of the chunks of one range
of ids with their counts and lengths, parted into buckets by term.  A block's
largest count and smallest length bound what any of its chunks can score, so a
search scores the ranges that can hold one of the best and no others.  Chunks
that go get a tombstone; how many chunks there are, their length, and how many
have each term are kept by adding and taking away.  Segments of like size that
follow each other are merged.  An update is one commit of a store: a search sees all of it or nothing.

A segment's docs have each chunk's terms with their counts, range by range, and
its postings are made of those; so texts are shuffled once, by range, and postings only as blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.config import DEFAULT, Retrieval
from corpusloom.functions.text import tokens
from corpusloom.operators.retrieval import BROADCAST_TERMS, _split, _top
from corpusloom.session import kept, tidy
from corpusloom.store import Append, Changes, Note, Replace, Snapshot, Store, Swap

LAYOUT = {"postings": ("bucket",), "terms": ("bucket",)}
DOCS = "chunk_id long, dl int, terms array<string>, tfs array<int>, segment int"
SLICE = 3 << 19  # tokens or postings that Python holds at once, and a chunk's more
RANGES = 64  # ranges of a bucket that a file has


class KeywordIndex:
    """``width``: ids of a range, which bounds a block; ``buckets``: folders that terms are dealt out to; ``fan``: like segments that are merged."""

    def __init__(self, store: Store, buckets: int = 64, width: int = 4096, fan: int = 4, settings: Retrieval = DEFAULT.retrieval) -> None:
        self.store, self.buckets, self.width, self.fan, self.settings = store, buckets, width, fan, settings

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")

    # Updates

    def update(self, add: DataFrame | None = None, remove: DataFrame | None = None, batch: tuple[str, int] | None = None) -> int:
        """Index the chunks ``add`` (chunk_id, content), over what their ids had, and take away those of ``remove`` (chunk_id).

        Of several rows with one id the largest content counts.  Null ids take
        no part; a null or empty content has no tokens.  An id that isn't there is no fault.  The new version is returned; see ``Store.commit`` for ``batch``.
        """
        spark = self.store.spark
        named = [x.where("chunk_id is not null").select(F.col("chunk_id").cast("long")) for x in (add, remove) if x is not None]

        def changes(snapshot: Snapshot) -> Changes:
            notes = snapshot.notes.get("index", {"n": 0, "total": 0, "next": 0, "segments": [], "numbers": []})
            number = notes["next"]
            made = spark.createDataFrame([], DOCS) if add is None else self._docs(add, self._width(notes)).withColumn("segment", F.lit(number))
            docs_at, docs = self.store.stage("docs", made)
            blocks_at, blocks = self.store.stage("postings", self._blocks(docs, number, self._width(notes)), LAYOUT)
            out: Changes = {"postings": Append(blocks, blocks_at), "docs": Append(docs, docs_at)}
            gained, lost = docs.agg(F.count("*"), F.sum("dl")).first(), (0, 0)
            deltas = [blocks.groupBy("term").agg(F.sum(F.size("ids")).alias("df"))]
            if "docs" in snapshot.tables and named:
                ids = reduce(DataFrame.union, named).distinct()
                dead = self._live(snapshot).join(ids, "chunk_id", "left_semi")
                # a chunk's terms and, under null, itself
                by_term = kept(dead.select("dl", F.explode(F.concat("terms", F.array(F.lit(None).cast("string")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("dl")), "index-lost")
                lost = by_term.where("term is null").agg(F.sum("df"), F.sum("dl")).first()
                out["gone"] = Append(dead.select("chunk_id", F.lit(number).alias("before")))
                deltas.append(by_term.where("term is not null").select("term", (-F.col("df")).alias("df")))
            elif "gone" not in snapshot.tables:
                out["gone"] = Append(spark.createDataFrame([], "chunk_id long, before int"))
            delta = kept(reduce(DataFrame.union, deltas).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0").withColumn("bucket", self._bucket()), "index-terms")
            out["terms"] = Append(delta)
            n, total = notes["n"] + gained[0] - (lost[0] or 0), notes["total"] + (gained[1] or 0) - (lost[1] or 0)
            known = [self.store.read("terms", snapshot).select("term", "df")] if "terms" in snapshot.tables else []
            summed = reduce(DataFrame.union, [*known, delta.select("term", "df")]).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
            out["index"] = Note({"width": self._width(notes), "n": n, "total": total, "mean": summed.agg(F.avg(self._raw(n))).first()[0] or 0.0, "next": number + 1, "segments": [*notes["segments"], self._size(blocks)], "numbers": [*notes["numbers"], number]})
            return out

        with tidy(spark):
            return self.store.commit(changes, batch, LAYOUT)

    @staticmethod
    def _raw(n: int) -> Column:
        return F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)

    @staticmethod
    def _size(blocks: DataFrame) -> int:
        return blocks.agg(F.sum(F.size("ids"))).first()[0] or 0

    def _width(self, notes: dict) -> int:
        """The index's, which the first update sets."""
        return notes.get("width", self.width)

    @staticmethod
    def _range(width: int) -> Column:
        return F.floor(F.col("chunk_id") / width)

    def _docs(self, chunks: DataFrame, width: int) -> DataFrame:
        """chunk_id, dl, terms and tfs of the chunks that have tokens, those of a range in one task and in order."""
        rows = chunks.where("chunk_id is not null").select(F.col("chunk_id").cast("long"), "content")
        own = rows.withColumn("range", self._range(width)).repartition("range").groupBy("range", "chunk_id").agg(F.max("content").alias("content"))
        return _split(own, "content").mapInArrow(_counted, "chunk_id long, dl int, terms array<string>, tfs array<int>")

    def _blocks(self, docs: DataFrame, segment: int, width: int) -> DataFrame:
        """Postings of docs as blocks of chunks of a range of ids; a term has several for a range if that is read in parts.

        A block is shuffled as one array, which has its places in the range, then its counts, then its lengths.
        """
        made = docs.select("chunk_id", "dl", "terms", "tfs").mapInArrow(_blocks_of(width), "term string, range long, packed array<int>")
        placed = made.repartition(self._bucket(), F.floor(F.col("range") / RANGES)).withColumn("n", (F.size("packed") / 3).cast("int"))
        third = lambda k: F.slice("packed", F.col("n") * k + 1, F.col("n"))
        unpacked = placed.select(self._bucket().alias("bucket"), "term", "range", F.lit(segment).alias("segment"), F.transform(third(0), lambda x: x + F.col("range") * width).alias("ids"), third(1).alias("tfs"), third(2).alias("dls"))
        return unpacked.withColumn("max_tf", F.array_max("tfs")).withColumn("min_dl", F.array_min("dls")).sortWithinPartitions("bucket", "term", "range")

    def _unless_gone(self, rows: DataFrame, snapshot: Snapshot) -> DataFrame:
        """Rows (chunk_id, segment) that no later tombstone is for."""
        gone = self.store.read("gone", snapshot).groupBy("chunk_id").agg(F.max("before").alias("before"))
        return rows.join(gone, (rows["chunk_id"] == gone["chunk_id"]) & (rows["segment"] < gone["before"]), "left_anti")

    def _live(self, snapshot: Snapshot) -> DataFrame:
        return self._unless_gone(self.store.read("docs", snapshot), snapshot)

    def merge(self) -> int | None:
        """Merge the first run of ``fan`` or more segments of one tier that follow each other; the new version, or None if there is none.

        A tier is a power of ``fan`` of postings.  What tombstones took away goes for good.
        """
        if self._run(self.store.snapshot().notes["index"]["segments"]) is None:
            return None

        def changes(snapshot: Snapshot) -> Changes:
            notes = snapshot.notes["index"]
            run = self._run(notes["segments"])
            if run is None:
                return {}
            a, b = run
            number = notes["numbers"][b - 1]
            parts = {t: tuple(snapshot.tables[t]["parts"][a:b]) for t in ("postings", "docs")}
            some = self.store.read("docs", Snapshot(snapshot.version, {"docs": {**snapshot.tables["docs"], "parts": list(parts["docs"])}}))
            left = self._unless_gone(some, snapshot).withColumn("range", self._range(self._width(notes))).repartition("range").sortWithinPartitions("range", "chunk_id").withColumn("segment", F.lit(number))
            docs_at, docs = self.store.stage("docs", left.select(*some.columns))
            blocks_at, blocks = self.store.stage("postings", self._blocks(docs, number, self._width(notes)), LAYOUT)
            out: Changes = {"postings": Swap(blocks, parts["postings"], blocks_at), "docs": Swap(docs, parts["docs"], docs_at)}
            out["terms"] = Replace(self.store.read("terms", snapshot).groupBy("bucket", "term").agg(F.sum("df").alias("df")).where("df > 0").select("term", "df", "bucket"))
            following = notes["numbers"][b] if b < len(notes["numbers"]) else notes["next"]
            if a == 0:  # tombstones of segments that were merged have been seen to
                out["gone"] = Replace(self.store.read("gone", snapshot).where(F.col("before") > following))
            swap = lambda xs, x: [*xs[:a], x, *xs[b:]]
            out["index"] = Note({**notes, "segments": swap(notes["segments"], self._size(blocks)), "numbers": swap(notes["numbers"], number)})
            return out

        with tidy(self.store.spark):
            return self.store.commit(changes, layout=LAYOUT)

    def _run(self, sizes: list[int]) -> tuple[int, int] | None:
        tier = lambda n: len(_digits(n, self.fan))
        for a in range(len(sizes)):
            b = a
            while b < len(sizes) and tier(sizes[b]) == tier(sizes[a]):
                b += 1
            if b - a >= self.fan:
                return a, b
        return None

    # Search

    def search(self, queries: DataFrame, k: int, seeds: int = 2) -> DataFrame:
        """query_id, chunk_id, score, rank: the k best chunks of positive score of each query (query_id, query), as ``retrieval.bm25`` has them.

        Only buckets of terms that are asked for are read.  The ``seeds`` ranges of
        the highest bounds are scored first; a range whose bound is less than the k-th score found there is left out.
        Blocks are shuffled once, by range, whatever the number of queries.
        """
        with tidy(self.store.spark):
            return self._search(queries, k, seeds)

    def _search(self, queries: DataFrame, k: int, seeds: int) -> DataFrame:
        snapshot = self.store.snapshot()
        notes = snapshot.notes["index"]
        asked = kept(queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf")).withColumn("bucket", self._bucket()), "index-asked")
        wanted = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # as many as there are buckets
        in_buckets = F.col("bucket").isin(wanted) if wanted else F.lit(False)
        df = self.store.read("terms", snapshot).where(in_buckets).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        raw = self._raw(notes["n"])
        idf = df.select("term", F.when(raw < 0, self.settings.bm25_epsilon * notes["mean"]).otherwise(raw).alias("idf"))
        weighted = kept(asked.join(idf, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight")), "index-weights")
        if asked.count() <= BROADCAST_TERMS:
            weighted = F.broadcast(weighted)
        mean_length = notes["total"] / notes["n"] if notes["n"] else 1.0
        c = self.settings
        saturation = lambda tf, dl: F.col(tf) * (c.bm25_k1 + 1) / (F.col(tf) + c.bm25_k1 * (1 - c.bm25_b + c.bm25_b * F.col(dl) / float(mean_length)))
        postings = self.store.read("postings", snapshot).where(in_buckets)
        highest = postings.select("term", "range", "max_tf", "min_dl").join(weighted, "term").groupBy("query_id", "range", "term").agg(F.max(F.greatest(F.lit(0.0), F.col("weight") * saturation("max_tf", "min_dl"))).alias("bound"))
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "range")
        bounds = kept(highest.groupBy("query_id", "range").agg(F.sum("bound").alias("bound")).withColumn("place", F.row_number().over(order)), "index-bounds")

        parts, width = int(self.store.spark.conf.get("spark.sql.shuffle.partitions")), self._width(notes)
        gone = self.store.read("gone", snapshot).groupBy(self._range(width).alias("range"), "chunk_id").agg(F.max("before").alias("before"))
        tombs = gone.groupBy("range").agg(F.collect_list("chunk_id").alias("ids"), F.collect_list("before").alias("befores")).mapInArrow(_tombs(width), "range long, before array<int>")

        def scored(pairs: DataFrame) -> DataFrame:
            open_ = pairs.groupBy("range").agg(F.collect_list("query_id").alias("open"))
            asked_for = postings.join(weighted.select("term").distinct(), "term", "left_semi").select("term", "range", "segment", F.arrays_zip("ids", "tfs", "dls").alias("e"))
            met = asked_for.repartition(parts, "range").join(open_, "range").join(tombs, "range", "left")
            alive = F.filter("e", lambda x: F.get("before", (x["ids"] - F.col("range") * width).cast("int")) <= F.col("segment"))
            left = met.withColumn("e", F.when(F.col("before").isNull(), F.col("e")).otherwise(alive)).drop("before").where(F.size("e") > 0)
            asking = left.join(weighted, "term").where(F.array_contains("open", F.col("query_id")))
            entries = asking.select("range", "query_id", "weight", F.explode("e").alias("e")).select("range", "query_id", "weight", F.col("e.ids").alias("chunk_id"), F.col("e.tfs").alias("tf"), F.col("e.dls").alias("dl"))
            sums = entries.groupBy("range", "query_id", "chunk_id").agg(F.round(F.sum(F.col("weight") * saturation("tf", "dl")), 9).alias("score"))
            return _top(sums.where("score > 0").select("query_id", "chunk_id", "score"), ("query_id",), k, F.desc("score"), F.asc("chunk_id"))

        first = kept(scored(bounds.where(F.col("place") <= seeds)), "index-first")
        least = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        open_ = bounds.where(F.col("place") > seeds).join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") + 1e-8 >= F.col("least")))
        return _top(first.drop("rank").unionByName(scored(open_).drop("rank")), ("query_id",), k, F.desc("score"), F.asc("chunk_id"))


def _digits(n: int, base: int) -> list[int]:
    out = []
    while n:
        n, d = divmod(n, base)
        out.append(d)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """chunk_id and tokens to chunk_id, dl, terms and tfs."""
    for batch in batches:
        sizes = pc.list_value_length(batch.column(1)).to_numpy()
        for a, b in _cuts(sizes):
            part = batch.slice(a, b - a)
            words = part.column(1).flatten().dictionary_encode()
            n = max(1, len(words.dictionary))
            key, tfs = np.unique(np.repeat(np.arange(b - a), sizes[a:b]) * n + words.indices.to_numpy(), return_counts=True)
            at = pa.array(np.searchsorted(key, np.arange(b - a + 1) * n).astype(np.int32))
            terms = words.dictionary.take(pa.array(key % n))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes[a:b], pa.int32()), pa.ListArray.from_arrays(at, terms), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int32()))], ["chunk_id", "dl", "terms", "tfs"])


def _blocks_of(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """chunk_id, dl, terms and tfs to term, range and packed; rows of a range that follow each other make one block for each term, ``SLICE`` postings at a time."""

    def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        chunk, dl = (rows.column(k).to_numpy() for k in (0, 1))
        terms, tfs = (pa.concat_arrays([x.flatten() for x in rows.column(k).chunks]) for k in (2, 3))
        words = terms.dictionary_encode()
        row = np.repeat(np.arange(len(chunk)), pc.list_value_length(rows.column(2)).to_numpy())
        order = np.lexsort((chunk[row], words.indices.to_numpy()))
        code, row, tf = words.indices.to_numpy()[order], row[order], tfs.to_numpy()[order]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        sizes = np.diff(np.r_[first, len(code)])
        at, step = np.arange(len(code)) + 2 * np.repeat(first, sizes), np.repeat(sizes, sizes)
        packed, place = np.empty(3 * len(code), np.int32), int(chunk[0]) // width
        for k, values in enumerate((chunk[row] - place * width, tf, dl[row])):
            packed[at + k * step] = values
        lists = pa.ListArray.from_arrays(pa.array((3 * np.r_[first, len(code)]).astype(np.int32)), pa.array(packed))
        return pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(code[first])), pa.repeat(pa.scalar(place, pa.int64()), len(first)), lists], ["term", "range", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, place = 0, None
        for batch in batches:
            ranges = batch.column(0).to_numpy() // width
            sizes = pc.list_value_length(batch.column(2)).to_numpy()
            edges = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1], True]) if len(ranges) else []
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                for a, b in _cuts(sizes[x:y]):
                    n = int(sizes[x + a : x + b].sum())
                    if held and (place != ranges[x] or size + n > SLICE):
                        yield made(held)
                        held, size = [], 0
                    held.append(batch.slice(x + a, b - a))
                    size, place = size + n, ranges[x]
        if held:
            yield made(held)

    return run


def _tombs(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """range, ids and befores to range and, for each place in it, the first segment that its tombstone leaves, or 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                place, before = batch.column(0)[k].as_py(), np.zeros(width, np.int32)
                before[batch.column(1)[k].values.to_numpy() - place * width] = batch.column(2)[k].values.to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([before], pa.list_(pa.int32()))], ["range", "before"])

    return run


def _cuts(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Runs of rows of about ``SLICE`` in all at most, or one larger row."""
    edges = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE)) + 1), len(sizes)] if len(sizes) else [0]
    return list(zip(edges[:-1], edges[1:], strict=True))
