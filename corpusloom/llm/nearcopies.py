"""Near copies of texts: SimHash classes and the overlap of five-word shingles.

Two texts are near copies where the Jaccard similarity of their sets of
``SHINGLE``-word shingles is 0.8 or more.  Candidates are of one SimHash class,
whose fingerprints are linked by up to three bits, or, as most pairs of such
similarity have fingerprints further apart, share one of ``BANDS`` keys of
``ROWS`` minima each (at 0.8 a pair misses all of them once in 1,500, higher up
far more rarely).  A class is a key like any other: each candidate pair is
verified on the whole sets.

Candidates under one key are first held against the smallest of them, the lead.
Those that this links need no further comparison.  Under a key that still has
several components, rows outside of the lead's are held against all others:
such rows and those of the lead's component are dealt out in blocks, a task
compares two blocks and passes on only as many links as join what it joins.
So no group is gathered and no pairs are written; a key with m rows beside n of
the lead's component takes at most m * n + m * m comparisons within tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, filled, join_few, shuffle_partitions, slices
from corpusloom.llm.components import components, contract

SHINGLE = 5
NUMERATOR, DENOMINATOR = 4, 5  # least similarity
BANDS = 24
ROWS = 6
SEED = 42
BLOCK_ROWS = 1024  # of one key that are compared with as many others in one task, on average at most
BLOCK_BYTES = 8 << 20  # of their sets
COLUMNS = 4096  # shingles looked at in one step

_RNG = np.random.default_rng(SEED)
_FACTOR = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSET = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes (uint64) of the shingles; a shorter text is one, no words give none."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(w), xxhash.xxh64_intdigest
    length = np.fromiter(map(len, w), np.int64, len(w))
    end = np.cumsum(length + 1) - 1
    start, stop = (end - length)[: max(1, len(w) - SHINGLE + 1)].tolist(), end[min(SHINGLE, len(w)) - 1 :].tolist()
    return np.unique(np.fromiter((h(joined[a:b], SEED) for a, b in zip(start, stop, strict=True)), np.uint64, len(start)))


def signature(own: np.ndarray) -> int:
    """Equal for equal sets; zero for the empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64)) if len(own) else 0


def band_keys(own: np.ndarray) -> np.ndarray:
    """Keys (int64) of a set, none for the empty one."""
    if not len(own):
        return np.zeros(0, np.int64)
    least = np.min([(own[a : a + 2048, None] * _FACTOR + _OFFSET).min(axis=0) for a in range(0, len(own), 2048)], axis=0).reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = (out ^ least[:, k]) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs u, v of signatures whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k) for k in (2, 3))
            near = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(a, b, strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(near, pa.bool_()))

    counts = pairs.groupBy("u").agg(F.count("*").alias("n"))
    leads = cut(sets.join(counts, sets["sig"] == counts["u"]).select("u", F.col("own").alias("own_u"), "n"), "near-leads")
    met = join_few(pairs, leads, ["u"], ["v"]).join(sets.select(F.col("sig").alias("v"), F.col("own").alias("own_v")), "v")
    return met.select("u", "v", "own_u", "own_v").mapInArrow(run, "u long, v long")


def cross_links(sets: list[np.ndarray], sig: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contracted links between similar sets of different roots; what two sets share is counted exactly."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    kinds, code, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n[code] > 1
    number = np.cumsum(n > 1) - 1
    doc, code = np.repeat(np.arange(len(sets)), size)[shared], number[code[shared]]
    order = np.argsort(code, kind="stable")
    doc, code = doc[order], code[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int((n > 1).sum()), COLUMNS):
        a, b = np.searchsorted(code, (start, start + COLUMNS))
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[doc[a:b], code[a:b] - start] = 1
        both += has @ has.T
    near = (DENOMINATOR + NUMERATOR) * both >= NUMERATOR * (size[:, None] + size[None, :])
    i, j = np.nonzero(np.triu(near & (root[:, None] != root[None, :]), 1))
    return contract(sig[i], sig[j])


def _block_links(pdf: pd.DataFrame) -> pd.DataFrame:
    u, v = cross_links([np.frombuffer(x, np.uint64) for x in pdf["own"]], pdf["sig"].to_numpy(), pdf["root"].to_numpy())
    return pd.DataFrame({"u": u, "v": v})


def _apart(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the components of each key; ``placed`` has key, sig, lead and root."""
    others = placed.where("sig = lead").select("key", F.col("root").alias("main"))
    several = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    rows = placed.join(several.join(others, "key"), "key").select("key", "sig", "root", (F.col("root") == F.col("main")).alias("in_main"))
    rows = cut(rows.join(sets, "sig").select("*", F.octet_length("own").alias("bytes")), "near-apart")
    blocks = lambda flag: F.greatest(F.ceil(F.sum(F.when(flag, F.col("bytes"))) / BLOCK_BYTES), F.ceil(F.count(F.when(flag, 1)) / BLOCK_ROWS), F.lit(1)).cast("int")
    sizes = cut(rows.groupBy("key").agg(blocks(F.col("in_main")).alias("mains"), blocks(~F.col("in_main")).alias("outs"), F.count("*").alias("n")), "near-blocks")
    dealt = join_few(rows, sizes, ["key"], ["sig"]).withColumn("own_block", F.pmod(F.xxhash64("sig"), F.when(F.col("in_main"), F.col("mains")).otherwise(F.col("outs"))).cast("int"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    pair = lambda main, a, b: F.struct(F.lit(main).alias("main"), a.alias("a"), b.alias("b"))
    own = F.col("own_block")
    with_mains = F.transform(upto("mains"), lambda x: pair(True, x, own))
    with_outs = F.transform(upto("outs"), lambda x: pair(False, F.least(x, own), F.greatest(x, own)))
    places = F.when(F.col("in_main"), F.transform(upto("outs"), lambda x: pair(True, own, x))).otherwise(F.concat(with_mains, with_outs))
    return dealt.select("key", "sig", "root", "own", F.explode(places).alias("place")).groupBy("key", "place").applyInPandas(_block_links, "u long, v long")


def leaders(docs: DataFrame, fingerprint: Callable[[str], int], classes: Callable[[DataFrame], DataFrame], text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id of the leading document of each component of near copies: the smallest one.

    ``fingerprint`` is a text's SimHash; ``classes`` gives node and root for
    linked ones among distinct fingerprints (column fp) that aren't roots.
    Texts without words are copies of each other.  A null doc_id takes part but never leads.
    """
    partitions = shuffle_partitions(docs.sparkSession)
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            texts = filled(batch.column(1)).to_pylist()
            sets = [shingles(x) for x in texts]
            fp = np.fromiter(map(fingerprint, texts), np.uint64, len(texts))
            bands = pa.array([band_keys(x) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([signature(x) for x in sets], pa.int64()), pa.array(fp.view(np.int64)), bands], ["doc_id", "sig", "fp", "bands"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                sets = [shingles(x) for x in filled(batch.column(1).slice(a, 256)).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([signature(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["sig", "own"])

    marks = source.mapInArrow(mark, "doc_id long, sig long, fp long, bands array<long>")
    prints = cut(marks.groupBy("sig", "fp").agg(F.min("doc_id").alias("first"), F.first("bands").alias("bands")), "near-signatures")
    first = prints.groupBy("sig").agg(F.min("first").alias("first"))
    bands = prints.groupBy("sig").agg(F.first("bands").alias("bands")).select("sig", F.explode("bands").alias("key"))
    counts = prints.groupBy("fp").agg(F.count("*").alias("n"))
    by_print = cut(counts.join(classes(counts).withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", F.xxhash64(F.coalesce("root", "fp")).alias("key")), "near-classes")
    classed = join_few(prints.where("sig <> 0").select("sig", "fp"), by_print, ["fp"], ["sig"]).select("sig", "key").distinct()
    members = bands.union(classed).repartition(partitions, "key")
    shared = members.groupBy("key").agg(F.min("sig").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = cut(members.join(shared, "key").select("key", "sig", "lead"), "near-candidates")
    wanted = met.select("sig").distinct().join(first.select("sig", "first"), "sig")
    looked_up = source.join(wanted.select("first").distinct(), source["doc_id"].eqNullSafe(F.col("first")), "left_semi")
    sets = cut(looked_up.mapInArrow(gather, "sig long, own binary").join(wanted.select("sig"), "sig", "left_semi").dropDuplicates(["sig"]), "near-sets")

    pairs = cut(met.where("sig <> lead").select(F.col("lead").alias("u"), F.col("sig").alias("v")).distinct(), "near-pairs")
    near = cut(_verified(pairs, sets), "near-links")
    root = components(near)
    placed = met.join(root.withColumnRenamed("node", "sig"), "sig", "left").select("key", "sig", "lead", F.coalesce("root", "sig").alias("root"))
    more = cut(_apart(placed, sets), "near-links")
    if not more.isEmpty():
        root = components(near.union(more))
    rooted = first.join(root.withColumnRenamed("node", "sig"), "sig", "left").select("first", F.coalesce("root", "sig").alias("root"))
    return rooted.groupBy("root").agg(F.min("first").alias("doc_id")).where("doc_id is not null").select("doc_id").distinct()
