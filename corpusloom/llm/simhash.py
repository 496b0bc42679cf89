"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

Fingerprints of 64 bits link at three or fewer differing bits.  A fingerprint
is cut into four quarters: three errors leave a quarter exact, and one half of
the other 48 bits has at most one error (pigeonhole twice).  Of each 24-bit
half 23 bits are decoded with the perfect Golay code.  A word's *home* is the
index of its codeword; its keys are the home and, where the codeword is three
bits away, the five codewords at four bits.  Of two words one bit apart, either
one's home is within four bits of the other, so it is among its keys.  Rows
meet under (exact quarter, half, codeword index), 28 bits selective, and are
verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import nearcopies
from corpusloom.llm.common import cut, filled, join_few, shuffle_partitions, slices
from corpusloom.llm.components import components, contract

SHINGLE = 3
SEED = 42
MAX_BITS = 3
BUCKET_ROWS = 2048  # a larger bucket is compared block by block in several tasks

GENERATOR = 0xC75  # fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, a generator of the [23, 12, 7] Golay code


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


#: Syndromes of the low 12 and the high 11 bits of a word; a word's syndrome is their sum.
_LOW = np.array([_remainder(x) for x in range(1 << 12)])
_HIGH = np.array([_remainder(x << 12) for x in range(1 << 11)])


def _coset_tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error of up to three bits, and the five errors of four bits where that one has three (else none)."""
    leader = np.zeros(1 << 11, np.int64)
    further: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in (1, 2, 3, 4):
        for bits in combinations(range(23), weight):
            error = sum(1 << b for b in bits)
            s = _remainder(error)
            if weight < 4:
                leader[s] = error
            else:
                further[s].append(error)
    return leader, np.array([x or [-1] * 5 for x in further])


_LEADER, _FURTHER = _coset_tables()


def golay_keys(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """12-bit codeword indices of 23-bit words: the home (n), and the further ones (n by 5, -1: none)."""
    s = _LOW[word & 0xFFF] ^ _HIGH[word >> 12]
    further = _FURTHER[s]
    return (word ^ _LEADER[s]) >> 11, np.where(further < 0, -1, (word[:, None] ^ further) >> 11)


def _halves(fp: np.ndarray, quarter: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    q = [(fp >> np.uint64(16 * k)) & np.uint64(0xFFFF) for k in range(4)]
    a, b, c = (q[k] for k in range(4) if k != quarter)
    rest = a | b << np.uint64(16) | c << np.uint64(32)
    return q[quarter].astype(np.int64), tuple(((rest >> np.uint64(24 * h)) & np.uint64(0x7FFFFF)).astype(np.int64) for h in (0, 1))


def bucket_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of fingerprints (uint64): key, index of the fingerprint, whether it is a home."""
    key, index, home = [], [], []
    at = np.arange(len(fp))
    for quarter in range(4):
        exact, halves = _halves(fp, quarter)
        for h, word in enumerate(halves):
            base = (exact | quarter << 16 | h << 18) << 12
            own, further = golay_keys(word)
            i, j = np.nonzero(further >= 0)
            key += [base | own, base[i] | further[i, j]]
            index += [at, i]
            home += [np.ones(len(at), bool), np.zeros(len(i), bool)]
    return np.concatenate(key), np.concatenate(index), np.concatenate(home)


def fingerprint(text: str) -> int:
    """The fingerprint of a whole text; no words give zero."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    joined, h = b" ".join(w), xxhash.xxh64_digest
    if len(w) < SHINGLE:
        digests = h(joined, SEED)
    else:
        length = np.fromiter(map(len, w), np.int64, len(w))
        end = np.cumsum(length + 1) - 1
        start = end - length
        digests = b"".join([h(joined[a:b], SEED) for a, b in zip(start[: 1 - SHINGLE].tolist(), end[SHINGLE - 1 :].tolist(), strict=True)])
    octets = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    counts = np.bincount((octets + np.arange(0, 2048, 256)).ravel(), minlength=2048).reshape(8, 256)
    bits = (counts @ np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)).ravel()
    return int.from_bytes(np.packbits(2 * bits > len(octets)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, for every row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            fp = np.fromiter((fingerprint(x) for x in filled(batch.column(1)).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, "doc_id long, fp long")


def _pairs_in_groups(key: np.ndarray, fp: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contracted links between rows of equal keys; rows are in the order of their keys."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    left = np.repeat(start + size, size) - np.arange(len(key))  # rows from here to the group's end
    at, step = np.flatnonzero(left > 1), 1
    us, vs, found = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], 0
    while len(at):
        other = at + step
        near = (home[at] | home[other]) & (np.bitwise_count(fp[at] ^ fp[other]) <= MAX_BITS) & (fp[at] != fp[other])
        us.append(fp[at[near]])
        vs.append(fp[other[near]])
        found += int(near.sum())
        if found > 1 << 20:
            u, v = contract(np.concatenate(us), np.concatenate(vs))
            us, vs, found = [u], [v], 0
        step += 1
        at = at[left[at] > step]
    return contract(np.concatenate(us), np.concatenate(vs))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key.  A link has a null key; a row of a bucket that is too large goes on with its key."""

    def rows(u: np.ndarray, v: np.ndarray, key: np.ndarray | None, home: np.ndarray | None) -> pa.RecordBatch:
        n = len(u)
        return pa.RecordBatch.from_arrays(
            [
                pa.nulls(n, pa.int64()) if key is None else pa.array(key),
                pa.array(u.view(np.int64)),
                pa.nulls(n, pa.int64()) if v is None else pa.array(v.view(np.int64)),
                pa.nulls(n, pa.bool_()) if home is None else pa.array(home),
            ],
            ["key", "u", "v", "home"],
        )

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    large = None

    def flush(key: np.ndarray, fp: np.ndarray, home: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
        """Work off all groups but the last one, which may go on in the next batch."""
        nonlocal held, large
        end = len(key) if last else int(np.searchsorted(key, key[-1])) if len(key) else 0
        start = np.flatnonzero(np.r_[True, key[1:end] != key[: end - 1]]) if end else np.zeros(0, np.int64)
        size = np.diff(np.r_[start, end])
        too_large = np.repeat(size > BUCKET_ROWS, size)
        if large is not None:
            too_large |= key[:end] == large
        if too_large.any():
            yield rows(fp[:end][too_large], None, key[:end][too_large], home[:end][too_large])
        u, v = _pairs_in_groups(key[:end][~too_large], fp[:end][~too_large], home[:end][~too_large])
        if len(u):
            yield rows(u, v, None, None)
        rest = (key[end:], fp[end:], home[end:])
        if len(rest[0]) > BUCKET_ROWS or (large is not None and len(rest[0]) and rest[0][0] == large):
            large = rest[0][0]
            yield rows(rest[1], None, rest[0], rest[2])
            rest = tuple(x[:0] for x in rest)
        held = [rest]

    for batch in batches:
        new = (batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False))
        yield from flush(*(np.concatenate(x) for x in zip(*held, new, strict=True)), last=False)
    if held:
        yield from flush(*held[0], last=True)


def _block_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Contracted links within a pair of blocks of one large bucket."""
    fp, home = pdf["u"].to_numpy().view(np.uint64), pdf["home"].to_numpy(bool)
    us, vs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for a in range(0, len(fp), 256):
        near = np.bitwise_count(fp[a : a + 256, None] ^ fp[None, :]) <= MAX_BITS
        i, j = np.nonzero(near & (home[a : a + 256, None] | home[None, :]))
        u, v = contract(fp[a + i], fp[j])
        us.append(u)
        vs.append(v)
    u, v = contract(np.concatenate(us), np.concatenate(vs))
    return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})


def links(distinct: DataFrame) -> DataFrame:
    """Links u, v between distinct fingerprints (column fp), contracted to few edges with the same components.

    All pairs at three or fewer bits are found.  Buckets are streamed; one of
    over ``BUCKET_ROWS`` rows is dealt out in pairs of blocks, which takes a row
    of n in a bucket to n / ``BUCKET_ROWS`` tasks.  Fingerprints are distinct
    here, so no number of exact copies makes a bucket large.
    """
    spark = distinct.sparkSession

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for a in range(0, len(fp), 4096):
                key, index, home = bucket_keys(fp[a : a + 4096].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[a + index]), pa.array(home)], ["key", "fp", "home"])

    partitions = shuffle_partitions(spark)
    dealt_out = distinct.select("fp").repartition(partitions)  # each gives some 43 keys, which few tasks shouldn't make
    met = dealt_out.mapInArrow(keys, "key long, fp long, home boolean").repartition(partitions, "key").sortWithinPartitions("key")
    found = cut(met.mapInArrow(_links, "key long, u long, v long, home boolean"), "simhash-links")
    small = found.where("key is null").select("u", "v")
    rest = found.where("key is not null")
    blocks = rest.groupBy("key").agg(F.ceil(F.count("*") / BUCKET_ROWS).cast("int").alias("blocks"))
    dealt = (
        rest.join(blocks, "key")
        .withColumn("own", F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "u", "home", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    )
    return small.union(dealt.groupBy("key", "a", "b").applyInPandas(_block_links, "u long, v long"))


def near_duplicates(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable by links, for every row.

    Exact copies and texts without words share a fingerprint and so a
    component.  Repeated rows come out repeated.  A null doc_id takes part but
    is never a component's id (a component of nulls alone has a null id).
    Texts of any length are read whole.  Other columns, whatever their names,
    aren't looked at; an empty table gives no rows.
    """
    prints = cut(fingerprints(docs, text, id_column), "simhash-fingerprints")
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    root = components(links(first)).withColumnRenamed("node", "fp")
    rooted = first.join(root, "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    component = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = cut(rooted.join(component, "root").select("fp", "component_id", "n"), "simhash-components")
    return join_few(prints, by_print, ["fp"], ["doc_id"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that lead their component of near copies, all columns unchanged; a row without doc_id stays.

    Near copies have a five-word Jaccard similarity of 0.8 or more.  The texts
    of a component of fingerprints, as ``near_duplicates`` has them, are held
    against each other; three bits reach only to 0.98 or so, and at 0.8
    fingerprints lie too far apart to be keys, so keys of shingles add what is
    less alike.  Of repeated rows with a leading doc_id all stay, since nothing
    tells them apart; clashing extra columns do no harm.
    """
    lead = nearcopies.leaders(docs, fingerprint, lambda prints: components(links(prints))).withColumnRenamed("doc_id", "__lead")
    with_id = docs.where(docs["doc_id"].isNotNull())
    return with_id.join(lead, with_id["doc_id"] == F.col("__lead"), "left_semi").union(docs.where(docs["doc_id"].isNull()))
