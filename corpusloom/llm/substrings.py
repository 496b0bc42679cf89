"""Exact substring dedup by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of one document.  Its minimiser is the
smallest hash among its ``GRAM``-word grams.  Consecutive windows that share a
minimiser travel together, as one packed string, to the bucket of that
minimiser; equal windows have equal minimisers, so they meet there, and sorting
finds equal windows and their smallest document exactly.

Of equal packed strings of a slice of text only those of the smallest document
go to the bucket; the words of the others are known to be covered, and their
ranges go to any partition, in even shares.  So a passage in a third of all
documents is one row of its bucket for each slice.  Common grams, which a sample
of the documents shows, come last in the order of grams: a window has one as its
minimiser only if all its grams are common, as those of such a passage are, and
a common phrase in other surroundings goes to the buckets of its neighbours.
The sample sets where windows meet, never which are found.  The number of
buckets follows the bytes of text, so that a bucket fits a task's memory at any
size of input.  One that is still too large is not held: its windows go on one
by one and Spark aggregates them by content.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from corpusloom.llm.common import codes, cut, filled, join_few, shuffle_partitions, slices, window_hash, words

WINDOW = 13
GRAM = 4
MAX_RUN = 2048  # windows in one packed string
SUBBUCKETS = 4  # parts of a bucket that are looked at one after the other
BUCKET_BYTES = 24 << 20  # a bucket with more packed bytes is dealt out window by window
MEAN_BUCKET = 6 << 20  # packed bytes of a bucket on average, at most
PARTITION_BYTES = 192 << 20  # packed bytes of a shuffle partition on average, at most
EXPANSION = 3  # packed bytes for each byte of text: runs of some six windows are 18 words
SLICE = 3 << 20
SAMPLE = 1 / 64  # of the documents, in which grams are counted
HOT_GRAMS = 1 << 16  # a gram with a larger share of the sample's grams than one over this is common
LEAST = 8  # and stands there as often

_RANGE = "wkey binary, doc_id long, text_hash long, start long, stop long"


def _joined(flat: pa.Array) -> bytes:
    """The words with a space between them."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat), " ")[0].as_buffer().to_pybytes()


def _hashes(flat: pa.Array) -> np.ndarray:
    """A hash for each word."""
    code, distinct = codes(flat)
    digest = xxhash.xxh64_intdigest
    return np.fromiter(map(digest, _joined(distinct).split(b" ")), np.uint64, len(distinct))[code]


def _grams(batches: Iterator[pa.RecordBatch], gram: int) -> Iterator[pa.RecordBatch]:
    for part in (p for batch in batches for p in slices(batch, max_bytes=SLICE)):
        flat, n_words = words(part.column(0))
        owner = np.repeat(np.arange(part.num_rows), n_words)
        if len(flat) >= gram:
            g, n = np.unique(window_hash(_hashes(flat), gram)[owner[: len(flat) - gram + 1] == owner[gram - 1 :]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n)], ["gram", "n"])


def common_grams(docs: DataFrame, window: int = WINDOW) -> np.ndarray:
    """Hashes of common grams, sorted; there are fewer than ``HOT_GRAMS``."""
    sample, total = docs.where("text is not null").select("text").sample(SAMPLE, seed=8), Observation()
    counted = sample.mapInArrow(lambda it: _grams(it, min(GRAM, window)), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    table = cut(counted.observe(total, F.coalesce(F.sum("n"), F.lit(0)).alias("n")).where(F.col("n") >= LEAST), "substring-grams")
    rows = table.where(F.col("n") * HOT_GRAMS > total.get["n"]).select("gram").toArrow()
    return np.sort(rows.column(0).to_numpy().view(np.uint64))


def _minimisers(hashes: np.ndarray, window: int, common: np.ndarray) -> np.ndarray:
    """The first gram of each window, by hash with common ones last; ``hashes`` has one hash for each word."""
    gram = min(GRAM, window)
    g = window_hash(hashes, gram)
    if len(common):
        prefix = np.zeros(1 << 20, bool)
        prefix[common >> np.uint64(44)] = True
        maybe = np.flatnonzero(prefix[g >> np.uint64(44)])
        last = maybe[common[np.minimum(np.searchsorted(common, g[maybe]), len(common) - 1)] == g[maybe]]
        g >>= np.uint64(1)
        g[last] |= np.uint64(1 << 63)
    width = window - gram + 1
    low, have = g, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    return np.minimum(low[: len(low) - (width - have)], low[width - have :]) if width > have else low


def _pack(doc: np.ndarray, text_hash: np.ndarray, pos: np.ndarray, count: np.ndarray, sub: np.ndarray, packed: list[bytes]) -> bytes:
    head = np.array([len(doc)], np.int64).tobytes()
    columns = doc.tobytes() + text_hash.tobytes() + pos.astype(np.int64).tobytes() + count.astype(np.int32).tobytes() + sub.astype(np.uint8).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + columns + b"\n".join(packed))


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    at, out = 8, []
    for kind, size in ((np.int64, 8), (np.int64, 8), (np.int64, 8), (np.int32, 4), (np.uint8, 1)):
        out.append(np.frombuffer(data, kind, n, at))
        at += n * size
    return (*out, np.array(data[at:].split(b"\n"), object))


def _known(row: np.ndarray, doc: np.ndarray, text_hash: np.ndarray, start: np.ndarray, stop: np.ndarray) -> bytes:
    """Ranges of words, in order, that are already known to be covered; those that meet are joined."""
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (start[1:] > stop[:-1])])
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate([doc[new], text_hash[new], start[new], stop[np.r_[new[1:] - 1, len(stop) - 1]]]).tobytes())


def _super_kmers(part: pa.RecordBatch, window: int, buckets: int, common: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed strings) of a slice of doc_id, text_hash and text, and known ranges under a number below zero."""
    flat, n_words = words(part.column(2))
    n = len(flat)
    if n < window:
        return
    owner = np.repeat(np.arange(part.num_rows), n_words)
    low = _minimisers(_hashes(flat), window, common)
    valid = owner[: n - window + 1] == owner[window - 1 :]
    at = np.flatnonzero(valid)
    if not len(at):
        return
    new = np.r_[True, (np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]]) | (low[at[1:]] != low[at[:-1]])]
    first = at[new]
    count = np.diff(np.r_[np.flatnonzero(new), len(at)])
    parts = -(-count // MAX_RUN)
    step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first, count = np.repeat(first, parts) + step * MAX_RUN, np.minimum(np.repeat(count, parts) - step * MAX_RUN, MAX_RUN)

    length = pc.binary_length(flat).to_numpy().astype(np.int64)
    end = np.cumsum(length + 1) - 1
    joined = _joined(flat)
    packed = [joined[a:b] for a, b in zip((end - length)[first].tolist(), end[first + count + window - 2].tolist(), strict=True)]

    doc, text_hash = part.column(0).to_numpy()[owner[first]], part.column(1).to_numpy()[owner[first]]
    same, kinds = codes(pa.array(packed, pa.binary()))
    smallest = np.full(len(kinds), np.iinfo(np.int64).max)
    np.minimum.at(smallest, same, doc)
    text_start = np.cumsum(n_words) - n_words
    pos, key = first - text_start[owner[first]], low[first]
    bucket, sub = (key % np.uint64(buckets)).astype(np.int64), ((key // np.uint64(buckets)) % np.uint64(SUBBUCKETS)).astype(np.uint8)
    covered = np.flatnonzero(doc > smallest[same])
    if len(covered):
        start = pos[covered]
        yield -1 - int(text_hash[covered[0]] % buckets), _known(owner[first[covered]], doc[covered], text_hash[covered], start, start + count[covered] + window - 1)
    going = np.flatnonzero(doc == smallest[same])
    order = going[np.argsort(bucket[going], kind="stable")]
    edges = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True])
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own = order[a:b]
        yield int(bucket[own[0]]), _pack(doc[own], text_hash[own], pos[own], count[own], sub[own], [packed[i] for i in own.tolist()])


def _rows(doc: np.ndarray, text_hash: np.ndarray, start: np.ndarray, stop: np.ndarray, wkey: list[bytes] | None = None) -> pa.RecordBatch:
    keys = pa.nulls(len(doc), pa.binary()) if wkey is None else pa.array(wkey, pa.binary())
    return pa.RecordBatch.from_arrays([keys, *(pa.array(x, pa.int64()) for x in (doc, text_hash, start, stop))], ["wkey", "doc_id", "text_hash", "start", "stop"])


def _windows(packed: np.ndarray, window: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Words of packed strings, their string, the starts of whole windows, and each string's first word."""
    flat, n_words = words(pa.array(packed.tolist(), pa.binary()).view(pa.string()))
    owner = np.repeat(np.arange(len(packed)), n_words)
    at = np.flatnonzero(owner[: len(flat) - window + 1] == owner[window - 1 :]) if len(flat) >= window else np.zeros(0, np.int64)
    return flat, owner, at, np.cumsum(n_words) - n_words


def _covered(doc: np.ndarray, text_hash: np.ndarray, pos: np.ndarray, packed: np.ndarray, window: int) -> pa.RecordBatch:
    """Ranges of words in windows that a smaller document has too, among the strings given."""
    flat, owner, at, first = _windows(packed, window)
    code = codes(flat)[0]
    h = window_hash(code, window)[at]
    order = np.argsort(h)
    twin = h[order][1:] == h[order][:-1]
    some = order[np.r_[twin, False] | np.r_[False, twin]]
    some = some[np.lexsort((doc[owner[at[some]]], h[some]))]
    start = at[some]
    leads = np.ones(len(some), bool)
    if len(some) > 1:
        match = h[some][1:] == h[some][:-1]
        for k in range(window):
            match &= code[start[1:] + k] == code[start[:-1] + k]
        leads[1:] = ~match
    lead = np.maximum.accumulate(np.where(leads, np.arange(len(some)), 0))
    later = doc[owner[start]] > doc[owner[start[lead]]]
    hit = np.sort(start[later])
    new = np.r_[True, (np.diff(hit) != 1) | (owner[hit[1:]] != owner[hit[:-1]])] if len(hit) else np.zeros(0, bool)
    begin = hit[new]
    last = hit[np.r_[np.flatnonzero(new)[1:] - 1, len(hit) - 1]] if len(hit) else hit
    own = owner[begin]
    shift = pos[own] - first[own]
    return _rows(doc[own], text_hash[own], begin + shift, last + shift + window)


def _one_by_one(blob: bytes, window: int) -> Iterator[pa.RecordBatch]:
    """Every window of a bucket that is too large, keyed by its words."""
    doc, text_hash, pos, _, _, packed = _unpack(blob)
    flat, owner, at, first = _windows(packed, window)
    length = pc.binary_length(flat).to_numpy().astype(np.int64)
    end = np.cumsum(length + 1) - 1
    joined = _joined(flat)
    keys = [joined[a:b] for a, b in zip((end - length)[at].tolist(), end[at + window - 1].tolist(), strict=True)]
    own = owner[at]
    start = pos[own] + at - first[own]
    yield _rows(doc[own], text_hash[own], start, start + window, keys)


def _in_buckets(batches: Iterator[pa.RecordBatch], window: int, bucket_bytes: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, blob) come sorted by bucket; known ranges have one below zero."""
    limit = bucket_bytes or BUCKET_BYTES
    bucket, held, size, large = None, [], 0, False

    def look() -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        doc, text_hash, pos, _, sub, packed = columns
        for k in range(SUBBUCKETS):
            own = np.flatnonzero(sub == k)
            if len(own) > 1:
                yield _covered(doc[own], text_hash[own], pos[own], packed[own], window)

    for batch in batches:
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if b < 0:
                yield _rows(*np.frombuffer(zstandard.ZstdDecompressor().decompress(blob.as_py()), np.int64).reshape(4, -1))
                continue
            if b != bucket:
                if held:
                    yield from look()
                bucket, held, size, large = b, [], 0, False
            blob = blob.as_py()
            if not large:
                held.append(_unpack(blob))
                size += sum(map(len, held[-1][5]))
                if size > limit:
                    large = True
                    for x in held:
                        yield from _one_by_one(_pack(*x[:5], x[5].tolist()), window)
                    held = []
            else:
                yield from _one_by_one(blob, window)
    if held:
        yield from look()


def met_in_buckets(docs: DataFrame, window: int = WINDOW, bucket_bytes: int = BUCKET_BYTES, mean_bucket: int = MEAN_BUCKET) -> DataFrame:
    """wkey, doc_id, text_hash, start, stop: the ranges that buckets give, and each window of too large ones with its words."""
    source = docs.where("doc_id is not null and text is not null").select("doc_id", "text_hash", "text")
    packed = EXPANSION * (source.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    partitions = max(shuffle_partitions(docs.sparkSession), -(-packed // PARTITION_BYTES))
    buckets = max(4 * partitions, -(-packed // mean_bucket))
    common = common_grams(source, window)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, max_bytes=SLICE):
                made = list(_super_kmers(part, window, buckets, common))
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in made], pa.int64()), pa.array([x[1] for x in made], pa.binary())], ["bucket", "blob"])

    met = source.mapInArrow(cut_up, "bucket long, blob binary").repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return cut(met.mapInArrow(lambda it: _in_buckets(it, window, bucket_bytes), _RANGE), "substring-ranges")


def repeated_ranges(docs: DataFrame, window: int = WINDOW, bucket_bytes: int = BUCKET_BYTES, mean_bucket: int = MEAN_BUCKET) -> DataFrame:
    """doc_id, text_hash, start, stop: word ranges covered by windows that a smaller doc_id has too.

    ``docs`` has doc_id, text_hash and text.  Rows without doc_id or text take no part.
    """
    found = met_in_buckets(docs, window, bucket_bytes, mean_bucket)
    single = found.where("wkey is not null")
    first = cut(single.groupBy("wkey").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "substring-windows")
    later = join_few(single, first, ["wkey"], ["doc_id", "text_hash"]).where("doc_id > first")
    columns = ("doc_id", "text_hash", "start", "stop")
    return found.where("wkey is null").select(*columns).union(later.select(*columns))


def remove_repeats(docs: DataFrame, text: str = "text", id_column: str = "doc_id", window: int = WINDOW, bucket_bytes: int = BUCKET_BYTES, mean_bucket: int = MEAN_BUCKET) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (the words left, joined by a space) for every row.

    A word goes if it is covered by a window whose words also start in a
    document with a smaller doc_id; windows are judged on the input.  A null
    text has no words.  A row without doc_id keeps all and no other row is
    compared with it.  Rows with an equal doc_id aren't compared with each
    other; equal rows get equal results.  Other columns, whatever their names,
    aren't looked at; an empty table gives no rows.  A bucket has
    ``mean_bucket`` packed bytes on average; one of over ``bucket_bytes`` is
    worked off window by window.
    """
    keyed = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    ranges = repeated_ranges(keyed, window, bucket_bytes, mean_bucket).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            n_words, n_removed, kept = [], [], []
            for text, cuts in zip(filled(batch.column(1)), batch.column(2), strict=True):
                left = text.as_buffer().to_pybytes().split()
                total = len(left)
                if cuts.is_valid:
                    edge = np.zeros(total + 1, np.int32)
                    own = cuts.values
                    np.add.at(edge, own.field("start").to_numpy(), 1)
                    np.add.at(edge, own.field("stop").to_numpy(), -1)
                    left = [left[i] for i in np.flatnonzero(np.cumsum(edge)[:total] <= 0).tolist()]
                n_words.append(total)
                n_removed.append(total - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).view(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_text"],
            )

    joined = keyed.join(ranges, ["doc_id", "text_hash"], "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(leave, "doc_id long, n_words long, n_removed long, kept_text string")
