"""Byte-level BPE of whole texts, by overlapping chunks.

A long text is dealt out in chunks that overlap.  Each is split into pre-tokens
on its own; only those next to its ends can be wrong.  Where two neighbours
have a boundary in common they agree from there on, since the pattern looks
back nowhere, so the text is cut there and the pieces are encoded apart.  A
boundary after white space is never taken, because the pattern looks one
character ahead there.  Neighbours without a common boundary stay in one piece.
Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, filled, shuffle_partitions, slices

CHUNK = 8192  # characters; a text of no more is one chunk
OVERLAP = 512

_ENCODED = "doc_id long, n_tokens long, ids binary"


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def _bytes_by_id(path: str) -> list[bytes]:
    ranks = _ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    return table


def encode_text(text: str, path: str, pattern: str) -> bytes:
    return np.array(encoding(path, pattern).encode_ordinary(text), "<u4").tobytes()


def boundaries(text: str, pattern: str, begin: int, end: int, closed: bool) -> list[int]:
    """Ends of pre-tokens in [begin, end) that don't follow white space.

    Unless the text is closed (nothing follows it), ends whose match could
    change with what follows are left out.
    """
    out = []
    for m in regex.compile(pattern).finditer(text, begin):
        at = m.end()
        if at >= end or (not closed and at >= len(text)):
            break
        if not text[at - 1].isspace():
            out.append(at)
    return out


def _encode_short(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids = [encode_text(x.as_py(), path, pattern) for x in filled(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.mapInArrow(run, _ENCODED)


def _chunks(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """row (one for each row of ``docs``), doc_id, k, text: each chunk with ``overlap`` characters of the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                value = text.as_py()
                row += 1
                for k, start in enumerate(range(0, len(value), chunk)):
                    yield pa.RecordBatch.from_pydict({"row": [row], "doc_id": pa.array([doc.as_py()], pa.int64()), "k": [k], "text": [value[start : start + chunk + overlap]]})

    return docs.mapInArrow(run, "row long, doc_id long, k long, text string")


def _encode_long(docs: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Places of cuts count from the border that they lie behind: a chunk's ``head`` from its start, its ``tail`` and ``cut`` from its end.

    A piece that is cut in its chunk's overlap on both sides is encoded where
    that chunk is; only chunks without a cut between them are put together.
    """
    chunks = cut(_chunks(docs, chunk, overlap), "bpe-chunks")  # rows keep their numbers, whatever is computed again
    # Read twice, shuffled once: the filter, which the join would add on one side alone, keeps both readings the same.
    dealt = chunks.where("row is not null and k is not null").repartition(shuffle_partitions(docs.sparkSession), "row", "k")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int32())
        for batch in batches:
            found = [boundaries(x.as_py(), pattern, 0, chunk + overlap, closed=False) for x in batch.column(3)]
            head, tail = [[x for x in own if x < overlap] for own in found], [[x - chunk for x in own if x >= chunk] for own in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(head, kind), pa.array(tail, kind)], ["row", "k", "head", "tail"])

    seen = dealt.mapInArrow(ends, "row long, k long, head array<int>, tail array<int>")
    in_text = Window.partitionBy("row").orderBy("k")
    following = F.lead("k").over(in_text).isNotNull()
    cuts = seen.select("row", "k", following.alias("goes_on"), F.array_min(F.array_intersect("tail", F.lead("head").over(in_text))).alias("cut"))
    before = F.lag("cut").over(in_text)
    cuts = cuts.select("row", "k", "goes_on", "cut", before.alias("from"), F.sum(F.when(F.col("k") == 0, 0).otherwise(before.isNotNull().cast("int"))).over(in_text).alias("piece"))
    whole = dealt.join(cuts, ["row", "k"])
    alone = ((F.col("k") == 0) | F.col("from").isNotNull()) & (~F.col("goes_on") | F.col("cut").isNotNull())
    part = F.struct("k", "text", "cut", "from")
    single = whole.where(alone).select("row", "doc_id", F.array(part).alias("parts"))
    several = whole.where(~alone).groupBy("row", "piece").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(part)).alias("parts")).select("row", "doc_id", "parts")
    narrow = "<u2" if len(_bytes_by_id(path)) <= 1 << 16 else "<u4"  # ids on their way to their document

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, ids = [], []
            for parts in batch.column(2):
                own = parts.as_py()
                text = "".join([x["text"][:chunk] for x in own[:-1]] + [own[-1]["text"]])
                end = len(text) if own[-1]["cut"] is None else len(own) * chunk + own[-1]["cut"]
                first.append(own[0]["k"])
                ids.append(np.frombuffer(encode_text(text[own[0]["from"] or 0 : end], path, pattern), "<u4").astype(narrow).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(first, pa.int64()), pa.array(ids, pa.binary())], ["row", "doc_id", "k", "ids"])

    encoded = single.union(several).mapInArrow(encode, "row long, doc_id long, k long, ids binary")
    gathered = encoded.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("pieces")).select("doc_id", F.col("pieces.ids").alias("ids"))

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(x.as_py()), narrow).astype("<u4").tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return gathered.mapInArrow(stitch, _ENCODED)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", id_column: str = "doc_id", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian 32 bits) of every row, without special tokens.

    ``path`` is the rank file on every executor and ``pattern`` splits text
    before the merges.  A null text is empty and has no ids.  Null and repeated
    doc_ids come out as they went in; no rows give none.  Other columns,
    whatever their names, aren't looked at.
    """
    if not 0 < overlap <= chunk:
        raise ValueError("the overlap must be positive and no longer than a chunk")
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    short = _encode_short(source.where(F.length("text") <= chunk), path, pattern)
    return short.union(_encode_long(source.where(F.length("text") > chunk), path, pattern, chunk, overlap))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of ``encode`` with ``decoded``, the bytes of their ids end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _bytes_by_id(path)
        for batch in batches:
            for part in slices(batch, "ids"):
                decoded = [b"".join([table[i] for i in np.frombuffer(x.as_buffer(), "<u4").tolist()]) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.mapInArrow(run, _ENCODED + ", decoded binary")
