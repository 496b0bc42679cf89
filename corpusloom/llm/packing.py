"""Cost-balanced packing of tokenised documents into sequences of fixed length.

A sequence costs ``linear`` for each token plus ``quadratic`` for each pair of
tokens of one piece, as attention within a document does.  A task tokenises its
documents and cuts each into full sequences and a rest.  Rests gather until
they fill a group of sequences; they are then assigned in descending length,
each to the cheapest sequence that has room for all of it.  A piece that fits
nowhere whole is cut over the cheapest sequences with room, so every sequence
of a group is full.  What is left over opens the next group; only the last
sequence of a task can be short.  Nothing is shuffled, so no key can be hot.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm.common import codes, filled, slices, words

SEQUENCE = 2048
END = 1  # the id after each document
GROUP_SEQUENCES = 512
LINEAR = 1.0
QUADRATIC = 1.0 / 2048

_OUT = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, cost double"


#: Between a Latin letter and an ASCII symbol the tokenizer's splitter has a boundary, so white space there changes nothing.
#: U+0130 isn't among them, since its lower case ends in a mark; nor is any other script, for the same reason here and there.
SPACED = (r"([A-Za-zÀ-ÖØ-öø-įı-ſ])([!-/:-@\[-`{-~])", r"\1 \2")
#: Words that are one pre-token and that normalisation only puts in lower case: Latin letters, or ASCII symbols but the apostrophe.
PLAIN = r"^(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[!-&(-/:-@\[-`{-~]+)$"
END_BYTE = "\0"  # stands for the end of a word in the rank table


def _byte_alphabet() -> dict[str, int]:
    """Bytes by the character that stands for each in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def word_ranks(vocabulary: dict[str, int], suffix: str, special: set[str]) -> dict[bytes, int]:
    """The vocabulary as ranks by bytes, with ``END_BYTE`` for the suffix that ends a word.

    Its ids are in the order of the merges, after the bytes and the bytes that
    end a word, so merging by smallest rank is merging in order.
    """
    alphabet = _byte_alphabet()
    out = {}
    for token, i in vocabulary.items():
        if token not in special:
            body = token.removesuffix(suffix)
            out[bytes(alphabet[c] for c in body) + END_BYTE.encode() * (body != token)] = i
    return out


class WordEncoder:
    """Ids of whole texts by a word tokenizer that never joins what white space parts.

    Each distinct word of a slice is encoded once.  Plain words are merged
    together in one call by rank; the others go through the tokenizer, and so
    does the whole of a text with the string of a special token.
    """

    def __init__(self, path: str) -> None:
        self.whole = Tokenizer.from_file(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a word may look like a special token only once it is in lower case
        special = {x.content for x in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = "|".join(map(re.escape, sorted(special)))
        ranks = word_ranks(self.tokenizer.get_vocab(), self.tokenizer.model.end_of_word_suffix, special)
        self.merges = tiktoken.Encoding("words", pat_str=rf"[^{END_BYTE}]+{END_BYTE}", mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(max(ranks.values()) + 1, bool)
        self.ends[[i for token, i in ranks.items() if token.endswith(END_BYTE.encode())]] = True

    def _plain(self, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.merges.encode_ordinary("".join([w + END_BYTE for w in values]).lower()), np.uint32)
        return ids, np.diff(np.r_[0, np.flatnonzero(self.ends[ids]) + 1])

    def _other(self, values: list[str], tokenizer: Tokenizer | None = None) -> tuple[np.ndarray, np.ndarray]:
        ids = [x.ids for x in (tokenizer or self.tokenizer).encode_batch_fast(values, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum())), size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and how many each text has."""
        texts = filled(texts)
        special = pc.match_substring_regex(texts, self.special).to_numpy(zero_copy_only=False).astype(bool)
        if not special.any():
            return self._by_words(texts)
        ids, size = self._by_words(pc.if_else(pa.array(special), "", texts))
        own, n = self._other(texts.filter(pa.array(special)).to_pylist(), self.whole)
        at = np.repeat((np.cumsum(size) - size)[special], n)
        size[special] = n
        return np.insert(ids, at, own), size

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        flat, n_words = words(pc.replace_substring_regex(texts, *SPACED))
        code, distinct = codes(flat)
        plain = pc.match_substring_regex(distinct, PLAIN)
        chosen = plain.to_numpy(zero_copy_only=False).astype(bool)
        ids_a, size_a = self._plain(distinct.filter(plain).to_pylist())
        ids_b, size_b = self._other(distinct.filter(pc.invert(plain)).to_pylist())
        size, begin = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        size[chosen], size[~chosen] = size_a, size_b
        begin[chosen], begin[~chosen] = np.cumsum(size_a) - size_a, len(ids_a) + np.cumsum(size_b) - size_b
        table = np.concatenate([ids_a, ids_b])
        lengths = size[code]
        stop = np.cumsum(lengths)
        gather = np.arange(stop[-1] if len(stop) else 0) + np.repeat(begin[code] - (stop - lengths), lengths)
        text_ends = np.r_[0, stop][np.cumsum(n_words)]
        return table[gather], np.diff(np.r_[0, text_ends])


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def assign(lengths: np.ndarray, sequences: int, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray]:
    """Pieces (item, start in it, length, sequence, offset) that hold each item's tokens once, and each sequence's cost.

    Items go in descending length (ties: first come) while there is room; what
    doesn't fit in all sequences together isn't in the result.
    """
    cost, room = np.zeros(sequences), np.full(sequences, capacity)
    out = []
    for item in np.argsort(-lengths, kind="stable").tolist():
        done, left = 0, int(lengths[item])
        while left:
            fits = room >= left
            if fits.any():
                take = left
            else:
                fits = room > 0
                if not fits.any():
                    return out, cost
            s = int(np.where(fits, cost, np.inf).argmin())
            take = min(left, int(room[s]))
            out.append((item, done, take, s, capacity - int(room[s])))
            cost[s] += linear * take + quadratic * take * take
            room[s] -= take
            done, left = done + take, left - take
    return out, cost


class _Packer:
    """Packs a task's documents; ``take`` and ``finish`` return finished pieces."""

    def __init__(self, base: int, capacity: int, group: int, linear: float, quadratic: float) -> None:
        self.next, self.capacity, self.group, self.costs = base, capacity, group, (linear, quadratic)
        self.held: list[tuple] = []  # doc_id, start, ids, doc_tokens
        self.tokens = 0

    def take(self, doc: int | None, ids: np.ndarray) -> list[tuple]:
        out, n = [], len(ids)
        whole = n // self.capacity * self.capacity
        for a in range(0, whole, self.capacity):
            out.append((doc, a, ids[a : a + self.capacity], n, self.next, 0, self.costs[0] * self.capacity + self.costs[1] * self.capacity**2))
            self.next += 1
        if whole < n:
            self.held.append((doc, whole, ids[whole:].copy(), n))
            self.tokens += n - whole
        if self.tokens >= self.group * self.capacity:
            out += self._pack(self.tokens // self.capacity)
        return out

    def _pack(self, sequences: int) -> list[tuple]:
        lengths = np.array([len(x[2]) for x in self.held], np.int64)
        pieces, cost = assign(lengths, sequences, self.capacity, *self.costs)
        out, done = [], np.zeros(len(lengths), np.int64)
        for item, a, n, s, offset in pieces:
            doc, start, ids, total = self.held[item]
            out.append((doc, start + a, ids[a : a + n], total, self.next + s, offset, float(cost[s])))
            done[item] = a + n
        self.next += sequences
        self.held = [(doc, start + k, ids[k:], total) for (doc, start, ids, total), k in zip(self.held, done.tolist(), strict=True) if k < len(ids)]
        self.tokens = sum(len(x[2]) for x in self.held)
        return out

    def finish(self) -> list[tuple]:
        """All that is held: full sequences, then one short one."""
        out = self._pack(self.tokens // self.capacity) if self.tokens >= self.capacity else []
        return out + (self._pack(1) if self.tokens else [])


def pack(
    docs: DataFrame,
    tokenizer: str,
    text: str = "text",
    id_column: str = "doc_id",
    capacity: int = SEQUENCE,
    end: int = END,
    group_sequences: int = GROUP_SEQUENCES,
    linear: float = LINEAR,
    quadratic: float = QUADRATIC,
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian 32 bits), doc_tokens, sequence_id, offset, cost.

    ``tokenizer`` is the path of a word tokenizer's file on every executor; ids
    are those of its plain call without special tokens, so the string of a
    special token in a text is that token.  A null or empty text is the end id
    alone; null and repeated doc_ids are packed like any other; no documents
    give no pieces.  Other columns, whatever their names, aren't looked at.
    Sequence ids are unique over the result, and offsets in a sequence start at
    0 without gaps.  A lost task makes the same pieces again, since its input
    is the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        packer = _Packer(TaskContext.get().partitionId() << 32, capacity, group_sequences, linear, quadratic)

        def batch_of(pieces: list[tuple]) -> pa.RecordBatch:
            doc, start, ids, total, sequence, offset, cost = zip(*pieces, strict=True)
            longs = lambda x: pa.array(x, pa.int64())
            return pa.RecordBatch.from_arrays(
                [longs(doc), longs(start), longs([len(x) for x in ids]), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), longs(total), longs(sequence), longs(offset), pa.array(cost, pa.float64())],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "cost"],
            )

        for batch in batches:
            for part in slices(batch):
                ids, counts = encoder.encode(part.column(1))
                stop = np.cumsum(counts)
                pieces: list[tuple] = []
                for doc, a, b in zip(part.column(0).to_pylist(), (stop - counts).tolist(), stop.tolist(), strict=True):
                    pieces += packer.take(doc, np.append(ids[a:b], np.uint32(end)))
                if pieces:
                    yield batch_of(pieces)
        if last := packer.finish():
            yield batch_of(last)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _OUT)
