"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control.

The battery looks at runs of key-like characters, as far as no pattern covers
them; a run that isn't random as a whole is looked at in its parts.  Each
candidate's encoding is inferred from its characters.  Three tests ask whether
it could be uniform over that alphabet: chi-squared of the counts, runs above
and below the middle, and serial correlation.  A candidate that any of them
rejects is ordinary.  For the rest, the chi-squared statistic and the symbols'
likelihood are held against what text of the same length gives, from the
character counts of the whole corpus; Benjamini-Hochberg over the candidates that pass the first
tests, apart for each class of lengths, then sets how small a value must be; as those
that the first tests reject aren't counted, it bounds the share of false finds among the others only.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import bytes_of, cut, filled, slices

KINDS = ("assign", "access", "hex", "random")
MIN_SECRET = 8
MIN_ACCESS = 16
MIN_HEX = 32
MIN_RANDOM = 20
UNIFORM_LEVEL = 0.001  # a test that rejects uniformity at this level makes a candidate ordinary
FALSE_DISCOVERY = 0.01
LENGTH_CLASSES = (24, 32, 48, 64, 128)  # upper bounds; longer ones make the last class
P_BINS = 30001  # of -log10 p, a hundred to a unit, down to 1e-300

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
#: Where a run is parted that has no encoding or isn't random as a whole: base64 parts, base64url parts, base62 parts.
PARTS = tuple(re.compile(x) for x in (r"[A-Za-z0-9+/]{20,}=*", r"[A-Za-z0-9_-]{20,}=*", r"[A-Za-z0-9]{20,}=*"))

#: What a text with any span has, in a dialect that is matched in linear time.
HINTS = (r"(?i)(?:password|passwd|secret|token|api_?key)", r"AKIA", r"[0-9a-f]{32}", r"[A-Za-z0-9+/_=-]{20}")

#: Inferred encodings, narrowest first: name and alphabet.
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("upper_hex", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("upper_base36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_SETS = tuple((name, {c: i for i, c in enumerate(letters)}) for name, letters in ALPHABETS)

_SPAN = "struct<kind:string,start:long,end:long>"
_FOUND = "struct<start:long,end:long,encoding:string,length:long,chi2:double,symbols:array<long>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Pattern matches (kind, start, end) in code points, by start and then kind."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_SECRET]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return in_order(out)


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def infer(run: str) -> tuple[str, np.ndarray, int] | None:
    """Encoding, symbol indices without padding, and alphabet size; None for what has no digit or no letter."""
    body = run.rstrip("=")
    if not any(c.isdigit() for c in body) or not any(c.isalpha() for c in body):
        return None
    for name, index in _SETS:
        if all(c in index for c in body):
            return name, np.fromiter((index[c] for c in body), np.int64, len(body)), len(index)
    return None


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_tail(x: float, k: int) -> float:
    """P(chi-squared with k degrees > x), by the Wilson-Hilferty approximation."""
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return math.erfc(z / math.sqrt(2)) / 2


def battery(symbols: np.ndarray, size: int) -> tuple[float, float, float, float]:
    """Chi-squared statistic, and p-values under uniformity: chi-squared, runs, serial correlation."""
    n = len(symbols)
    counts = np.bincount(symbols, minlength=size)
    chi2 = float(((counts - n / size) ** 2).sum() * size / n)
    high = symbols >= size // 2
    ones = int(high.sum())
    zeros = n - ones
    if not ones or not zeros:
        p_runs = 0.0
    else:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * ones * zeros / n
        spread = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = _two_sided((runs - mean) / math.sqrt(spread)) if spread > 0 else 1.0
    x = symbols - symbols.mean()
    power = float(x @ x)
    p_serial = _two_sided((float(x[1:] @ x[:-1]) / power + 1 / n) * math.sqrt(n)) if power else 0.0
    return chi2, chi2_tail(chi2, size - 1), p_runs, p_serial


def _uniform(text: str, start: int) -> tuple[int, int, str, int, float, np.ndarray] | None:
    found = infer(text)
    if found is None or len(found[1]) < MIN_RANDOM:
        return None
    chi2, *p = battery(found[1], found[2])
    return (start, start + len(text), found[0], len(found[1]), chi2, np.bincount(found[1], minlength=found[2])) if min(p) >= UNIFORM_LEVEL else None


def _gaps(a: int, b: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What [a, b) has outside of the ranges taken, which are in order and apart."""
    for s, e in taken:
        if s > a:
            yield a, s
        a = max(a, e)
    if a < b:
        yield a, b


def _apart(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The ranges that the spans, in order of their starts, cover together."""
    out: list[tuple[int, int]] = []
    for _, s, e in spans:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _in_piece(piece: str, at: int) -> list[tuple[int, int, str, int, float, np.ndarray]]:
    """The piece, if it is uniform as a whole, or else its parts that are; parts of an earlier pattern come first."""
    whole = _uniform(piece, at)
    if whole:
        return [whole]
    taken: list[tuple] = []
    for pattern in PARTS:
        starts = [x[0] for x in taken]
        for m in pattern.finditer(piece):
            k = bisect_right(starts, at + m.start())
            free = (not k or taken[k - 1][1] <= at + m.start()) and (k == len(starts) or starts[k] >= at + m.end())
            part = _uniform(m[0], at + m.start()) if free and len(m[0]) < len(piece) else None
            if part:
                taken.append(part)
        taken.sort(key=lambda x: x[:2])
    return taken


def candidates(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, str, int, float, np.ndarray]]:
    """Runs or parts of runs that may be keys and pass every test of uniformity: start, end, encoding, symbols, chi-squared, counts by symbol.

    ``spans`` are the base spans in order.  No candidate overlaps one of them
    or another candidate; ``=`` is only the end of one.  Runs and spans are
    gone through side by side, so the time is linear in the text.
    """
    out, covered, k = [], _apart(spans), 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while k < len(covered) and covered[k][1] <= a:
            k += 1
        last = k
        while last < len(covered) and covered[last][0] < b:
            last += 1
        for s, e in _gaps(a, b, covered[k:last]):
            if e - s >= MIN_RANDOM:
                out += _in_piece(text[s:e], s)
    return out


def _text_model(counts: np.ndarray, encoding: str) -> np.ndarray:
    letters = dict(ALPHABETS)[encoding]
    q = np.array([counts[ord(c)] for c in letters], float)
    return (q + 1) / (q + 1).sum()


def text_moments(counts: np.ndarray, encoding: str, length: int) -> tuple[float, float]:
    """Mean and deviation of chi-squared against uniformity for text of this length, from 400 seeded draws."""
    q = _text_model(counts, encoding)
    draws = np.random.default_rng(length).multinomial(length, q, 400)
    chi2 = ((draws - length / len(q)) ** 2).sum(axis=1) * len(q) / length
    return float(chi2.mean()), float(chi2.std()) or 1.0


def length_class(length: int) -> int:
    return sum(length > x for x in LENGTH_CLASSES)


@lru_cache(maxsize=4096)
def _moments(counts: bytes, encoding: str, length: int) -> tuple[float, float]:
    return text_moments(np.frombuffer(counts, np.int64), encoding, length)


@lru_cache(maxsize=64)
def _evidence(counts: bytes, encoding: str) -> np.ndarray:
    """Of each symbol, the logarithm of how much likelier it is in a key than in text."""
    q = _text_model(np.frombuffer(counts, np.int64), encoding)
    return -np.log(q * len(q))


def combined(*p: float) -> float:
    """One p-value of several that may depend on each other (Cauchy combination)."""
    t = sum(1 / math.tan(math.pi * min(max(x, 1e-300), 1 - 1e-9)) for x in p) / len(p)
    return math.atan(1 / t) / math.pi if t > 1 else 0.5 - math.atan(t) / math.pi


def p_bin(counts: bytes, encoding: str, length: int, chi2: float, symbols: np.ndarray) -> int:
    """-log10 of a candidate's probability in text, rounded down to a bin.

    Combined of the lower tail of ``chi2`` and of the likelihood ratio x of a
    key to text, which in text is x or more with probability 1/x at most.
    Runs and serial correlation aren't part of it: in text they follow the
    shapes of words, so they tell keys from no particular law and only reject.
    """
    mean, spread = _moments(counts, encoding, length)
    p_chi2 = math.erfc(-(chi2 - mean) / spread / math.sqrt(2)) / 2
    p_ratio = math.exp(-max(0.0, float(_evidence(counts, encoding) @ symbols)))
    return min(P_BINS - 1, int(-100 * math.log10(max(combined(p_chi2, p_ratio), 1e-300))))


def _worth_a_look(texts: pa.Array) -> np.ndarray:
    """Whether a text can have any span; a linear-time scan, so that few texts are looked at one by one."""
    return np.logical_or.reduce([pc.match_substring_regex(texts, x).to_numpy(zero_copy_only=False) for x in HINTS])


def _looked_at(texts: pa.Array) -> Iterator[tuple[int, str, list, list]]:
    """Index, text, base spans and candidates of the texts that may have any."""
    for i in np.flatnonzero(_worth_a_look(texts)).tolist():
        text = texts[i].as_py()
        spans = base_spans(text)
        yield i, text, spans, candidates(text, spans)


def findings(docs: DataFrame, text: str = "text", id_column: str = "doc_id", every_row: bool = True) -> DataFrame:
    """What one scan of all texts finds, written as a table: doc_id, base and found for each row, and rows of ``counts``.

    ``counts``, one row for each slice of texts, says how often each ASCII character stands in it.
    Without ``every_row`` only texts with candidates have a row.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    found = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()), ("length", pa.int64()), ("chi2", pa.float64()), ("symbols", pa.list_(pa.int64()))]))
    counts = pa.list_(pa.int64())
    names = ["doc_id", "base", "found", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = filled(part.column(1))
                base: list[list[dict]] = [[] for _ in range(part.num_rows)]
                runs = list(base)
                for i, _, spans, own in _looked_at(texts):
                    base[i], runs[i] = _as_spans(spans), [dict(zip(("start", "end", "encoding", "length", "chi2", "symbols"), x, strict=True)) for x in own]
                whole = pa.RecordBatch.from_arrays([part.column(0), pa.array(base, span), pa.array(runs, found), pa.nulls(part.num_rows, counts)], names)
                yield whole if every_row else whole.filter(pc.greater(pc.list_value_length(whole.column(2)), 0))
                own_counts = np.bincount(bytes_of(texts)[0], minlength=256)[:128]
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, span), pa.nulls(1, found), pa.array([own_counts], counts)], names)

    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return cut(source.mapInArrow(run, f"doc_id long, base array<{_SPAN}>, found array<{_FOUND}>, counts array<long>"), "secret-findings")


def character_counts(made: DataFrame) -> np.ndarray:
    """How often each ASCII character stands in the texts; 128 sums come to the driver."""
    out = np.zeros(128, np.int64)
    for row in made.where("counts is not null").select(F.posexplode("counts").alias("c", "n")).groupBy("c").agg(F.sum("n").alias("n")).collect():
        out[row["c"]] = row["n"]
    return out


def thresholds(made: DataFrame, counts: bytes) -> dict[int, int]:
    """The smallest bin that Benjamini-Hochberg accepts in each class of lengths.

    ``made`` is a table of ``findings``.  All candidates of the corpus that pass the first tests take part; at most classes x bins counts come to the driver.
    """

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_pylist()
            rated = [(length_class(x["length"]), _bin(x, counts)) for x in found]
            if rated:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in zip(*rated, strict=True)], ["length_class", "bin"])

    by: dict[int, np.ndarray] = {}
    each = made.where(F.size("found") > 0).select(F.explode("found").alias("x"))
    for row in each.mapInArrow(rate, "length_class int, bin int").groupBy("length_class", "bin").count().collect():
        by.setdefault(row["length_class"], np.zeros(P_BINS, np.int64))[row["bin"]] = row["count"]
    out = {}
    for k, n in by.items():
        at_least = n[::-1].cumsum()[::-1]
        p = 10 ** (-np.arange(P_BINS) / 100)
        good = np.flatnonzero((at_least > 0) & (p * n.sum() <= FALSE_DISCOVERY * at_least))
        if len(good):
            out[k] = int(good[0])
    return out


def _bin(found: dict, counts: bytes) -> int:
    return p_bin(counts, found["encoding"], found["length"], found["chi2"], np.array(found["symbols"]))


def _accepted(found: list[dict], counts: bytes, limits: dict[int, int]) -> list[tuple[str, int, int]]:
    return [("random", x["start"], x["end"]) for x in found if _bin(x, counts) >= limits.get(length_class(x["length"]), P_BINS)]


def _as_spans(spans: list[tuple[str, int, int]]) -> list[dict]:
    return [dict(zip(("kind", "start", "end"), x, strict=True)) for x in spans]


def scan(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end by start, then kind) for every row; ``spans`` has the battery's too.

    A null or empty text has none, and no rows give none.  Rows are scanned one
    by one, so repeated rows get equal spans; a null doc_id is kept.  Other
    columns, whatever their names, aren't looked at.  Texts are read once; what
    is found in them goes through a table.
    """
    made = findings(docs, text, id_column)
    counts = character_counts(made).tobytes()
    limits = thresholds(made, counts)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(1).to_pylist()
            for i in np.flatnonzero(pc.list_value_length(batch.column(2)).to_numpy() > 0).tolist():
                own = [(x["kind"], x["start"], x["end"]) for x in spans[i]]
                spans[i] = _as_spans(in_order(own + _accepted(batch.column(2)[i].as_py(), counts, limits)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(spans, kind)], ["doc_id", "base", "spans"])

    return made.where("counts is null").select("doc_id", "base", "found").mapInArrow(run, f"doc_id long, base array<{_SPAN}>, spans array<{_SPAN}>")


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span that ``scan`` finds in ``text`` replaced by ``mask``, overlapping ones by one.

    Null texts stay null; rows and all other columns, whatever their names, are
    as they were.  Texts are read twice: once for the thresholds, and once to
    mask, since finding candidates again is cheaper than shuffling all texts to
    join them with what was found.
    """
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    at = docs.columns.index(text)
    made = findings(plain.select(F.lit(None).cast("long").alias("doc_id"), F.col(f"c{at}").alias("text")), every_row=False)
    counts = character_counts(made).tobytes()
    limits = thresholds(made, counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, at)):
            column = batch.column(at)
            values = column.to_pylist()
            for i, own, spans, found in _looked_at(filled(column)):
                keys = [dict(zip(("start", "end", "encoding", "length", "chi2", "symbols"), x, strict=True)) for x in found]
                parts, done = [], 0
                for _, a, b in in_order(spans + _accepted(keys, counts, limits)):
                    if a >= done:
                        parts += [own[done:a], mask]
                    done = max(done, b)
                if done:
                    values[i] = "".join([*parts, own[done:]])
            columns = [pa.array(values, pa.string()) if k == at else x for k, x in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, [f"c{k}" for k in range(len(columns))])

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def joined(spans: str) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")

