"""Quality rules as a short-circuit cascade.

Every rule looks at a slice of texts and says which it rejects.  Each task
first lets all rules see a sample, the first ``SAMPLE_ROWS`` of its texts that
the base verdict passes, and estimates their cost and selectivity from that; it
orders the rules by rejections per second, and from then on a rule sees only
the texts that the rules before it let pass.  So the sample costs no scan of
its own, and no task waits for another.  The verdict is the same in any order;
the order only saves work.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import bytes_of, codes, equal_windows, lines, slices, sums, window_hash, words

WINDOW = 8  # words in a window of n_repeat_words
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SAMPLE_ROWS = 64  # texts of each task on which the rules' cost and selectivity are measured
SYMBOLS = b"#*$%&|<>"

BASE_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def _is_space(data: np.ndarray) -> np.ndarray:
    return (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))


def _any_of(data: np.ndarray, members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table[data]


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def repeated_words(code: np.ndarray, counts: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Words of each text that lie in a window found twice or more in that text, the first included."""
    n = len(code)
    owner = np.repeat(np.arange(len(counts)), counts)
    h = window_hash(code, size)
    start = np.flatnonzero(owner[: len(h)] == owner[size - 1 :]) if len(h) else np.zeros(0, np.int64)
    order = start[np.lexsort((h[start], owner[start]))]
    a, b = order[:-1], order[1:]
    near = (h[a] == h[b]) & (owner[a] == owner[b])
    a, b = a[near], b[near]
    same = equal_windows(code, a, b, size)
    edge = np.zeros(n + 1, np.int64)
    hit = np.unique(np.r_[a[same], b[same]])
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + size, -1)
    return np.bincount(owner[np.cumsum(edge)[:n] > 0], minlength=len(counts))


class Texts:
    """A slice of texts with its bytes, words and lines, which are found once for all rules."""

    def __init__(self, texts: pa.Array) -> None:
        self.n = len(texts)
        self.data, self.offsets = bytes_of(texts)
        flat, self.n_words = words(texts)
        self.code = codes(flat)[0]
        self.line, self.line_owner = lines(texts)

    @property
    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.n), self.n_words)

    @property
    def n_lines(self) -> np.ndarray:
        return np.bincount(self.line_owner, minlength=self.n)

    def where(self, keep: np.ndarray) -> Texts:
        """The texts that are flagged."""
        if keep.all():
            return self
        out = object.__new__(Texts)
        out.n = int(keep.sum())
        size = np.diff(self.offsets)
        out.data, out.offsets = self.data[np.repeat(keep, size)], np.r_[0, np.cumsum(size[keep])]
        out.code, out.n_words = self.code[np.repeat(keep, self.n_words)], self.n_words[keep]
        lines_kept = keep[self.line_owner]
        out.line, out.line_owner = self.line.filter(pa.array(lines_kept)), (np.cumsum(keep) - 1)[self.line_owner[lines_kept]]
        return out


def base_counts(texts: pa.Array | Texts) -> dict[str, np.ndarray]:
    """The base counts and verdict of each text."""
    t = texts if isinstance(texts, Texts) else Texts(texts)
    real = pc.greater(pc.binary_length(pc.ascii_trim(t.line, " \t\n\x0b\x0c\r")), 0).to_numpy(zero_copy_only=False).astype(bool)
    line, owner = t.line.filter(pa.array(real)), t.line_owner[real]
    distinct = np.unique(owner * (len(line) + 1) + codes(line)[0]) // (len(line) + 1) if len(line) else owner
    n_repeat = repeated_words(t.code, t.n_words)
    return {
        "n_words": t.n_words,
        "word_chars": sums(((t.data & 0xC0) != 0x80) & ~_is_space(t.data), t.offsets),
        "n_symbols": sums(_any_of(t.data, SYMBOLS), t.offsets),
        "n_dup_lines": np.bincount(owner, minlength=t.n) - np.bincount(distinct, minlength=t.n),
        "n_repeat_words": n_repeat,
        "base_failed": (t.n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * t.n_words),
    }


@dataclass(frozen=True)
class Rule:
    """``of(texts, base)`` gives a flag for each text that it rejects; ``base`` has the base counts of the same texts."""

    name: str
    of: Callable[[Texts, dict[str, np.ndarray]], np.ndarray]

    def rejects(self, texts: pa.Array | Texts, base: dict[str, np.ndarray]) -> np.ndarray:
        return self.of(texts if isinstance(texts, Texts) else Texts(texts), base)


def _symbols(t: Texts, base: dict) -> np.ndarray:
    return _ratio(base["n_symbols"], base["n_words"]) > 0.1


def _word_length(t: Texts, base: dict) -> np.ndarray:
    mean = _ratio(base["word_chars"], base["n_words"])
    return (mean < 2.5) | (mean > 15)


def _duplicate_lines(t: Texts, base: dict) -> np.ndarray:
    return _ratio(base["n_dup_lines"], t.n_lines) > 0.5


def _words_without_letters(t: Texts, base: dict) -> np.ndarray:
    """Under 70 % of the words have a letter (any byte beyond ASCII counts as one)."""
    letter = (t.data >= 0x80) | ((t.data | 0x20) >= 0x61) & ((t.data | 0x20) <= 0x7A)
    space = _is_space(t.data)
    begins = ~space & np.r_[True, space[:-1]][: len(space)]
    filled_at = t.offsets[:-1][np.diff(t.offsets) > 0]
    begins[filled_at] = ~space[filled_at]
    with_letter = np.zeros(len(t.code), bool)
    with_letter[(np.cumsum(begins) - 1)[letter & ~space]] = True
    return _ratio(np.bincount(t.owner, with_letter, minlength=t.n), t.n_words) < 0.7


def _shouting(t: Texts, base: dict) -> np.ndarray:
    """Over half of the ASCII letters are capitals."""
    upper, lower = sums((t.data >= 0x41) & (t.data <= 0x5A), t.offsets), sums((t.data >= 0x61) & (t.data <= 0x7A), t.offsets)
    return upper > lower


def _exclamation(t: Texts, base: dict) -> np.ndarray:
    return _ratio(sums(t.data == 0x21, t.offsets), base["n_words"]) > 0.3


def _bullets_and_ellipses(t: Texts, base: dict) -> np.ndarray:
    """Over 90 % of the lines start with a bullet or over 30 % end in an ellipsis."""
    flags = [pc.match_substring_regex(t.line, p).to_numpy(zero_copy_only=False) for p in (r"^\s*[-*\x{2022}]\s", r"(\.\.\.|\x{2026})\s*$")]
    bullet, ellipsis = (np.bincount(t.line_owner, f, minlength=t.n) for f in flags)
    return (_ratio(bullet, t.n_lines) > 0.9) | (_ratio(ellipsis, t.n_lines) > 0.3)


def _stutter(t: Texts, base: dict) -> np.ndarray:
    """Over 30 % of the words equal the word before them."""
    owner = t.owner
    same = np.r_[False, (t.code[1:] == t.code[:-1]) & (owner[1:] == owner[:-1])][: len(owner)]
    return _ratio(np.bincount(owner[same], minlength=t.n), t.n_words) > 0.3


RULES = (
    Rule("symbols", _symbols),
    Rule("word_length", _word_length),
    Rule("duplicate_lines", _duplicate_lines),
    Rule("words_without_letters", _words_without_letters),
    Rule("shouting", _shouting),
    Rule("exclamation", _exclamation),
    Rule("stutter", _stutter),
    Rule("bullets_and_ellipses", _bullets_and_ellipses),
)


class Cascade:
    """A task's cascade: it measures the rules on the texts it sees first, and then keeps to the order found.

    ``rejected`` and ``seconds`` are by rule, over ``sampled`` texts.
    """

    def __init__(self, rules: tuple[Rule, ...], sample_rows: int) -> None:
        self.rules, self.sample_rows = rules, sample_rows
        self.sampled, self.rejected, self.seconds = 0, dict.fromkeys(rules, 0), dict.fromkeys(rules, 0.0)
        self.order = rules

    def _measured(self, t: Texts, base: dict[str, np.ndarray]) -> np.ndarray:
        good = np.ones(t.n, bool)
        for rule in self.rules:
            began = time.perf_counter()
            rejected = rule.rejects(t, base)
            self.seconds[rule] += time.perf_counter() - began
            self.rejected[rule] += int(rejected.sum())
            good &= ~rejected
        self.sampled += t.n
        self.order = tuple(sorted(self.rules, key=lambda r: -self.rejected[r] / max(self.seconds[r], 1e-9)))
        return good

    def _short_circuit(self, t: Texts, base: dict[str, np.ndarray]) -> np.ndarray:
        """The places of the texts that pass."""
        alive = np.arange(t.n)
        for rule in self.order:
            if not len(alive):
                break
            keep = ~rule.rejects(t, base)
            t, base, alive = t.where(keep), {k: v[keep] for k, v in base.items()}, alive[keep]
        return alive

    def passes(self, texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """The base counts of all texts, and which pass the base verdict and all rules."""
        t = Texts(texts)
        base = base_counts(t)
        good = ~base["base_failed"]
        alive = np.flatnonzero(good)
        left, own = t.where(good), {k: v[good] for k, v in base.items()}
        n = min(max(self.sample_rows - self.sampled, 0), left.n)
        first = np.arange(left.n) < n
        if n:
            good[alive[first]] = self._measured(left.where(first), {k: v[first] for k, v in own.items()})
        if n < left.n:
            rest = alive[~first]
            good[rest] = False
            good[rest[self._short_circuit(left.where(~first), {k: v[~first] for k, v in own.items()})]] = True
        return base, good


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """For each rule its seconds, the texts it rejects and the texts it saw: all of ``docs`` that the base verdict passes.

    A report, for instance on a sample of the caller's; the cascade has its own.
    """

    def trial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = Cascade(rules, np.iinfo(np.int64).max)
        for batch in batches:
            for part in slices(batch):
                cascade.passes(part.column(0))
        for rule in rules:
            yield pa.RecordBatch.from_pydict({"rule": [rule.name], "rejected": [cascade.rejected[rule]], "seconds": [cascade.seconds[rule]], "texts": [cascade.sampled]})

    seen = docs.select(F.col(text).alias("text")).mapInArrow(trial, "rule string, rejected long, seconds double, texts long")
    return seen.groupBy("rule").agg(F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds"), F.sum("texts").alias("texts"))


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> tuple[Rule, ...]:
    """The rules by rejections per second on all of ``docs``, best first.  One row for each rule comes to the driver."""
    score = {r["rule"]: r["rejected"] / max(r["seconds"], 1e-9) for r in measure(docs, rules, text).collect()}
    return tuple(sorted(rules, key=lambda r: -score.get(r.name, 0.0)))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", keep_columns: tuple[str, ...] = (), sample_rows: int = 0) -> DataFrame:
    """``keep_columns`` of every row, then the base counts and ``kept``.

    Rules run in the order given, or with ``sample_rows`` in the order that
    each task finds best on as many texts.  A null text has no words and fails.
    A rule sees only texts that the base verdict and the rules before it
    passed.  Rows are judged one by one, so repeated rows and ties get equal
    verdicts.
    """
    prefixed = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep_columns)]
    source = docs.select(*prefixed, F.col(text).alias("text"))
    names = [x.split()[0] for x in BASE_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = Cascade(rules, sample_rows)
        for batch in batches:
            for part in slices(batch):
                base, kept = cascade.passes(part.column(len(keep_columns)))
                made = [pa.array(base[x].astype(bool if x == "base_failed" else np.int64)) for x in names]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made, pa.array(kept)], [f"k{i}" for i in range(len(keep_columns))] + names + ["kept"])

    fields = ", ".join(f"k{i} {source.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep_columns)))
    out = source.mapInArrow(run, (fields + ", " if fields else "") + BASE_SCHEMA + ", kept boolean")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep_columns)], *names, "kept")


def quality_verdicts(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the base counts, base_failed and kept for every row of ``docs``; no rows give none.

    A null or empty text has no words and fails.  Repeated rows and null ids are
    judged as the rows they are, texts of any length whole, and other columns, whatever their names, aren't looked at.
    """
    return judge(docs, rules, keep_columns=("doc_id",), sample_rows=sample_rows)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that pass, all columns as they were, whatever the other columns are called."""
    plain = docs.select(F.col("`text`").alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    names = tuple(plain.columns[1:])
    verdicts = judge(plain, rules, keep_columns=names, sample_rows=sample_rows)
    return verdicts.where("kept").select(*names).toDF(*docs.columns)
