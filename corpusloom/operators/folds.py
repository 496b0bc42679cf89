"""Folds over the ordered events of each key, split within a key.

Events are range-partitioned by key and order, so a key with very many events
lies in several partitions.  A first pass sums up what each partition does to
the state that its first key comes with; the summaries of a key, one for each
of its partitions, are chained; a second pass then folds every partition from
the right state.  A task has an even share of the events, whatever their keys.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.session import shared_dir

State = Any  # what JSON can hold


class Machine(Protocol):
    """A fold; ``columns`` are numpy arrays of the inputs in order."""

    initial: State
    outputs: str  # DDL of what is added to each event

    def run(self, columns: list[np.ndarray], starts: np.ndarray, entry: State) -> tuple[list[pa.Array], State]:
        """The outputs of events whose keys begin at ``starts`` (the first at 0, with state ``entry``), and the state after the last."""

    def summary(self, columns: list[np.ndarray]) -> State:
        """What the events of one key make of any state before them."""

    def after(self, summary: State, entry: State) -> State:
        """The state after events of that summary."""


def fold(events: DataFrame, key: str, order: tuple[str, ...], inputs: dict[str, Column], machine: Machine) -> DataFrame:
    """``events`` with the machine's outputs, folded for each key in order from its initial state.

    A null key is a key like any other.  ``order`` should tell all events of a key apart.
    """
    shared_dir(events.sparkSession)
    names, given = list(events.columns), list(inputs)
    source = events.withColumns(inputs)
    dealt = source.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    kind = events.schema[key].dataType.simpleString()
    summed = dealt.select(key, "_part", *given).mapInArrow(_summaries(machine, given), f"`{key}` {kind}, part int, first boolean, summary string")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        entry, out = machine.initial, []
        for part, first, summary in pdf.sort_values("part")[["part", "first", "summary"]].itertuples(index=False):
            if first:
                out.append((part, json.dumps(entry)))
            entry = machine.after(json.loads(summary), entry)
        return pd.DataFrame(out, columns=["part", "entry"])

    # one row for each partition
    entries = {r["part"]: json.loads(r["entry"]) for r in summed.groupBy(key).applyInPandas(chain, "part int, entry string").collect()}
    wanted = [*names, "_part", *given]
    added = [x.strip().split(" ")[0] for x in machine.outputs.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(names.index(key))
            if last is None:
                state = entries[batch.column(len(names))[0].as_py()]
            elif not keys.slice(0, 1).equals(last):
                state = machine.initial
            made, state = machine.run(_arrays(batch, len(names) + 1), _starts(keys), state)
            last = keys.slice(len(keys) - 1, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *made], [*names, *added])

    schema = StructType([*events.schema.fields])
    for x in machine.outputs.split(","):
        schema = schema.add(*x.strip().split(" "))
    return dealt.select(*wanted).mapInArrow(run, schema)


def _arrays(batch: pa.RecordBatch, start: int) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns[start:]]


def _starts(keys: pa.Array) -> np.ndarray:
    codes = pc.dictionary_encode(keys, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])


def _summaries(machine: Machine, given: list[str]):
    """A row for the first key of a partition and one for the last, if that is another; keys between them begin and end here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, part, first = [], None, None, True

        def said() -> pa.RecordBatch:
            columns = [np.concatenate([h[k] for h in held]) for k in range(len(given))]
            return pa.RecordBatch.from_arrays([key, pa.array([part], pa.int32()), pa.array([first]), pa.array([json.dumps(machine.summary(columns))])], [name, "part", "first", "summary"])

        for batch in batches:
            if not batch.num_rows:
                continue
            name, keys, columns = batch.schema.names[0], batch.column(0), _arrays(batch, 2)
            starts = _starts(keys)
            for a, b in zip(starts, np.r_[starts[1:], len(keys)], strict=True):
                own = keys.slice(a, 1)
                if key is not None and not own.equals(key):
                    if first:
                        yield said()
                    held, first = [], False
                key, part = own, batch.column(1)[0].as_py()
                if first or b == len(keys):  # a key that begins and ends within a batch is neither the first nor the last
                    held.append([c[a:b] for c in columns])
        if key is not None:
            yield said()

    return run


class Streaks:
    """Failures in a row up to each event, 0 at a success.  Input: failed."""

    initial: State = 0
    outputs = "streak long"

    def run(self, columns: list[np.ndarray], starts: np.ndarray, entry: State) -> tuple[list[pa.Array], State]:
        bad, place = columns[0].astype(bool), np.arange(len(columns[0]))
        reset = np.where(bad, -1, place)
        reset[starts] = np.maximum(reset[starts], starts - 1)
        reset = np.maximum.accumulate(reset)
        streak = place - reset
        streak[reset == -1] += entry
        return [pa.array(streak, pa.int64())], int(streak[-1])

    def summary(self, columns: list[np.ndarray]) -> State:
        good = np.flatnonzero(~columns[0].astype(bool))
        return [bool(len(good)), int(len(columns[0]) - 1 - good[-1]) if len(good) else len(columns[0])]

    def after(self, summary: State, entry: State) -> State:
        return summary[1] if summary[0] else entry + summary[1]


class Seen:
    """Whether an event of the key before each one was so.  Input: so."""

    initial: State = False
    outputs = "seen boolean"

    def run(self, columns: list[np.ndarray], starts: np.ndarray, entry: State) -> tuple[list[pa.Array], State]:
        so, place = columns[0].astype(bool), np.arange(len(columns[0]))
        latest = np.maximum.accumulate(np.where(so, place, -1))
        begin = np.repeat(starts, np.diff(np.r_[starts, len(so)]))
        seen = np.r_[-1, latest[:-1]] >= begin
        seen |= (begin == 0) & entry
        return [pa.array(seen)], bool(seen[-1] | so[-1])

    def summary(self, columns: list[np.ndarray]) -> State:
        return bool(columns[0].astype(bool).any())

    def after(self, summary: State, entry: State) -> State:
        return summary or entry


class Breakers:
    """A circuit breaker.  Inputs: at, in order, and failed.

    Its state at rest is a count of failures in a row while it is closed, or
    the time at which it opened; which call it lets through then depends on
    that time only.  So events are told by three kinds of jumps: to the next
    call that opens it, to the first call after the pause, and on from there.
    """

    outputs = "allowed boolean, state string"

    def __init__(self, failures: int, seconds: float) -> None:
        self.failures, self.seconds, self.initial = failures, seconds, [0, None]

    def _streaks(self, bad: np.ndarray) -> np.ndarray:
        place = np.arange(len(bad))
        return place - np.maximum.accumulate(np.where(bad, -1, place))

    def _probe(self, at: np.ndarray, opened: float, start: int) -> int:
        """The first call from ``start`` on that a breaker lets through which opened at that time."""
        j = max(start, int(np.searchsorted(at, opened + self.seconds)))
        while j > start and at[j - 1] - opened >= self.seconds:
            j -= 1
        while j < len(at) and at[j] - opened < self.seconds:
            j += 1
        return j

    def run(self, columns: list[np.ndarray], starts: np.ndarray, entry: State) -> tuple[list[pa.Array], State]:
        at, bad = columns[0].astype(float), columns[1].astype(bool)
        allowed, opened = np.ones(len(at), bool), np.zeros(len(at), bool)
        for a, b in zip(starts.tolist(), np.r_[starts[1:], len(at)].tolist(), strict=True):
            entry = self._one(at[a:b], bad[a:b], entry if a == 0 else self.initial, allowed[a:b], opened[a:b])
        return [pa.array(allowed), pa.array(np.where(opened, "OPEN", "CLOSED").astype(object), pa.string())], entry

    def _one(self, at: np.ndarray, bad: np.ndarray, entry: State, allowed: np.ndarray, opened: np.ndarray) -> State:
        streak, n, (failures, since), i = self._streaks(bad), len(at), entry, 0
        opens = np.flatnonzero(streak == self.failures)
        if since is None:
            i = self._first_open(streak, opens, failures)
            if i == n:
                return [self._closed(streak, failures), None]
            opened[i], since, i = True, at[i], i + 1
        while True:
            j = self._probe(at, since, i)
            allowed[i:j], opened[i:j] = False, True
            if j == n:
                return [0, float(since)]
            if bad[j]:
                opened[j], since, i = True, at[j], j + 1
                continue
            k = int(np.searchsorted(opens, j))
            if k == len(opens):
                return [int(streak[-1]), None]
            i = int(opens[k])
            opened[i], since, i = True, at[i], i + 1

    def _first_open(self, streak: np.ndarray, opens: np.ndarray, failures: int) -> int:
        """The call that opens a closed breaker with so many failures in a row; none if the number of calls."""
        run = int(np.flatnonzero(streak == 0)[0]) if (streak == 0).any() else len(streak)
        if failures + run >= self.failures:
            return self.failures - failures - 1
        later = opens[opens >= run]
        return int(later[0]) if len(later) else len(streak)

    def _closed(self, streak: np.ndarray, failures: int) -> int:
        return int(streak[-1]) if (streak == 0).any() else failures + len(streak)

    def summary(self, columns: list[np.ndarray]) -> State:
        """closed: the state after each count of failures; times and states: after an opening at one of the times or earlier.

        Only openings before the first call can come, so the pause of at most
        its length decides; neighbouring times with an equal outcome are one.
        """
        at, bad = columns[0].astype(float), columns[1].astype(bool)
        n, streak = len(at), self._streaks(bad)
        opens = np.flatnonzero(streak == self.failures)
        probe = np.array([self._probe(at, x, i + 1) for i, x in enumerate(at)] if n < 64 else self._probes(at), np.int64)
        # after a probe at i: the call that opens it next, itself if it fails, and the probe after that
        place = np.searchsorted(opens, np.arange(n))
        reopened = np.where(bad, np.arange(n), np.r_[opens, n][place])
        follows = np.where(reopened < n, probe[np.minimum(reopened, n - 1)], n)
        while True:  # each probe points at the last one of its way
            ahead = np.where(follows < n, follows[np.minimum(follows, n - 1)], n)
            if (ahead == n).all():
                break
            follows = np.where(ahead < n, ahead, follows)
        last = np.where(follows < n, follows, np.arange(n))
        end = lambda i: [0, float(at[reopened[last[i]]])] if reopened[last[i]] < n else [int(streak[-1]), None]

        def from_closed(failures: int) -> State:
            i = self._first_open(streak, opens, failures)
            if i == n:
                return [self._closed(streak, failures), None]
            return end(probe[i]) if probe[i] < n else [0, float(at[i])]

        times, states = [], []
        for i in range(min(n, self._probe(at, at[0], 0) + 1)):
            state = end(i)
            if states and states[-1] == state:
                times[-1] = float(at[i])
            else:
                times.append(float(at[i]))
                states.append(state)
        return {"closed": [from_closed(f) for f in range(self.failures)], "times": times, "states": states}

    def _probes(self, at: np.ndarray) -> np.ndarray:
        found = np.maximum(np.searchsorted(at, at + self.seconds), np.arange(1, len(at) + 1))
        exact = np.flatnonzero((np.r_[at, np.inf][found] - at < self.seconds) | ((found > np.arange(1, len(at) + 1)) & (at[np.maximum(found - 1, 0)] - at >= self.seconds)))
        for i in exact.tolist():  # where rounding decides
            found[i] = self._probe(at, at[i], i + 1)
        return found

    def after(self, summary: State, entry: State) -> State:
        failures, since = entry
        if since is None:
            return summary["closed"][failures]
        i = int(np.searchsorted([t - since for t in summary["times"]], self.seconds))
        return summary["states"][i] if i < len(summary["states"]) else entry
