"""The state machines over streams in event time.

Events are held in a list until the watermark has passed them, then folded in
order; so however a stream is cut into batches, and whatever comes late within
``late``, the answer is that of the batch job.  Timers wake a key for what it
holds, for a breaker that may be tried again, and for the end of a state that
has been idle.  ``streaming.state`` has the same machines in the order in which events arrive.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from corpusloom.config import DEFAULT, Resilience
from corpusloom.functions import policy
from corpusloom.operators.state import Breaker, Request

#: States that transformWithState needs; ``session.build_session`` sets it.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Fold:
    """What a machine does with a key's events; states live in the store of the stream."""

    output: str

    def open(self, handle: StatefulProcessorHandle) -> None: ...

    def step(self, key: Any, event: Row) -> list[tuple]: ...

    def until(self, key: Any, at: float) -> list[tuple]:
        """What happens by second ``at`` without an event."""
        return []

    def wake(self) -> float | None:
        """The second at which something happens without an event."""
        return None

    def clear(self) -> None: ...


class _Requests(Fold):
    output = "task_id string, seq long, action string"

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("request", "status string")

    def step(self, key: Any, event: Row) -> list[tuple]:
        request = Request(*(self.state.get() if self.state.exists() else ()))
        action = request.event(event.kind)
        self.state.update((request.status,))
        return [(key[0], event.seq, action)]

    def clear(self) -> None:
        self.state.clear()


class _Calls(Fold):
    output = "model string, at double, allowed boolean, state string"

    def __init__(self, settings: Resilience) -> None:
        self.settings = settings

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("breaker", "failures int, opened double, mode string, told double")

    def _load(self) -> tuple[Breaker, float]:
        failures, opened, mode, told = self.state.get() if self.state.exists() else (0, -1.0, "CLOSED", -1.0)
        return Breaker(failures, opened, mode), told

    def step(self, key: Any, event: Row) -> list[tuple]:
        out = self.until(key, event.at)
        machine, told = self._load()
        allowed, mode = machine.call(event.at, event.failed, self.settings)
        self.state.update((machine.failures, float(machine.opened), machine.mode, told))
        return [*out, (key[0], event.at, allowed, mode)]

    def until(self, key: Any, at: float) -> list[tuple]:
        machine, told = self._load()
        if machine.mode != "OPEN" or told == machine.opened or at - machine.opened < self.settings.breaker_seconds:
            return []
        self.state.update((machine.failures, float(machine.opened), machine.mode, float(machine.opened)))
        return [(key[0], machine.opened + self.settings.breaker_seconds, None, "HALF_OPEN")]

    def wake(self) -> float | None:
        machine, told = self._load()
        return machine.opened + self.settings.breaker_seconds if machine.mode == "OPEN" and told != machine.opened else None

    def clear(self) -> None:
        self.state.clear()


class _Slots(Fold):
    """Slots go in and out as JSON, since maps don't pass through a list state."""

    output = "session_id string, seq long, slots string"

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("slots", "slot string", "value string")

    def step(self, key: Any, event: Row) -> list[tuple]:
        for slot, value in json.loads(event.slots or "{}").items():
            if value:
                self.state.updateValue((slot,), (value,))
        return [(key[0], event.seq, json.dumps({k[0]: v[0] for k, v in self.state.iterator()} if self.state.exists() else {}))]

    def clear(self) -> None:
        self.state.clear()


class _Processor(StatefulProcessor):
    """Feeds a fold with events of the schema ``held`` once the watermark is past their ``_ms``, in order of that and then ``order``."""

    def __init__(self, fold: Fold, order: str, held: str, idle: float | None) -> None:
        self.fold, self.order, self.held, self.idle = fold, order, held, idle
        self.names = StructType.fromDDL(held).names
        self.outputs = StructType.fromDDL(fold.output).names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("held", self.held)
        self.last = handle.getValueState("last", "ms long")
        self.fold.open(handle)
        self.made = Row(*self.outputs)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        events = [tuple(r[n] for n in self.names) for r in rows]
        self.buffer.appendList(events)
        self.handle.registerTimer(min(e[self.names.index("_ms")] for e in events))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now, row = timerValues.getCurrentWatermarkInMs(), Row(*self.names)
        held = [row(*x) for x in self.buffer.get()] if self.buffer.exists() else []
        due = sorted((e for e in held if e["_ms"] <= now), key=lambda e: (e["_ms"], e[self.order]))
        left = [tuple(e) for e in held if e["_ms"] > now]
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for e in due:
            if self.idle is not None and last is not None and e["_ms"] - last > self.idle * 1000:
                out += self.fold.until(key, last / 1000 + self.idle)
                self.fold.clear()
            out += self.fold.step(key, e)
            last = e["_ms"]
        if left:
            self.buffer.put(left)
            self.handle.registerTimer(min(e[self.names.index("_ms")] for e in left))
        else:
            self.buffer.clear()
        if self.idle is not None and last is not None and now - last > self.idle * 1000:
            out += self.fold.until(key, last / 1000 + self.idle)
            self.fold.clear()
            self.last.clear()
        elif last is not None:
            self.last.update((last,))
            out += self.fold.until(key, now / 1000)
            at = [self.fold.wake(), None if self.idle is None else last / 1000 + self.idle + 0.001]
            for t in at:
                if t is not None and t * 1000 > now:
                    self.handle.registerTimer(int(t * 1000))
        return iter([self.made(*x) for x in out])

    def close(self) -> None: ...


def _folded(events: DataFrame, key: str, order: str, fold: Fold, time: str, late: str, idle: float | None) -> DataFrame:
    timed = events.withColumn("_ms", F.unix_millis(F.col(time))).withWatermark(time, late)
    held = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in timed.schema if f.name not in (key, time))
    return timed.groupBy(key).transformWithState(_Processor(fold, order, held, idle), fold.output, "Append", "EventTime")


def idempotent(events: DataFrame, time: str = "ts", late: str = "10 minutes", idle: float | None = None) -> DataFrame:
    """Events (task_id, seq, kind: request, success or failure; ``time``) to task_id, seq and action; a task is forgotten after ``idle`` seconds without an event."""
    return _folded(events, "task_id", "seq", _Requests(), time, late, idle)


def breaker(events: DataFrame, settings: Resilience = DEFAULT.resilience, time: str = "ts", late: str = "10 minutes", idle: float | None = None) -> DataFrame:
    """Events (model, at: seconds, failed; ``time``) to model, at, allowed and state.

    A row without ``allowed`` and with state HALF_OPEN says when an open breaker may be tried again.
    """
    return _folded(events, "model", "at", _Calls(settings), time, late, idle)


def session_slots(turns: DataFrame, time: str = "ts", late: str = "10 minutes", idle: float | None = None) -> DataFrame:
    """Turns (session_id, seq, slots; ``time``) to session_id, seq and the slots merged so far; a session ends after ``idle`` seconds, if given."""
    cleaned = turns.where(F.col("session_id").isNotNull()).withColumn("slots", F.to_json(policy.clean_slots(F.col("slots"))))
    folded = _folded(cleaned, "session_id", "seq", _Slots(), time, late, idle)
    return folded.withColumn("slots", F.from_json("slots", "map<string,string>"))
