"""The state machines over streams in the order in which events arrive, checkpointed by Structured Streaming; ``streaming.ordered`` has them in event time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.config import DEFAULT, Resilience
from corpusloom.functions import policy
from corpusloom.operators.state import Breaker, Request
from corpusloom.store import Store


def idempotent(events: DataFrame) -> DataFrame:
    """Events (task_id, seq, kind: request, success or failure) to task_id, seq and action."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        request = Request(*(state.get if state.exists else ()))
        rows = pd.concat(batches).sort_values("seq")
        actions = [request.event(k) for k in rows["kind"]]
        state.update((request.status,))
        yield pd.DataFrame({"task_id": key[0], "seq": rows["seq"], "action": actions})

    return events.groupBy("task_id").applyInPandasWithState(step, "task_id string, seq long, action string", "status string", "append", GroupStateTimeout.NoTimeout)


def breaker(events: DataFrame, settings: Resilience = DEFAULT.resilience) -> DataFrame:
    """Events (model, at: seconds, failed) to model, at, allowed and state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = Breaker(*(state.get if state.exists else ()))
        rows = pd.concat(batches).sort_values("at")
        out = [machine.call(a, f, settings) for a, f in zip(rows["at"], rows["failed"], strict=True)]
        state.update((machine.failures, machine.opened, machine.mode))
        yield pd.DataFrame({"model": key[0], "at": rows["at"], "allowed": [x[0] for x in out], "state": [x[1] for x in out]})

    return events.groupBy("model").applyInPandasWithState(step, "model string, at double, allowed boolean, state string", "failures int, opened double, mode string", "append", GroupStateTimeout.NoTimeout)


def session_slots(turns: DataFrame) -> DataFrame:
    """Turns (session_id, seq, slots) to session_id, seq and the slots merged so far; a session is kept for good."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        merged = dict(state.get[0]) if state.exists else {}
        seqs, slots = [], []
        for row in pd.concat(batches).sort_values("seq").itertuples():
            merged |= {k: v for k, v in dict(row.slots).items() if v}
            seqs.append(row.seq)
            slots.append(dict(merged))
        state.update((merged,))
        yield pd.DataFrame({"session_id": key[0], "seq": seqs, "slots": slots})

    cleaned = turns.where(F.col("session_id").isNotNull()).withColumn("slots", policy.clean_slots(F.col("slots")))
    return cleaned.groupBy("session_id").applyInPandasWithState(step, "session_id string, seq long, slots map<string,string>", "slots map<string,string>", "append", GroupStateTimeout.NoTimeout)


def first_requests(requests: DataFrame, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each task's first request, while a repeat within the watermark is dropped."""
    return requests.withWatermark(time, late).dropDuplicatesWithinWatermark(["task_id"])


def answer_batches(requests: DataFrame, answer: Callable[[DataFrame], DataFrame], store: Store, table: str, keys: tuple[str, ...], checkpoint: str, stream: str | None = None):
    """Start a query that answers each micro-batch and puts the answers over those of equal keys.

    A batch is committed under its number in the name of ``stream``, the table's if none is given: one that comes
    again, as after a failure between the commit and the checkpoint, changes nothing.
    """

    def save(batch: DataFrame, number: int) -> None:
        store.upsert(table, answer(batch), keys, batch=(stream or table, number))

    return requests.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
