"""Keyed state machines over ordered events, as batch jobs.

The same steps run over streams in ``corpusloom.streaming``.  Folds are split
within a key (``operators.folds``), so a key may have any share of the events.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.config import DEFAULT, Resilience
from corpusloom.functions import policy
from corpusloom.operators import folds


@dataclass
class Breaker:
    """Opens after a number of failures in a row, lets one call try again after a while, and closes at a success."""

    failures: int = 0
    opened: float = -1.0
    mode: str = "CLOSED"

    def may_call(self, at: float, settings: Resilience = DEFAULT.resilience) -> bool:
        return self.mode != "OPEN" or at - self.opened >= settings.breaker_seconds

    def call(self, at: float, failed: bool, settings: Resilience = DEFAULT.resilience) -> tuple[bool, str]:
        """Whether the call at second ``at`` is let through, and the state after it."""
        if self.mode == "OPEN":
            if not self.may_call(at, settings):
                return False, self.mode
            self.mode = "HALF_OPEN"
        if failed:
            self.failures += 1
            if self.failures >= settings.breaker_failures:
                self.mode, self.opened = "OPEN", at
        else:
            self.failures, self.mode = 0, "CLOSED"
        return True, self.mode


@dataclass
class Request:
    """A task's request: run at first and after a failure, a duplicate while it runs, answered from the cache after a success."""

    status: str = "ABSENT"

    def event(self, kind: str) -> str:
        if kind == "request":
            if self.status in ("ABSENT", "FAILED"):
                self.status = "PENDING"
                return "run"
            return "duplicate" if self.status == "PENDING" else "cached"
        self.status = "SUCCESS" if kind == "success" else "FAILED"
        return "done"


def breaker(events: DataFrame, key: str, order: tuple[str, ...], at: Column, failed: Column, settings: Resilience = DEFAULT.resilience) -> DataFrame:
    """``events`` with allowed and state for each call of a key, in the order of ``at`` and then ``order``.

    A call without a time stands before all others; one that isn't known to have failed hasn't.
    """
    inputs = {"_at": F.coalesce(at.cast("double"), F.lit(float("-inf"))), "_failed": F.coalesce(failed.cast("boolean"), F.lit(False))}
    return folds.fold(events, key, ("_at", *order), inputs, folds.Breakers(settings.breaker_failures, settings.breaker_seconds))


def failure_streaks(events: DataFrame, key: str, order: tuple[str, ...], failed: Column) -> DataFrame:
    """``events`` with streak: failures in a row up to this one, 0 at a success."""
    return folds.fold(events, key, order, {"_failed": F.coalesce(failed, F.lit(False))}, folds.Streaks())


def replay(requests: DataFrame, task: Column, order: tuple[str, ...], succeeded: Column) -> DataFrame:
    """``requests`` with task_id and action when they come one after the other: run until one succeeds, then cached."""
    keyed = folds.fold(requests.withColumn("task_id", task), "task_id", order, {"_done": F.coalesce(succeeded, F.lit(False))}, folds.Seen())
    return keyed.withColumn("action", F.when(F.col("seen"), "cached").otherwise("run")).drop("seen")


def merge_slots(turns: DataFrame, session: str, order: str, slots: str) -> DataFrame:
    """session, slot, value: of each slot the last value that isn't empty, over all turns of the session."""
    pairs = turns.where(F.col(session).isNotNull()).select(session, order, F.explode(policy.clean_slots(F.col(slots))).alias("slot", "value"))
    return pairs.groupBy(session, "slot").agg(F.max_by("value", order).alias("value"))


def missing(sessions: DataFrame, intent: Column, slots: Column) -> DataFrame:
    """``sessions`` with the missing slots and the question for the first of them."""
    out = sessions.withColumn("missing", policy.missing_slots(intent, policy.with_aliases(slots)))
    return out.withColumn("question", F.when(F.size("missing") > 0, policy.slot_question(intent, F.get("missing", F.lit(0)))))
