"""The retry queue as a stateful stream: operations of a key in order, back-off, quarantine, retry, dismissal."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from .feeds import MAX_ATTEMPTS

OUTPUT = "ledger_id string, operation_id string, seq long, action string, payload string, attempts int, state string, reason string, at long"
_ENTRY = "seq long, action string, payload string, attempts int, reason string"


class RetryQueue(StatefulProcessor):
    """State of one key: operations that wait, those in quarantine, ids that have come, and until when it backs off.

    ``attempt(key, operation, attempts)`` does the work and returns None, or why it failed. A conflict goes into
    quarantine at once, another failure after ``most`` attempts; it ends the run, and what follows waits
    for the next one, which a timer starts after the back-off. Deleting what is missing is done. An id counts once
    for ``remember`` milliseconds (null: for ever). A key's waiting operations are read together.
    """

    def __init__(self, attempt: Callable[[str, dict, int], str | None], most: int = MAX_ATTEMPTS, backoff: Callable[[int], int] = lambda n: 1000 * 2**n, remember: int | None = None):
        self.attempt, self.most, self.backoff, self.remember = attempt, most, backoff, remember

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "operation_id string", _ENTRY)
        self.dead = handle.getMapState("dead", "operation_id string", _ENTRY)
        self.seen = handle.getMapState("seen", "operation_id string", "seq long", *([self.remember] if self.remember else []))
        self.until = handle.getValueState("until", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentProcessingTimeInMs(), []
        every = pd.concat(list(rows), ignore_index=True).sort_values(["seq", "operation_id"], kind="stable")
        for r in every.itertuples(index=False):
            if r.kind == "operation":
                if not self.seen.containsKey((r.operation_id,)):
                    self.seen.updateValue((r.operation_id,), (int(r.seq),))
                    self.waiting.updateValue((r.operation_id,), (int(r.seq), r.action, r.payload, 0, None))
            elif self.dead.containsKey((r.operation_id,)):
                seq, action, payload, attempts, reason = self.dead.getValue((r.operation_id,))
                self.dead.removeKey((r.operation_id,))
                if r.kind == "retry":
                    self.waiting.updateValue((r.operation_id,), (seq, action, payload, 0, None))
                    out.append((key[0], r.operation_id, seq, action, payload, 0, "requeued", None, now))
                else:
                    out.append((key[0], r.operation_id, seq, action, payload, attempts, "dismissed", reason, now))
        if not self.until.exists() or self.until.get()[0] <= now:
            out += self._run(key[0], now)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        yield self._frame(self._run(key[0], now) if self.until.exists() and self.until.get()[0] <= now else [])

    def _run(self, key: str, now: int) -> list[tuple]:
        out = []
        self.until.clear()
        for (name,), (seq, action, payload, attempts, _) in sorted(self.waiting.iterator(), key=lambda x: (x[1][0], x[0][0])):
            reason = self.attempt(key, {"operation_id": name, "seq": seq, "action": action, "payload": payload}, attempts)
            row = lambda state, n, reason=reason, name=name, seq=seq, action=action, payload=payload: (key, name, seq, action, payload, n, state, reason, now)
            if reason is None or (action == "delete" and reason == "missing"):
                self.waiting.removeKey((name,))
                out.append(row("applied", attempts))
                continue
            dead = reason == "conflict" or attempts + 1 >= self.most
            if dead:
                self.waiting.removeKey((name,))
                self.dead.updateValue((name,), (seq, action, payload, attempts + 1, reason))
            else:
                self.waiting.updateValue((name,), (seq, action, payload, attempts + 1, reason))
            out.append(row("quarantined" if dead else "retry", attempts + 1))
            if reason != "conflict":
                wait = now + (0 if dead else self.backoff(attempts + 1))
                self.until.update((wait,))
                self.handle.registerTimer(max(wait, now + 1))
                break
        return out

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def retry_queue(rows: DataFrame, processor: RetryQueue, key: str = "ledger_id") -> DataFrame:
    """Stream of what happened to operations: applied, retry, quarantined, requeued, dismissed, with attempts and reason.

    ``rows``: key, operation_id, seq, kind (operation, or retry or dismiss of one in quarantine), action, payload.
    Needs the RocksDB state store. Order holds per key; keys are independent of one another.
    """
    return rows.groupBy(key).transformWithStateInPandas(processor, OUTPUT, "Update", "ProcessingTime")


def dead_letters(events: DataFrame) -> DataFrame:
    """Operations that are in quarantine now, by the events of :func:`retry_queue`."""
    from pyspark.sql import functions as F

    last = events.filter("state in ('quarantined', 'requeued', 'dismissed', 'applied')").groupBy("ledger_id", "operation_id").agg(F.max_by(F.struct("state", "seq", "action", "payload", "attempts", "reason", "at"), F.struct("at", "attempts")).alias("r"))
    return last.select("ledger_id", "operation_id", "r.*").filter("state = 'quarantined'").drop("state")
