"""Timers of the streams: locks of repositories that expire, and deliveries that are tried again after a while.

Both are state machines by key with timers, in event time (the clock is the watermark, so a run can be repeated) or in processing
time (for streams that may fall silent). The sessions need RocksDB as their state store: ``use_rocksdb``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds that a lock or an attempt lasts, seconds before another attempt, and attempts.
TTL, DELAY, TRIES = 300, 60, 3


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _rows(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(parts), ignore_index=True)


def _text(x: object) -> str | None:
    return x if isinstance(x, str) else None


class _Timed(StatefulProcessor):
    """What both have in common: one value of state, and the time as seconds."""

    STATE = OUT = ""

    def __init__(self, event_time: bool):
        self.event_time = event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.value = handle, handle.getValueState("value", self.STATE)

    def ordered(self, rows: Iterator[pd.DataFrame], timers) -> Iterator[tuple[int, dict]]:
        """The rows by time, each with its own in seconds, or now."""
        now = timers.getCurrentProcessingTimeInMs() // 1000
        for r in _rows(rows).sort_values("ts", kind="stable").to_dict("records"):
            yield (int(pd.Timestamp(r["ts"]).timestamp()) if self.event_time and not pd.isna(r["ts"]) else now), r

    def wake(self, at: int | None) -> None:
        """One timer, at that time, or none."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if at is not None:
            self.handle.registerTimer(at * 1000)

    def table(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in self.OUT.split(", ")])

    def close(self) -> None:
        pass


class Locks(_Timed):
    """One lock for each repository. ``acquire`` gets it if it is free, or if its time is over; ``release`` by its owner frees it; a lock that
    isn't released expires."""

    STATE = "owner string, until long"
    OUT = "repo_id string, owner string, result string, at long"

    def __init__(self, event_time: bool, ttl: int = TTL):
        super().__init__(event_time)
        self.ttl = ttl

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, held = [], self.value.get() if self.value.exists() else None
        for now, r in self.ordered(rows, timerValues):
            owner, action = _text(r["owner"]), _text(r["action"])
            if held and now >= held[1]:
                out.append((key[0], held[0], "expired", int(held[1])))
                held = None
            if action == "acquire":
                result = "refused" if held else "acquired"
                held = held or (owner, now + self.ttl)
            elif action == "release" and held and held[0] == owner:
                result, held = "released", None
            else:
                result = "ignored"
            out.append((key[0], owner, result, now))
        self._keep(held)
        yield from self.table(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.value.get() if self.value.exists() else None
        if held and expiredTimerInfo.getExpiryTimeInMs() >= held[1] * 1000:
            self.value.clear()
            yield from self.table([(key[0], held[0], "expired", int(held[1]))])

    def _keep(self, held: tuple | None) -> None:
        if held:
            self.value.update(held)
        else:
            self.value.clear()
        self.wake(int(held[1]) if held else None)


class Deliveries(_Timed):
    """Deliveries and the answers to their attempts, by delivery_id. A delivery is run at once; a failed attempt, or one without an
    answer within ``ttl``, is run again after ``delay``; after ``tries`` the delivery is dead. Rows of kind ``event`` start one (a second
    changes nothing), rows of kind ``answer`` have the attempt and ok (null: failed). Null or unknown events, and rows without delivery_id, are dead at once."""

    STATE = "status string, attempt int, until long, event string, data string"
    OUT = "delivery_id string, step string, attempt int, event string, data string, detail string, at long"

    def __init__(self, event_time: bool, known: tuple[str, ...], ttl: int = TTL, delay: int = DELAY, tries: int = TRIES):
        super().__init__(event_time)
        self.known, self.ttl, self.delay, self.tries = known, ttl, delay, tries

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, own = [], tuple(self.value.get()) if self.value.exists() else None
        for now, r in self.ordered(rows, timerValues):
            own = self._due(key[0], own, now, out)
            if r["kind"] == "event" and (own is None or not isinstance(key[0], str)):
                event, data = _text(r["event"]), _text(r["data"])
                why = "no delivery_id" if not isinstance(key[0], str) else f"unknown event {event or 'null'}" if event not in self.known else None
                own = ("dead" if why else "running", 0 if why else 1, 0 if why else now + self.ttl, event, data)
                out.append((key[0], "dead" if why else "run", own[1], event, data, why, now))
            elif r["kind"] == "answer" and own and own[0] == "running" and r["attempt"] == own[1]:
                if r["ok"] is True or (not pd.isna(r["ok"]) and bool(r["ok"])):
                    own = ("done", own[1], 0, own[3], None)
                    out.append((key[0], "done", own[1], own[3], None, _text(r["detail"]), now))
                else:
                    own = self._failed(key[0], own, now, _text(r["detail"]) or "failed", out)
        self._keep(own)
        yield from self.table(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        own = tuple(self.value.get()) if self.value.exists() else None
        self._keep(self._due(key[0], own, expiredTimerInfo.getExpiryTimeInMs() // 1000, out))
        yield from self.table(out)

    def _due(self, key: str, own: tuple | None, now: int, out: list[tuple]) -> tuple | None:
        """After all that was to happen until ``now``."""
        while own and own[0] in ("running", "waiting") and own[2] <= now:
            at = int(own[2])
            if own[0] == "running":
                own = self._failed(key, own, at, "no answer", out)
            else:
                own = ("running", own[1] + 1, at + self.ttl, own[3], own[4])
                out.append((key, "run", own[1], own[3], own[4], None, at))
        return own

    def _failed(self, key: str, own: tuple, at: int, why: str, out: list[tuple]) -> tuple:
        if own[1] < self.tries:
            return ("waiting", own[1], at + self.delay, own[3], own[4])
        out.append((key, "dead", own[1], own[3], own[4], why, at))
        return ("dead", own[1], 0, own[3], None)

    def _keep(self, own: tuple | None) -> None:
        if own:
            self.value.update(own)
            self.wake(int(own[2]) if own[0] in ("running", "waiting") else None)


def locks(requests: DataFrame, ttl: int = TTL, event_time: bool = True) -> DataFrame:
    """repo_id, owner, result, at of a stream of requests (repo_id, owner, action, ts with a watermark)."""
    mode = "eventTime" if event_time else "processingTime"
    return requests.groupBy("repo_id").transformWithStateInPandas(Locks(event_time, ttl), Locks.OUT, "append", mode)


def deliveries(rows: DataFrame, known: tuple[str, ...], event_time: bool = True, ttl: int = TTL, delay: int = DELAY, tries: int = TRIES) -> DataFrame:
    """What is to be run, done and dead, of a stream of events and answers (delivery_id, kind, event, data, attempt, ok,
    detail, ts with a watermark). Whoever runs the attempts writes answers, which come back by the stream."""
    mode = "eventTime" if event_time else "processingTime"
    return rows.groupBy("delivery_id").transformWithStateInPandas(Deliveries(event_time, known, ttl, delay, tries), Deliveries.OUT, "append", mode)
