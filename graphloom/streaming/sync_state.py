"""The sync-state machine of each repository as a stateful streaming operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "repo_id string, state string, retry_count int, current_sha string, updates int"
STATE = "state string, retry_count int, current_sha string, updates int"


def advance(now: tuple[str, int, str | None, int], event: str, sha: str | None) -> tuple[str, int, str | None, int]:
    """State, retries and revision after one event."""
    state, retries, current, n = now
    if event == "start":
        state = "syncing"
    elif event == "done":
        state, retries, current = "synced", 0, sha or current
    elif event == "fail":
        state, retries = "error", retries + 1
    elif event == "behind" and state == "synced":
        state = "stale"
    return state, retries, current, n + 1


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = tuple(state.get) if state.exists else ("pending", 0, None, 0)
    rows = pd.concat(list(batches)).sort_values("ord")
    for event, sha in zip(rows["event"], rows["sha"], strict=True):
        now = advance(now, event, sha if isinstance(sha, str) else None)
    state.update(now)
    yield pd.DataFrame({"repo_id": [key[0]], "state": [now[0]], "retry_count": [now[1]], "current_sha": [now[2]], "updates": [now[3]]})


def track(events: DataFrame) -> DataFrame:
    """The state of each repository of the stream (repo_id, ord, event, sha) after each micro-batch that touches it."""
    return events.groupBy("repo_id").applyInPandasWithState(_update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
