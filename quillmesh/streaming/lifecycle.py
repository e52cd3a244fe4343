"""Operations as keyed, expiring state of a stream: each event takes the same step as in the batch fold."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillmesh.operators.lifecycle import TTL_SECONDS, State, transition

OUTCOMES = "op_id string, at double, seq long, action string, outcome string, status string, revision int"
STATE = "status string, revision int, authorized int, expires double"


def outcomes(events: DataFrame, ttl: float = TTL_SECONDS) -> DataFrame:
    """For a stream of events (op_id, at, seq, action, revision, acknowledge, blocked, warned): what became of each.

    An operation's values live in the state no longer than ttl: by the events' own time for what they find, and by processing time for
    what is never asked for again.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        status, revision, authorized, expires = held.get if held.exists else (None, 0, None, 0.0)
        now = None if status is None else State(status, revision, authorized, expires)
        rows: list[tuple[Any, ...]] = []
        for e in pd.concat(list(frames)).sort_values(["at", "seq"]).itertuples(index=False):
            seen = None if pd.isna(e.revision) else int(e.revision)
            now, outcome = transition(now, e.action, float(e.at), seen, bool(e.acknowledge), bool(e.blocked), bool(e.warned), ttl)
            rows.append((key[0], float(e.at), int(e.seq), e.action, outcome, now.status if now else None, now.revision if now else None))
        if now is None:
            if held.exists:
                held.remove()
        else:
            held.update((now.status, now.revision, now.authorized, now.expires))
            held.setTimeoutDuration(int(ttl * 1000))
        yield pd.DataFrame(rows, columns=["op_id", "at", "seq", "action", "outcome", "status", "revision"]).astype({"revision": "Int32"})

    return events.groupBy("op_id").applyInPandasWithState(step, OUTCOMES, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
