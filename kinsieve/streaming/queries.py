"""The task queue as a stream keyed by item. Queues by job and candidate buckets are in `stateful`, deltas in `delta`."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.queue import LEASE, advance

QUEUE_STATE = "status string, attempts int, next_ts double, token string, error string"


def queue_stream(events: DataFrame, lease: float = LEASE) -> DataFrame:
    """Latest state of each (job, item_id) after every micro-batch of events (at, seq, kind, ok, reason, token)."""
    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = tuple(state.get) if state.exists else ("queued", 0, 0.0, None, None)
        rows = pd.concat(list(frames)).sort_values(["at", "seq"]).astype(object)
        for e in rows.where(rows.notna(), None).itertuples():
            s = advance(s, e, lease)
        state.update(s)
        yield pd.DataFrame([[*key, *s]], columns=["job", "item_id", "status", "attempts", "next_ts", "token", "error"])

    kind = events.schema["item_id"].dataType.simpleString()
    return events.groupBy("job", "item_id").applyInPandasWithState(fold, f"job string, item_id {kind}, {QUEUE_STATE}", QUEUE_STATE, "update", GroupStateTimeout.NoTimeout)
