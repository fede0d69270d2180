"""The sliding-log limiter as a stateful streaming operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import fixed
from ..operators.ordered import HitLog


def limit_stream(hits: DataFrame, limit: int = fixed.RATE_LIMIT, window: int = fixed.RATE_WINDOW_MS, forget_idle: bool = False) -> DataFrame:
    """``hits`` (key string, t long, id long) with blocked.

    State is one list of at most ``limit`` times a key.  With ``forget_idle`` it is dropped once a
    key has been idle for the window, which no result can show; Spark then goes on with triggers
    without data, so a query of that kind is stopped and doesn't end by itself.  Within a trigger hits are taken in the order of t
    and id; a hit that comes later than the trigger of its successors is judged by what is kept.
    """

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = HitLog(limit, window, list(state.get[0]) if state.exists else [])
        # only this trigger's hits of one client
        rows = pd.concat(list(batches)).sort_values(["t", "id"])
        said = [log.blocked(int(t)) for t in rows["t"]]
        state.update((log.kept,))
        if forget_idle:
            state.setTimeoutDuration(max(1, window))
        yield pd.DataFrame({"key": key[0], "t": rows["t"], "id": rows["id"], "blocked": said})

    return hits.groupBy("key").applyInPandasWithState(judge, "key string, t long, id long, blocked boolean", "times array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout if forget_idle else GroupStateTimeout.NoTimeout)
