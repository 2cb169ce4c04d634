"""When content has settled, over a stream of readings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "item bigint, ts timestamp, event_id bigint, value string, settled boolean"


def settled(readings: DataFrame, item: str, ts: str, order: str, value: str, loading: str, timeout_ms: int | None = 20_000) -> DataFrame:
    """A row an item: its first reading that equals the one before it, loading ones left out; or, when timeout_ms pass
    without another reading, the last one, not settled. State is one reading an item, however many come.
    timeout_ms None waits for ever, as a run over what is there wants: a timeout keeps a stream alive."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            has, _, when, eid, last = state.get
            state.update((has, True, when, eid, last))
            if has:
                yield pd.DataFrame({"item": [key[0]], "ts": [pd.Timestamp(when)], "event_id": [eid], "value": [last], "settled": [False]})
            return
        has, over, when, eid, last = state.get if state.exists else (False, False, 0, 0, "")
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for r in rows.itertuples(index=False):
            if over or r.loading:
                continue
            if has and r.value == last:
                over = True
                yield pd.DataFrame({"item": [key[0]], "ts": [r.ts], "event_id": [r.event_id], "value": [r.value], "settled": [True]})
            has, last, when, eid = True, r.value, pd.Timestamp(r.ts).value, r.event_id
        state.update((has, over, when, eid, last))
        if not over and timeout_ms is not None:
            state.setTimeoutDuration(timeout_ms)

    own = readings.select(F.col(item).cast("long").alias("item"), F.col(ts).cast("timestamp").alias("ts"), F.col(order).cast("long").alias("event_id"), F.col(value).alias("value"), F.col(loading).alias("loading"))
    return own.groupBy("item").applyInPandasWithState(step, OUT, "has boolean, over boolean, at bigint, event_id bigint, last string", "append", GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
