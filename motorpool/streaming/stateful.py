"""Telemetry with state inside the stream: keys that fall silent leave it by event-time timers.

State lives in the query's checkpoint, so a restart goes on where the stream stopped. Times
of a key must not repeat. A reading behind the watermark is dropped by Spark and counted, see
:func:`dropped_as_late`; one that is only behind its key's last reading is told apart.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from motorpool.operators.joins import latest_per_key

_MICROS = "__micros"


def _timed(sdf: DataFrame, ts: str, delay: str) -> DataFrame:
    """``sdf`` with a watermark on its time, and the time in microseconds for the timers."""
    event_time = F.col(ts).cast("timestamp")
    return sdf.withColumns({"__event_time": event_time, _MICROS: F.unix_micros(event_time)}).withWatermark("__event_time", delay)


def _set_timer(state: GroupState, micros: int, silence_ms: int) -> None:
    """A timer at the end of the silence after the last reading. It must lie ahead of the watermark;
    a reading just ahead of it still keeps its key for the rest of its silence."""
    state.setTimeoutTimestamp(max(micros // 1000 + silence_ms, state.getCurrentWatermarkMs() + 1))


def latest_positions(sdf: DataFrame, key: str, ts: str, delay: str = "10 minutes", silence_minutes: int = 1440) -> DataFrame:
    """A stream of changes: the newest reading of each key that a batch brings forward, with
    ``gone`` FALSE, and TRUE once when the watermark has left the key's last reading behind by
    ``silence_minutes``. The state holds one row per key that is not gone. Of readings at the
    same time the first by the other columns, from the greatest down, is the newest.

    A key's readings of a batch pass through in pieces and only the newest is kept, so a crowded
    key needs no more memory than others.
    """
    names = sdf.columns
    silence_ms = silence_minutes * 60_000
    state_schema = T.StructType([*sdf.schema.fields, T.StructField(_MICROS, T.LongType())])
    output = T.StructType([*sdf.schema.fields, T.StructField("gone", T.BooleanType())])

    def keep(_: Any, pieces: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get
            state.remove()
            yield pd.DataFrame([[*last[:-1], True]], columns=[*names, "gone"])
            return
        best = None if not state.exists else tuple(state.get)
        old = best
        for piece in pieces:
            order = [_MICROS, *(n for n in names if n not in (key, ts))]
            top = piece.sort_values(order, ascending=False, kind="stable").iloc[0]
            row = (*(top[n] for n in names), int(top[_MICROS]))
            if best is None or row[-1] > best[-1]:
                best = row
        if best is not old:
            state.update(best)
            yield pd.DataFrame([[*best[:-1], False]], columns=[*names, "gone"])
        _set_timer(state, best[-1], silence_ms)

    timed = _timed(sdf, ts, delay)
    return timed.groupBy(key).applyInPandasWithState(keep, output, state_schema, "update", GroupStateTimeout.EventTimeTimeout)


def charging_state(
    sdf: DataFrame, key: str, ts: str, level: str, low: float = 10, high: float = 90, delay: str = "10 minutes", silence_minutes: int = 1440
) -> DataFrame:
    """Every reading with ``charging``, the two-threshold state of its key so far, and ``late``.

    The state of a key is whether it charges and the time of its last reading. A reading that is
    not newer than it is late: it changes nothing and has no state. A key that has been silent
    for ``silence_minutes`` behind the watermark leaves the state and would begin anew.
    """
    names = sdf.columns
    silence_ms = silence_minutes * 60_000
    state_schema = T.StructType([T.StructField("charging", T.BooleanType()), T.StructField("micros", T.LongType())])
    output = T.StructType([*sdf.schema.fields, T.StructField("charging", T.BooleanType()), T.StructField("late", T.BooleanType())])

    def step(_: Any, pieces: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        charging, seen = tuple(state.get) if state.exists else (False, None)
        # Spark fires no timer for a key that has readings in the batch.
        if seen is not None and state.getCurrentWatermarkMs() > seen // 1000 + silence_ms:
            charging, seen = False, None
        rows = pd.concat(list(pieces)).sort_values(_MICROS, kind="stable").reset_index(drop=True)
        late = rows[_MICROS] <= seen if seen is not None else pd.Series(False, index=rows.index)
        mark = pd.Series(pd.NA, index=rows.index, dtype="boolean")
        mark[(rows[level] < low) & ~late] = True
        mark[(rows[level] >= high) & ~late] = False
        so_far = mark.ffill().fillna(bool(charging))
        if not late.all():
            charging, seen = bool(so_far.iloc[-1]), int(rows[_MICROS].iloc[-1])
            state.update((charging, seen))
        _set_timer(state, seen, silence_ms)
        yield rows[names].assign(charging=so_far.astype(object).where(~late, None), late=late)

    timed = _timed(sdf, ts, delay)
    return timed.groupBy(key).applyInPandasWithState(step, output, state_schema, "append", GroupStateTimeout.EventTimeTimeout)


def write_changes(changes: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write a stream of changes, a folder per batch, replaced when the batch is retried."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    trigger = trigger or {"availableNow": True}
    query = changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    if trigger.get("availableNow"):
        query.awaitTermination()
    return query


def current(changes: DataFrame, key: str, ts: str) -> DataFrame:
    """The positions that written changes leave: the last change of each key, unless it is gone."""
    last = latest_per_key(changes, key, ts, ties="one", tie_break=[F.col("batch_id").desc(), F.col("gone").desc()])
    return last.filter(~F.col("gone")).drop("gone", "batch_id")


def state_rows(query: StreamingQuery) -> int:
    """Keys in the state after the last batch."""
    return int(query.lastProgress.stateOperators[0].numRowsTotal)


def dropped_as_late(query: StreamingQuery) -> int:
    """Readings behind the watermark, in the batches that the query remembers."""
    return sum(int(s.numRowsDroppedByWatermark) for p in query.recentProgress for s in p.stateOperators)
