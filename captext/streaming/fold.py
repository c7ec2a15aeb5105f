"""Steps (see steps.py) driven over tables and streams, in event time."""

from __future__ import annotations

import pickle
from collections import namedtuple
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegralType, StructType

from captext.streaming.steps import Step

#: Times of rows are milliseconds since 2024-01-01; in a stream they stand so far after 1970.
EPOCH = 1_704_067_200_000
#: From this time on (9000-01-01) a stream is over.
END = 221_845_392_000_000 - EPOCH


def records(frame: pd.DataFrame, kinds: StructType) -> Iterator[tuple]:
    """The rows of a frame with whole numbers and None where pandas has floats and NaN for a column with nulls."""
    columns = []
    for f in kinds.fields:
        values = frame[f.name]
        if isinstance(f.dataType, IntegralType) and values.dtype.kind == "f":
            columns.append([None if x != x else int(x) for x in values])
        else:
            columns.append([None if x is pd.NaT else x for x in values])
    return zip(*columns, strict=True)


def passed(step: Step, key, state, now: int | None) -> list[tuple]:
    """What falls due until `now`, in order; None: ever."""
    out: list[tuple] = []
    while (due := step.due(state)) is not None and (now is None or due <= now):
        out += step.fire(key, state, due)
    return out


def table_fold(rows: DataFrame, key: str, order: list[str], step: Step) -> DataFrame:
    """Fold a table; rows without a key are left out.

    A key's rows are in one task, as their order needs, but pass through it batch by
    batch: Spark sorts them, and only states are held. The first column of `order` is
    the time by which the step's moments fall due.
    """
    types, kinds = rows.sparkSession.createDataFrame([], step.schema).schema, rows.schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        record, now, state = namedtuple("Row", kinds.names), None, step.start()
        for frame in frames:
            out: list[tuple] = []
            for row in map(record._make, records(frame, kinds)):
                if getattr(row, key) != now:
                    if now is not None:
                        out += passed(step, now, state, None) + step.end(now, state)
                    now, state = getattr(row, key), step.start()
                out += passed(step, now, state, getattr(row, order[0]))
                out += step.row(state, row)
            yield pd.DataFrame(out, columns=types.names)
        if now is not None:
            yield pd.DataFrame(passed(step, now, state, None) + step.end(now, state), columns=types.names)

    return rows.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, types)


class Ordered(StatefulProcessor):
    """Rows of a key wait for the watermark, then go through a step in their order; timers wake it without a next row.

    Waiting rows are a ListState, the step's state is a ValueState that goes when it
    equals a new one. Rows that wait at once are sorted in memory: the watermark's
    delay bounds them.
    """

    def __init__(self, kinds: StructType, made: list[str], order: list[str], step: Step):
        self.names, self.kinds, self.out, self.step = kinds.names, kinds, made, step
        self.order = [kinds.names.index(c) for c in order]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.kinds)
        self.state = handle.getValueState("state", "state binary")
        self.record = namedtuple("Row", self.names)
        self.empty = self.step.start()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            found = list(records(frame, self.kinds))
            if found:
                self.waiting.appendList(found)
                least = min(r[self.order[0]] for r in found)
                first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(EPOCH + int(first))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() - EPOCH
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: tuple(r[i] for i in self.order)) if self.waiting.exists() else []
        ready = [r for r in rows if r[self.order[0]] <= now]
        state = pickle.loads(self.state.get()[0]) if self.state.exists() else self.step.start()
        out: list[tuple] = []
        for r in ready:
            out += passed(self.step, key[0], state, r[self.order[0]])
            out += self.step.row(state, self.record(*r))
        over = now >= END
        out += passed(self.step, key[0], state, None if over else now)
        if over:
            out += self.step.end(key[0], state)
        if ready:
            later = rows[len(ready) :]
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        if over or state == self.empty:
            self.state.clear()
        else:
            self.state.update((pickle.dumps(state),))
        wake = [r[self.order[0]] for r in rows[len(ready) :][:1]] + [d for d in [self.step.due(state)] if d is not None and not over]
        if wake:
            self.handle.registerTimer(EPOCH + int(min(wake)))
        return iter([pd.DataFrame(out, columns=self.out)] if out else [])


def stream_fold(rows: DataFrame, key: str, order: list[str], step: Step) -> DataFrame:
    """Fold a stream that has a watermark on its event time, order[0] ms after EPOCH; rows without a key are left out.

    Needs the RocksDB state store (live.finished() sets it).
    """
    names = [c for c in rows.columns if dict(rows.dtypes)[c] != "timestamp"]
    kinds = StructType([f for f in rows.schema.fields if f.name in names])
    types = rows.sparkSession.createDataFrame([], step.schema).schema
    fold = Ordered(kinds, types.names, order, step)
    return rows.where(F.col(key).isNotNull()).groupBy(key).transformWithStateInPandas(fold, types, "Append", "EventTime")
