"""Keyed state of streams: events in order, whatever order they come in, and lives that end.

State lies in RocksDB and outlives restarts from the checkpoint.  Events wait in runs, each sorted when it comes and kept in parts, until
the watermark has passed them, so that nothing earlier can come; a timer at the earliest of them wakes the key.  Runs are then merged, a part of
each at a time, so that Python holds a run at most and never all events of a key.
"""

from __future__ import annotations

import heapq
import json
import pickle
from collections.abc import Iterator
from itertools import islice
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gleanery.streaming.folds import Fold

# Rows of a run, of a part of it, and of what is handed on at once.
RUN, PART, SLICE = 1 << 17, 1 << 11, 1 << 13
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rocks(spark: SparkSession) -> None:
    """Streams that keep state of this kind need the session's state store to be RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def micros(ts: pd.Series) -> list[int]:
    """Instants as microseconds since the epoch."""
    return ts.astype("datetime64[ns]").astype("int64").floordiv(1000).tolist()


class InOrder(StatefulProcessor):
    """Hands a key's events to act() in the order of time and id, some at a time, once the watermark has passed them."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "run bigint, part int", "rows binary")
        self.runs = handle.getValueState("runs", "json string")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def act(self, key: Any, slices: Iterator[list[tuple]], now: int) -> Iterator[pd.DataFrame]:
        """What the events of all slices, which come in order, give; every slice has to be taken."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # of a run: its number, the part and the row that come next, the parts, and the time of that row
        runs, come = json.loads(self.runs.get()[0]) if self.runs.exists() else [], []
        earliest = None
        for batch in rows:
            come += zip(micros(batch["ts"]), batch["event_id"].tolist(), *(batch[c].tolist() for c in self.columns), strict=True)
            if len(come) >= RUN:
                earliest = min(x for x in (earliest, self._keep(runs, come)) if x is not None)
                come = []
        if come:
            earliest = min(x for x in (earliest, self._keep(runs, come)) if x is not None)
        if earliest is not None:
            self.runs.update((json.dumps(runs),))
            self._wake(earliest // 1000 + 1)
        return iter(())

    def _keep(self, runs: list[list[int]], come: list[tuple]) -> int:
        """Events as a run of their own; its first time."""
        come.sort()
        number = max((r[0] for r in runs), default=-1) + 1
        n = -(-len(come) // PART)
        for i in range(n):
            self.parts.updateValue((number, i), (pickle.dumps(come[i * PART : (i + 1) * PART]),))
        runs.append([number, 0, 0, n, come[0][0]])
        return come[0][0]

    def _due(self, run: list[int], now: int) -> Iterator[tuple]:
        """The events of a run that the watermark has passed; parts that are done with go, and the run tells where it stands."""
        number, part, row, n, _ = run
        while part < n:
            rows = pickle.loads(bytes(self.parts.getValue((number, part))[0]))
            for x in islice(rows, row, None):
                if x[0] // 1000 >= now:
                    run[:] = [number, part, row, n, x[0]]
                    return
                row += 1
                yield x
            self.parts.removeKey((number, part))
            part, row = part + 1, 0
        run[:] = [number, n, 0, n, 0]

    def _wake(self, ms: int) -> None:
        """A timer at that time, unless one comes before it."""
        timers = list(self.handle.listTimers())
        if not any(t <= ms for t in timers):
            self.handle.registerTimer(ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        runs = json.loads(self.runs.get()[0]) if self.runs.exists() else []
        due = heapq.merge(*[self._due(run, now) for run in runs if run[4] // 1000 < now])
        yield from self.act(key, iter(lambda: list(islice(due, SLICE)), []), now)
        rest = [run for run in runs if run[1] < run[3]]
        if rest:
            self.runs.update((json.dumps(rest),))
            self.handle.registerTimer(min(run[4] for run in rest) // 1000 + 1)
        else:
            self.runs.clear()

    def close(self) -> None:
        pass


class _Folding(InOrder):
    """A fold's state as JSON in a value state."""

    def __init__(self, columns: list[str], name: str, fold: Fold):
        super().__init__(columns)
        self.name, self.fold = name, fold

    def open(self, handle) -> None:
        self.state = handle.getValueState("state", "json string")

    def act(self, key, slices, now):
        state = None
        for rows in slices:
            if state is None:
                state = json.loads(self.state.get()[0]) if self.state.exists() else self.fold.start()
            out = []
            for us, _, *more in rows:
                state, value = self.fold.step(state, us, *more)
                out.append(value)
            yield pd.DataFrame({"event_id": [x[1] for x in rows], "key": [key[0]] * len(rows), self.name: out})
        if state is not None:
            self.state.update((json.dumps(state),))


class _Lives(InOrder):
    """First, last and number of the events of a key until `seconds` have passed without one."""

    def __init__(self, seconds: int):
        super().__init__([])
        self.micros = seconds * 1_000_000

    def open(self, handle) -> None:
        self.life = handle.getValueState("life", "first bigint, last bigint, n bigint")

    def act(self, key, slices, now):
        first, last, n = self.life.get() if self.life.exists() else (None, None, 0)
        for rows in slices:
            ended = []
            for us, *_ in rows:
                if n and us - last >= self.micros:
                    ended.append((first, last, n))
                    n = 0
                first, last, n = (first if n else us), us, n + 1
            if ended:
                yield self._told(key, ended)
        # the next slice can go on with a life; only after all of them is it known to have ended
        if n and (last + self.micros) // 1000 < now:
            yield self._told(key, [(first, last, n)])
            n = 0
        if n:
            self.life.update((first, last, n))
            self.handle.registerTimer((last + self.micros) // 1000 + 1)
        else:
            self.life.clear()

    @staticmethod
    def _told(key, ended: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]] * len(ended), **{c: [pd.Timestamp(x[i], unit="us") if i < 2 else x[i] for x in ended] for i, c in enumerate(("first", "last", "n"))}})


def _started(stream: DataFrame, columns: list[str], late: str) -> DataFrame:
    rocks(stream.sparkSession)
    rows = stream.select("event_id", "key", F.col("ts").cast("timestamp").alias("ts"), *columns)
    return rows.withWatermark("ts", late).groupBy("key")


def in_order(stream: DataFrame, columns: list[str], made: str, fold: Fold, late: str = "10 minutes") -> DataFrame:
    """event_id, key and what a fold says of each event of a stream; events later than `late` are dropped, as by any watermark."""
    kind = stream.schema["key"].dataType.simpleString()
    step = _Folding(columns, made.split()[0], fold)
    return _started(stream, columns, late).transformWithStateInPandas(step, f"event_id bigint, key {kind}, {made}", "Append", "EventTime")


def lives(stream: DataFrame, seconds: int, late: str = "10 minutes") -> DataFrame:
    kind = stream.schema["key"].dataType.simpleString()
    return _started(stream, [], late).transformWithStateInPandas(_Lives(seconds), f"key {kind}, first timestamp, last timestamp, n bigint", "Append", "EventTime")
