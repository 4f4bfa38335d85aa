"""The rate limit as a stateful stream: accepted times per key, dropped when they no longer count."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.rate_limit import admit

OUTPUT = "request_id long, key string, ts_ms long, accepted boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Rows of one key and micro-batch that a task holds, as two numbers each, before it sets them aside in the state store.
HELD_ROWS = 1_000_000
# Slices of a window by which rows are set aside.
SLICES = 16


class Limiter(StatefulProcessor):
    """Admits each key's rows in time order, later micro-batches after earlier ones.

    State of a key: the at most `limit` accepted times that may still count, and a timer at the last one plus the window, which
    drops the key. The rows of a micro-batch come as Arrow batches in any order. Up to `held_rows` are sorted in memory; beyond,
    they are set aside by slice of time and taken back one slice at a time, so a hot key needs the memory of its fullest slice.
    """

    def __init__(self, limit: int, width: int, held_rows: int = HELD_ROWS):
        self.limit, self.width, self.held_rows = limit, width, held_rows
        self.slice = max(1, width // SLICES)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "ts_ms long")
        # Empty between micro-batches.
        self.aside = handle.getMapState("aside", "slice long, part int", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = np.sort(np.array([t for (t,) in self.times.get()], np.int64)) if self.times.exists() else np.empty(0, np.int64)
        # Rows are taken as (time, id, 1 if the id is null).
        waiting, parts = [np.empty((0, 3), np.int64)], {}
        for batch in rows:
            ids = batch["request_id"]
            none = ids.isna().to_numpy()
            waiting.append(np.column_stack([batch["ts_ms"].to_numpy(np.int64), ids.fillna(0).to_numpy(np.int64), none]))
            if sum(map(len, waiting)) > self.held_rows:
                self._set_aside(np.concatenate(waiting), parts)
                waiting = waiting[:1]
        if parts:
            self._set_aside(np.concatenate(waiting), parts)
            runs = (self._take_back(at, parts[at]) for at in sorted(parts))
        else:
            runs = iter([np.concatenate(waiting)])
        for run in runs:
            run = run[np.lexsort((run[:, 1], run[:, 2], run[:, 0]))]
            accepted, held = admit(run[:, 0], held, self.limit, self.width)
            for begin in range(0, len(run), self.held_rows):
                part, ok = run[begin:begin + self.held_rows], accepted[begin:begin + self.held_rows]
                ids = pd.array(part[:, 1], "Int64")
                ids[part[:, 2] == 1] = pd.NA
                yield pd.DataFrame({"request_id": ids, "key": key[0], "ts_ms": part[:, 0], "accepted": ok})
        self._remember(held)

    def _set_aside(self, rows: np.ndarray, parts: dict[int, int]) -> None:
        rows = rows[np.argsort(rows[:, 0] // self.slice, kind="stable")]
        slices, begins = np.unique(rows[:, 0] // self.slice, return_index=True)
        for at, part in zip(slices.tolist(), np.split(rows, begins[1:])):
            self.aside.updateValue((at, parts.get(at, 0)), (part.tobytes(),))
            parts[at] = parts.get(at, 0) + 1

    def _take_back(self, at: int, parts: int) -> np.ndarray:
        found = [np.frombuffer(self.aside.getValue((at, part))[0], np.int64).reshape(-1, 3) for part in range(parts)]
        for part in range(parts):
            self.aside.removeKey((at, part))
        return np.concatenate(found)

    def _remember(self, held: np.ndarray) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if len(held):
            self.times.put([(t,) for t in held.tolist()])
            self.handle.registerTimer(int(held[-1]) + self.width)
        else:
            self.times.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        yield from ()

    def close(self) -> None:
        pass


def rate_limit_stream(
    requests: DataFrame, limit: int, window_s: float, key: str = "key", ts_ms: str = "ts_ms", id_col: str = "request_id",
    lateness: str = "1 hour", held_rows: int = HELD_ROWS,
) -> DataFrame:
    """Rate limit over a request stream: (request_id, key, ts_ms, accepted).

    Rows of a micro-batch are taken in time order, then by id, null ids last; later micro-batches after earlier ones. A key without accepted
    times in its window is forgotten once the watermark, `lateness` behind the latest request, has passed them. Requests that come even
    later, and those without a time or with one up to 1970, are no part of the audit. A null key is `unknown`.
    """
    # The state is kept on disk, as operators of this kind need it.
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = requests.filter(F.col(ts_ms).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("request_id"),
        F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias("key"), F.col(ts_ms).cast("bigint").alias("ts_ms"),
    )
    timed = rows.withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", lateness)
    return timed.groupBy("key").transformWithStateInPandas(
        Limiter(limit, int(window_s * 1000), held_rows), OUTPUT, outputMode="append", timeMode="EventTime")
