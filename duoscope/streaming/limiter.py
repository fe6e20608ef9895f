"""Admission by a sliding window: a hit passes if fewer than `limit` hits passed in the `window` seconds before it.

Whether a hit passes depends on which earlier ones did, so hits of a key are taken in order of time. State is what
passed within the window: at most `limit` times a key.
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: Columns of a result, after the hit's own.
ADDED = "allowed boolean, retry_after double"


def step(passed: deque, at: float, limit: int, window: float) -> tuple[bool, float]:
    """Whether a hit passes, and else after how many seconds one would; passed is updated."""
    while passed and passed[0] <= at - window:
        passed.popleft()
    if len(passed) >= limit:
        return False, round(passed[0] + window - at, 1)
    passed.append(at)
    return True, 0.0


def admit(hits: DataFrame, limit: int, window: float) -> DataFrame:
    """hits (key, at, ...) with allowed and retry_after. Rows of a key follow each other in sorted partitions and are
    taken one batch at a time, so no group is held; equal times are ordered by the other columns. Hits without a key or
    a time are not admitted (retry_after null)."""
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema]
    rest = [c for c in hits.columns if c not in ("key", "at")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, passed = None, deque()
        for df in batches:
            out = []
            for k, at in zip(df["key"], df["at"]):
                if k is None or pd.isna(at):
                    out.append((False, None))
                    continue
                if k != key:
                    key, passed = k, deque()
                out.append(step(passed, at, limit, window))
            yield df.assign(allowed=[x for x, _ in out], retry_after=pd.Series([y for _, y in out], dtype="float64", index=df.index))

    return hits.repartition("key").sortWithinPartitions("key", "at", *rest).mapInPandas(run, ", ".join([*kinds, ADDED]))


class Admission(StatefulProcessor):
    """State of a key: hits that wait until the watermark has passed them, and the times of those admitted within the window.

    A timer stands at the first of the waiting hits or, with none waiting, at the time when the last admitted one has left
    the window; then the key's state is cleared. Hits are so taken in order of time, however they arrive."""

    def __init__(self, limit: int, window: float, schema: StructType):
        self.limit, self.window, self.schema = limit, window, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "rows array<binary>")
        self.passed = handle.getValueState("passed", "times array<double>")

    def read(self, state) -> list:
        return list(state.get()[0] or ()) if state.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        waiting = self.read(self.waiting)
        for df in rows:
            waiting += [pickle.dumps(r) for r in df.itertuples(index=False, name=None)]
        self.waiting.update((waiting,))
        self.schedule([pickle.loads(r) for r in waiting], self.read(self.passed))
        return iter(())

    def schedule(self, waiting: list[tuple], passed: list[float]) -> None:
        at = self.schema.fieldNames().index("at")
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if waiting:
            self.handle.registerTimer(int(min(r[at] for r in waiting) * 1000))
        elif passed:
            self.handle.registerTimer(int((passed[-1] + self.window) * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() / 1000
        at, names = self.schema.fieldNames().index("at"), self.schema.fieldNames()
        waiting, passed = [pickle.loads(r) for r in self.read(self.waiting)], deque(self.read(self.passed))
        rest = [i for i, n in enumerate(names) if n not in ("key", "at")]
        due = sorted((r for r in waiting if r[at] <= now), key=lambda r: (r[at], [str(r[i]) for i in rest]))
        answers = [step(passed, r[at], self.limit, self.window) for r in due]
        waiting = [r for r in waiting if r[at] > now]
        while passed and passed[0] <= now - self.window:
            passed.popleft()
        for state, values in ((self.waiting, [pickle.dumps(r) for r in waiting]), (self.passed, list(passed))):
            if values:
                state.update((values,))
            elif state.exists():
                state.clear()
        self.schedule(waiting, list(passed))
        if due:
            out = pd.DataFrame(due, columns=names)
            yield out.assign(allowed=[x for x, _ in answers], retry_after=[float(y) for _, y in answers])

    def close(self) -> None:
        pass


def admit_stream(hits: DataFrame, limit: int, window: float, ts: str = "ts", delay: str = "10 seconds") -> DataFrame:
    """admit() for a stream: hits (key, at, a timestamp ts of the same time, ...) with allowed and retry_after, each sent on
    when the watermark has passed it. Those that come later than `delay` after newer ones are refused by the watermark.

    State lasts as long as something of it can still matter, then the key is forgotten. A restart from the checkpoint goes
    on where it ended. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass). Hits without key, time
    or ts are left out."""
    sound = hits.where(F.col("key").isNotNull() & F.col("at").isNotNull() & ~F.isnan("at") & F.col(ts).isNotNull()).withWatermark(ts, delay)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema)
    late = sound.groupBy("key")
    return late.transformWithStateInPandas(Admission(limit, window, hits.schema), f"{kinds}, {ADDED}", "Append", "EventTime")
