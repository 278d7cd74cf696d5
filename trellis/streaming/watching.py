"""A watch over machines as a stream: counters are state, and silences are told by timers of event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

#: Kinds of events: a change was noticed, a cycle began, a refresh failed or went well, a sign of life.
WAKE, CYCLE, FAILED, OK, BEAT = "wake", "cycle", "failed", "ok", "beat"
SINCE, STALE = "event", "stale"
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Watch(StatefulProcessor):
    """Per machine: changes pending since the last cycle began, refreshes failed in a row, and when it was last heard of."""

    def __init__(self, machine: str, latch: int, micros: int) -> None:
        self.machine, self.latch, self.micros = machine, latch, micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("watch", StructType([StructField(n, LongType()) for n in ("pending", "failures", "last", "told")]))

    def _timer(self, last: int) -> int:
        """The first millisecond at which a machine that was last heard of then has been silent for too long."""
        return (last + self.micros) // 1000 + 1

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        pending, failures, last, told = self.kept.get() if self.kept.exists() else (0, 0, None, 0)
        before, out = last, []
        for seq, at, kind in pd.concat(list(rows)).sort_values("seq")[["seq", "at", "kind"]].itertuples(index=False, name=None):
            if last is not None and at - last > self.micros and not told:
                out.append((*key, None, last + self.micros, STALE, pending, failures, failures >= self.latch))
            if last is None or at > last:
                last, told = int(at), 0
            pending = 0 if kind == CYCLE else pending + (kind == WAKE)
            failures = failures + 1 if kind == FAILED else 0 if kind == OK else failures
            out.append((*key, int(seq), int(at), SINCE, pending, failures, failures >= self.latch))
        if before != last:
            if before is not None:
                self.handle.deleteTimer(self._timer(before))
            self.handle.registerTimer(self._timer(last))
        self.kept.update((pending, failures, last, told))
        yield pd.DataFrame(out, columns=[self.machine, "seq", "at", "what", "pending", "failures", "latched"]).astype({"seq": "Int64"})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        pending, failures, last, told = self.kept.get()
        if not told and self._timer(last) <= expiredTimerInfo.getExpiryTimeInMs():
            self.kept.update((pending, failures, last, 1))
            row = (*key, None, last + self.micros, STALE, pending, failures, failures >= self.latch)
            yield pd.DataFrame([row], columns=[self.machine, "seq", "at", "what", "pending", "failures", "latched"]).astype({"seq": "Int64"})

    def close(self) -> None:
        pass


def watched(events: DataFrame, machine: str, ts: str, late: str = "1 minute", latch: int = 3, micros: int = 30_000_000) -> DataFrame:
    """A row for each event with its machine's counters after it, and one for each silence of more than micros.

    events has machine, seq (its order), ts and kind. at is in microseconds; a silence is told when the watermark has passed
    it, or when the event that ends it comes first. Needs the RocksDB provider of state.
    """
    events.sparkSession.conf.set(*PROVIDER)
    schema = StructType([events.schema[machine], StructField("seq", LongType()), StructField("at", LongType()), StructField("what", StringType()), StructField("pending", LongType()), StructField("failures", LongType()), StructField("latched", BooleanType())])
    rows = events.withWatermark(ts, late).selectExpr(f"`{machine}`", "seq", f"`{ts}`", f"unix_micros(`{ts}`) as at", "kind")
    return rows.groupBy(machine).transformWithStateInPandas(Watch(machine, latch, micros), schema, "Append", "EventTime")
