"""Runs of equal entries of a log as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType


def folded_stream(log: DataFrame, within: str, same: list[str], order: str, ts: str) -> DataFrame:
    """Per log (`within`): each run that a batch begins or goes on with: first (its first order), same, ts, count; the last row of a run counts.

    An entry equal to the newest one of its log adds to that one's count and moves its time; any other begins a run. Only
    the newest run of a log is kept as state. Entries are taken in `order` within a batch, batches as they come.
    """
    kept = StructType([StructField("first", LongType()), *[log.schema[c] for c in same], StructField("ts", log.schema[ts].dataType), StructField("count", LongType())])

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        run, out = (list(state.get) if state.exists else None), []
        for first, now, *entry in rows[[order, ts, *same]].astype(object).itertuples(index=False, name=None):
            entry = [None if pd.isna(x) else x for x in entry]
            if run is not None and run[1:-2] == entry:
                run = [run[0], *entry, now, run[-1] + 1]
            else:
                if run is not None:
                    out.append((*key, *run))
                run = [first, *entry, now, 1]
        out.append((*key, *run))
        state.update(tuple(run))
        yield pd.DataFrame(out, columns=[within, *kept.names])

    return log.groupBy(within).applyInPandasWithState(fold, StructType([log.schema[within], *kept]), kept, "update", GroupStateTimeout.NoTimeout)
