"""The folds of ``operators.state`` over streams, with their state kept by Spark."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewell.operators.state import Step


def folded_stream(stream: DataFrame, key: str, order: str, needs: list[str], step: Step, result: str, idle_ms: int) -> DataFrame:
    """``key, order, *needs`` and ``result`` for every row of a stream; rows of one micro-batch are taken in the order of ``order``.

    A key's state goes after ``idle_ms`` without a row, so that keys that don't come back take no memory.
    """
    rows = stream.select(*dict.fromkeys([key, order, *needs]))
    names = [part.split()[0] for part in result.split(",")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(_key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        frame = pd.concat(list(frames)).sort_values(order, kind="stable").reset_index(drop=True)
        now, out = (pickle.loads(state.get[0]) if state.exists else None), []
        for values in frame[needs].itertuples(index=False, name=None):
            now, made = step(now, tuple(values))
            out.append(made)
        state.update((pickle.dumps(now),))
        state.setTimeoutDuration(idle_ms)
        yield pd.concat([frame, pd.DataFrame(out, columns=names)], axis=1)

    return rows.groupBy(key).applyInPandasWithState(run, f"{kinds}, {result}", "held binary", "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(stream: DataFrame, ts: str, by: str, width: str, late: str) -> DataFrame:
    """``by, start, n`` per window of ``width``; rows later than ``late`` behind the newest are dropped, and with them old state."""
    counts = stream.withWatermark(ts, late).groupBy(by, F.window(ts, width)).agg(F.count("*").alias("n"))
    return counts.select(by, F.col("window.start").alias("start"), "n")
