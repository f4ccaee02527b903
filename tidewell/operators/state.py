"""Rules that fold over a key's rows in order: limiters, lockouts, codes, smoothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Seconds to wait at least, failures before a lock, tries of a code.
LEAST_WAIT, MOST_FAILURES, MOST_TRIES = 0.1, 5, 5
Step = Callable[[object, tuple], tuple[object, tuple]]


def deal(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by key over as many tasks as the session has shuffle partitions. A fixed number, since steps of few bytes and much work would be put together in few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def folded(df: DataFrame, key: str, order: list[str], needs: list[str], step: Step, result: str, dealt: bool = False) -> DataFrame:
    """``df``'s columns ``key, *order, *needs`` with the columns ``result`` that ``step`` gives for each row.

    ``step(state, needed values)`` returns the new state (None at a key's start) and the row's results. Rows are dealt
    by key, unless they are ``dealt`` already, sorted, and stream through the task: a key with any number of rows takes the memory of its state alone.
    """
    rows = df.select(*dict.fromkeys([key, *order, *needs]))
    rows = (rows if dealt else deal(rows, key)).sortWithinPartitions(key, *order)
    names = [part.split()[0] for part in result.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        for frame in frames:
            out = []
            for k, *values in frame[[key, *needs]].itertuples(index=False, name=None):
                # A null key of a numeric column comes as NaN, which isn't equal to itself.
                if k != now and (k == k or now == now):
                    now, state = k, None
                state, made = step(state, tuple(values))
                out.append(made)
            yield pd.concat([frame.reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{kinds}, {result}")


def limiter(limit: int, window: float) -> Step:
    """Values (t): ``wait`` is 0 for a hit within the limit, else the seconds until the oldest leaves; refused hits aren't kept."""

    def step(state: object, values: tuple) -> tuple[object, tuple]:
        (t,) = values
        hits = [x for x in state or () if t - x < window]
        if limit <= 0:
            return hits, (0.0,)
        if len(hits) >= limit:
            return hits, (max(LEAST_WAIT, window - (t - hits[0])),)
        return [*hits, t], (0.0,)

    return step


def lockout(most: int = MOST_FAILURES, lock: float = 600.0) -> Step:
    """Values (t, right): ``outcome`` ok, failed or locked; the ``most``-th failure in a row locks and starts the count anew."""

    def step(state: object, values: tuple) -> tuple[object, tuple]:
        t, right = values
        failures, until = state or (0, None)
        if until is not None and until > t:
            return (failures, until), ("locked",)
        if right:
            return (0, None), ("ok",)
        failures += 1
        return ((0, t + lock) if failures >= most else (failures, until)), ("failed",)

    return step


def code_check(most: int = MOST_TRIES, lives: float = 600.0, resend: float = 60.0) -> Step:
    """Values (t, kind: send, right, wrong): ``outcome`` sent, wait, ok, wrong or invalid (no code, expired, or no tries left)."""

    def step(state: object, values: tuple) -> tuple[object, tuple]:
        t, kind = values
        if kind == "send":
            if state is not None and t - state[0] < resend:
                return state, ("wait",)
            return (t, 0), ("sent",)
        if state is None or t - state[0] >= lives or state[1] >= most:
            return state, ("invalid",)
        sent, tries = state
        if kind == "right":
            return None, ("ok",)
        return (sent, tries + 1), ("wrong" if tries + 1 < most else "invalid",)

    return step


def smoothing(weight: float, cut: float) -> Step:
    """Values (value): ``soft``, the exponential mean; a change of more than ``cut`` starts anew."""

    def step(state: object, values: tuple) -> tuple[object, tuple]:
        (x,) = values
        soft = x if state is None or abs(x - state[0]) > cut else weight * x + (1 - weight) * state[1]
        return (x, soft), (soft,)

    return step
