"""The rate limit over a stream of requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkspark.operators.limiter import Window, micros


def rate_limit_stream(requests: DataFrame, key: str = "user_id", event: str = "event_id", ts: str = "ts", limit: int = 2, window_seconds: int = 60, lateness: str | None = None) -> DataFrame:
    """Like `rate_limit`, with the window of each key as state.

    With `lateness`, such as "10 minutes", requests may arrive in any order within it: they wait in
    state until the watermark has passed them, are judged in order of time, and a timer removes a
    key's state when its window is over. Later ones are dropped, and requests without a time are let
    through at once. Without `lateness` each request is judged as it comes: within a micro-batch
    they are put in order, across micro-batches they must arrive in order of time, and the state of
    a key stays.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    width = window_seconds * 1_000_000
    if lateness is not None:
        requests = requests.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", lateness)
    extra = ["_at"] if lateness is not None else []
    rows = requests.select(F.col(key).alias("key"), F.col(event).alias("event"), micros(F.col(ts)).alias("us"), *extra)
    kinds = dict(rows.dtypes)

    def step(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        window = Window(limit, width, state.get[0] if state.exists else ())
        pdf = pd.concat(list(batches)).sort_values(["us", "event"])
        limited = [window.limited(us) for us in pdf["us"].tolist()]
        state.update((list(window.times),))
        yield pd.DataFrame({"event": pdf["event"], "key": group[0], "limited": limited})

    def in_order(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        times, us, events = state.get if state.exists else ([], [], [])
        window, waiting = Window(limit, width, times), list(zip(us, events, strict=True))
        timeless = []
        for pdf in () if state.hasTimedOut else batches:
            for t, e in zip(pdf["us"].tolist(), pdf["event"].tolist(), strict=True):
                if pd.isna(t):
                    timeless.append(e)
                else:
                    waiting.append((int(t), e))
        waiting.sort()
        passed = state.getCurrentWatermarkMs() * 1000
        ready = [x for x in waiting if x[0] < passed]
        waiting = waiting[len(ready) :]
        limited = [window.limited(t) for t, _ in ready]
        while window.times and window.times[0] + width <= passed:
            window.times.popleft()
        if waiting or window.times:
            state.update((list(window.times), [t for t, _ in waiting], [e for _, e in waiting]))
            due = min([t for t, _ in waiting[:1]] + [t + width for t in list(window.times)[-1:]])
            state.setTimeoutTimestamp(max(due // 1000 + 1, passed // 1000 + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"event": [e for _, e in ready] + timeless, "key": [group[0]] * (len(ready) + len(timeless)), "limited": limited + [False] * len(timeless)})

    out = f"event {kinds['event']}, key {kinds['key']}, limited boolean"
    if lateness is None:
        done = rows.groupBy("key").applyInPandasWithState(step, out, "times array<bigint>", "append", GroupStateTimeout.NoTimeout)
    else:
        kept = f"times array<bigint>, us array<bigint>, events array<{kinds['event']}>"
        done = rows.groupBy("key").applyInPandasWithState(in_order, out, kept, "append", GroupStateTimeout.EventTimeTimeout)
    return done.select(F.col("event").alias(event), F.col("key").alias(key), "limited")
