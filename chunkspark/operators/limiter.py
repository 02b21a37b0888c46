"""Keyed sliding-window rate limits over a table of requests."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


class Window:
    """Times let through of one key: the state of a sliding window."""

    def __init__(self, limit: int, width: int, times=()):
        self.limit, self.width, self.times = limit, width, deque(times)

    def limited(self, now: int) -> bool:
        """Whether a request at `now` is rejected; if not it is recorded. One without a time is let through and not recorded."""
        if pd.isna(now):
            return False
        while self.times and now - self.times[0] >= self.width:
            self.times.popleft()
        if len(self.times) >= self.limit:
            return True
        self.times.append(now)
        return False


def rate_limit(requests: DataFrame, key: str = "user_id", event: str = "event_id", ts: str = "ts", limit: int = 2, window_seconds: int = 60) -> DataFrame:
    """event, key, limited per request: rejected if `limit` requests of its key were let through in the window before it.

    A rejected request isn't recorded. One at exactly the window's length has expired. Requests of
    a key at one time go by event id. Those without a time are let through and take no place in a
    window. Keys are sorted by time in their partition and folded as
    they stream by, so a task holds one window and not a key's requests.
    """
    done = _folded(requests, key, event, ts, limit, window_seconds)
    return done.select(F.col("event").alias(event), F.col("key").alias(key), "limited")


def _folded(requests: DataFrame, key: str, event: str, ts: str, limit: int, window_seconds: int) -> DataFrame:
    """event, key, us, limited per request."""
    width = window_seconds * 1_000_000

    def fold(batches):
        own, window = object(), None
        for pdf in batches:
            out = []
            for k, us in zip(pdf["key"], pdf["us"], strict=True):
                if k != own and not (pd.isna(k) and own is None):
                    own, window = None if pd.isna(k) else k, Window(limit, width)
                out.append(window.limited(us))
            yield pdf.assign(limited=out)

    rows = requests.select(F.col(event).alias("event"), F.col(key).alias("key"), micros(F.col(ts)).alias("us"))
    kinds = dict(rows.dtypes)
    ordered = rows.repartition("key").sortWithinPartitions("key", "us", "event")
    return ordered.mapInPandas(fold, f"event {kinds['event']}, key {kinds['key']}, us bigint, limited boolean")


def remaining(requests: DataFrame, now: Column, key: str = "user_id", event: str = "event_id", ts: str = "ts", limit: int = 2, window_seconds: int = 60) -> DataFrame:
    """key, seconds until the oldest recorded request of the key's window expires at `now`; 0 if there is none.

    One shuffle, by key: the times come from the fold, and counts by key keep its partitioning.
    """
    age = (micros(now) - F.col("us")) / 1_000_000
    live = ~F.col("limited") & (age >= 0) & (age < window_seconds)
    oldest = _folded(requests, key, event, ts, limit, window_seconds).groupBy("key").agg(F.max(F.when(live, age)).alias("age"))
    left = F.greatest(F.lit(0.0), F.coalesce(F.lit(float(window_seconds)) - F.col("age"), F.lit(0.0)))
    return oldest.select(F.col("key").alias(key), left.alias("seconds"))
