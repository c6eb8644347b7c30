"""Profiles of users kept as state that ends: counts, kinds and last values of a user until it has been idle for long enough.

State is one value a user (count, sum, last time, rows by kind, last values), read and written once a batch, as each call goes
from Python to the JVM and back. An event-time timer is set
to the last row's time plus the idle span; when the watermark passes it, the profile is given out and all its state is
deleted. So the state holds the users of the last idle span and the lateness allowed, not all that ever were.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .traces import LATE

PROFILE = "user_id long, n long, total double, kinds string, last_values string, until timestamp"
LAST = 3
#: The state store that these operators need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Profile(StatefulProcessor):
    def __init__(self, idle_micros: int):
        self.idle = idle_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "n long, total double, until long, kinds map<string,long>, last array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Stretches that end within the batch are given out at once; only the open one goes into the state, once a batch."""
        new = [row for part in rows for row in zip(part["ts"].astype("datetime64[us]").astype("int64").tolist(), part["event_id"].tolist(), part["event_type"].tolist(), part["value"].tolist(), strict=True)]
        new.sort(key=lambda row: row[:2])
        before = self.open.get() if self.open.exists() else None
        n, total, until, kinds, last = (before[0], before[1], before[2], dict(before[3]), list(before[4])) if before else (0, 0.0, None, {}, [])
        ended, latest = [], until
        for at, _, kind, value in new:
            # A stretch ends where a row comes more than the idle span after the one before, in the state or in this batch.
            if until is not None and at - latest > self.idle:
                ended.append(profile(key[0], n, total, until, kinds, last))
                n, total, until, kinds, last = 0, 0.0, None, {}, []
            n, latest, until = n + 1, at, at if until is None else max(until, at)
            kinds[kind] = kinds.get(kind, 0) + 1
            if value is not None and not math.isnan(value):
                total += value
                last = [*last, float(value)][-LAST:]
        self.open.update((n, total, until, kinds, last))
        if before:
            self.handle.deleteTimer(self.due(before[2]))
        self.handle.registerTimer(self.due(until))
        if ended:
            yield pd.DataFrame(ended, columns=COLUMNS)

    def due(self, until: int) -> int:
        return -(-(until + self.idle) // 1000)  # milliseconds, up

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The profile that the state holds; the state is empty afterwards."""
        if self.open.exists():
            n, total, until, kinds, last = self.open.get()
            self.open.clear()
            yield pd.DataFrame([profile(key[0], n, total, until, dict(kinds), last)], columns=COLUMNS)

    def close(self) -> None:
        pass


COLUMNS = ["user_id", "n", "total", "kinds", "last_values", "until"]


def profile(user: int, n: int, total: float, until: int, kinds: dict, last: list) -> tuple:
    return user, n, total, ",".join(f"{k}:{v}" for k, v in sorted(kinds.items())), ",".join(f"{v:g}" for v in last), pd.Timestamp(until, unit="us")


def profiles(events: DataFrame, idle_hours: float = 24) -> DataFrame:
    """user_id, n, total, kinds, last_values, until: a row for each stretch of a user's events, once it has been idle for idle_hours. A stream alone; the session needs PROVIDER."""
    rows = events.where("user_id is not null and ts is not null").select("user_id", "event_id", "ts", "event_type", F.col("value").cast("double").alias("value")).fillna("none", ["event_type"])
    return rows.withWatermark("ts", LATE).groupBy("user_id").transformWithStateInPandas(statefulProcessor=Profile(int(idle_hours * 3_600_000_000)), outputStructType=PROFILE, outputMode="append", timeMode="eventTime")
