"""Keyed running balances of an event stream, with the state store's own snapshots."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key long, value long, events long"


def running_balances(events: DataFrame, opening: int) -> DataFrame:
    """``events (key, delta)`` as a stream -> the balance of each key that a micro-batch changes."""

    def step(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        value, n = state.get if state.exists else (opening, 0)
        for p in parts:
            value, n = value + int(p["delta"].sum()), n + len(p)
        state.update((value, n))
        yield pd.DataFrame([(key[0], value, n)], columns=["key", "value", "events"])

    return events.groupBy("key").applyInPandasWithState(step, OUT, "value long, events long", "update", GroupStateTimeout.NoTimeout)


def bucket_stream(events: DataFrame, ts: str, width: str, late: str) -> DataFrame:
    """Counts per time bucket with a watermark; time without zone is taken as the session's."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return e.groupBy(F.window(ts, width)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sliding_stream(events: DataFrame, ts: str, value: str, width: str, slide: str, late: str) -> DataFrame:
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return e.groupBy(F.window(ts, width, slide)).agg(F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), "mean")


def once(replies: DataFrame, ts: str, late: str) -> DataFrame:
    """One reply a request within the watermark."""
    return replies.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(["request_id"])
