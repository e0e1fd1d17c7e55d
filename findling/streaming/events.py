"""Windows over events; the same functions take batch and streaming DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _timed(df: DataFrame, ts: str, late: str | None) -> DataFrame:
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, late) if late and df.isStreaming else df


def tumbling_counts(df: DataFrame, ts: str, length: str, by: list[str], value: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Count and sum of ``value`` in tumbling (or sliding) windows; rows later than the watermark drop out of a stream."""
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    grouped = _timed(df, ts, late).groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "total")


def session_counts(df: DataFrame, ts: str, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    """Sessions that end after ``gap`` without an event."""
    grouped = _timed(df, ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return grouped.select(*by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def dedup_within(df: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """Drops repeats of keys that arrive within the watermark's delay."""
    timed = _timed(df, ts, late)
    return timed.dropDuplicatesWithinWatermark(keys) if df.isStreaming else timed.dropDuplicates(keys)


def _add(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, total = state.get if state.exists else (0, 0.0)
    for frame in frames:
        n, total = n + len(frame), total + float(frame["value"].sum())
    state.update((n, total))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})


def stateful_totals(df: DataFrame) -> DataFrame:
    """Running totals of each user, kept as state between micro-batches."""
    return df.select("user_id", "value").groupBy("user_id").applyInPandasWithState(_add, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)
