"""Structured Streaming counterparts of the event operators. Event time is the time of availability."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..functions.scalar import sentiment_score


def event_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files as they arrive; with a checkpoint each is read once, so batches resume where they stopped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def available_at(events: DataFrame, cutoff_hour: int = 15) -> DataFrame:
    """available_time: publication, or the next day's start if published after the cut-off."""
    late = F.hour("publish_time") >= cutoff_hour
    return events.withColumn("available_time", F.when(late, F.date_trunc("day", F.col("publish_time") + F.expr("interval 1 day"))).otherwise(F.col("publish_time")))


def sliding_sentiment(events: DataFrame, days: int = 20, late: str = "2 days") -> DataFrame:
    """Sum of score * confidence by asset over windows of days + 1 days that slide by one; rows beyond the watermark are dropped."""
    scored = events.withColumn("score", sentiment_score("sentiment", F.col("confidence")))
    g = scored.withWatermark("available_time", late).groupBy("stock_code", F.window("available_time", f"{days + 1} days", "1 day").alias("w"))
    return g.agg(F.sum("score").alias("event_sentiment"), F.count("*").alias("event_count")).select("stock_code", F.col("w.end").alias("window_end"), "event_sentiment", "event_count")


def first_arrivals(events: DataFrame, keys: list[str], late: str = "7 days") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark("available_time", late).dropDuplicatesWithinWatermark(keys)


STATE = "level double, variance double, n bigint, last timestamp"
OUT = "series string, at timestamp, value double, forecast double, variance double, accepted boolean"


def kalman_step(q: float, r: float):
    """The stateful function of one series: rows not later than the state's time are refused, others update a local level.

    A series' rows of a trigger may come in several batches in any order, so they are put in order together.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, variance, n, last = state.get if state.exists else (None, 10 * r, 0, None)
        out = []
        for at, x in pd.concat([b[["at", "value"]] for b in batches]).sort_values("at", kind="stable").itertuples(index=False):
            ok = not pd.isna(at) and (last is None or at > last)
            if ok:
                prior = variance + q
                gain = prior / (prior + r)
                level = x if level is None else level
                level, variance, n, last = level + gain * (x - level), (1 - gain) * prior, n + 1, at
            out.append((key[0], at, x, level, variance + q + r, ok))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])
        state.update((level, variance, n, last))

    return step


def online_forecasts(values: DataFrame, q: float = 0.001, r: float = 0.01) -> DataFrame:
    """Keyed local-level forecasts of a stream (series, at, value)."""
    return values.groupBy("series").applyInPandasWithState(kalman_step(q, r), OUT, STATE, "append", GroupStateTimeout.NoTimeout)
