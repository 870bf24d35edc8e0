"""Request limits: :func:`over_limit` takes a batch or a stream, :func:`waits` a batch; :mod:`vellum.streaming.flow` has pacing and history on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Requests a minute of one user, seconds between two requests.
PER_MINUTE, PACE_SECONDS = 60, 0.3


def over_limit(events: DataFrame, limit: int = PER_MINUTE, user: str = "user_id", ts: str = "ts", late: str | None = None) -> DataFrame:
    """(user_id, minute, n) of the minutes in which a user goes over the limit; ``late`` sets a stream's watermark."""
    held = events.withWatermark(ts, late) if late else events
    counts = held.groupBy(F.window(ts, "1 minute"), F.col(user)).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > limit).select(F.col(user), F.col("window.start").alias("minute"), "n")


def waits(events: DataFrame, user: str = "user_id", ts: str = "ts", pace: float = PACE_SECONDS, tie: str = "event_id") -> DataFrame:
    """Add wait: whether less than the pace has gone since the user's request before; of requests at one time ``tie`` says which comes first."""
    before = F.lag(ts).over(Window.partitionBy(user).orderBy(ts, tie))
    return events.withColumn("wait", F.coalesce(F.timestamp_diff("MICROSECOND", before, F.col(ts)) < int(pace * 1_000_000), F.lit(False)))
