"""Operators on event streams: rates, throttle, debounce, latest sample, last value.

Batch forms; `keyed` has the streaming ones of throttle, debounce, queue and last value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docloom.operators import scan

from . import links


def rate(events: DataFrame, ts: str = "ts", every: str = "1 second", late: str | None = None) -> DataFrame:
    """start, n: events in tumbling windows. `late` sets a watermark, for streams."""
    events = events.withWatermark(ts, late) if late else events
    return events.groupBy(F.window(ts, every).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def throttled(events: DataFrame, key: str, gap: float = 2.0, inclusive: bool = False, ts: str = "ts", order: str | None = None) -> DataFrame:
    """Greedy minimum gap for each key: a row passes if it comes more than gap seconds (or at
    least gap, if inclusive) after the last one that passed."""
    return links.spaced(events, key, gap, inclusive, ts, [order] if order else [])


def debounced(events: DataFrame, key: str, gap: float = 1.0, ts: str = "ts", order: str | None = None) -> DataFrame:
    return throttled(events, key, gap, True, ts, order)


def latest_sample(events: DataFrame, key: str, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The newest row of each key: what a queue of one place holds."""
    cols = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(ts, tie)).alias("r")).select(key, "r.*")


def last_value(events: DataFrame, key: str, value: str, order: list[str], ignore_nulls: bool = True) -> DataFrame:
    """events with `held`: the last value so far, nulls skipped or not."""
    if not ignore_nulls:
        return events.withColumn("held", F.col(value))
    return scan.running_last(events, [key], order, F.col(value), "held")
