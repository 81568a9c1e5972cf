"""Worker loops as streaming queries: what arrives is thinned, worked on and handed to a sink; queues that
drop what does not fit; frames that wait for their words.

A row that cannot be worked on does not end a query: operators give null for it, and `run` hands
on the others. Each batch is handed to the sink once; after a restart from the same checkpoint the
last one may come again, so sinks write by batch number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators.ocr import NO_TEXT

from . import keyed


def queued(events: DataFrame, key: str, size: int, every: str = "1 second", ts: str = "ts", order: str = "event_id", newest: bool = False) -> DataFrame:
    """What queues of `size` places hand on that are emptied at the end of every interval: the first rows of each key and
    interval, or with newest the last ones; the others are dropped."""
    by = [F.desc(ts), F.desc(order)] if newest else [ts, order]
    line = Window.partitionBy(key, F.window(ts, every)).orderBy(*by)
    return events.withColumn("__n", F.row_number().over(line)).where(F.col("__n") <= size).drop("__n")


def recognised(frames: DataFrame, words: DataFrame, key: str, ts: str = "ts", words_ts: str = "said_at", text: str = "text", within: str = "10 seconds", late: str = "10 seconds") -> DataFrame:
    """frames with the text of their row in words, which has the frame's key and comes up to `within` after it; frames without one
    come out once, as NO_TEXT, when the watermarks of both streams have passed their time. Also of batches."""
    f = frames.withWatermark(ts, late)
    w = words.withWatermark(words_ts, late).select(F.col(key).alias("__k"), F.col(words_ts).alias("__at"), F.col(text).alias("__text"))
    near = (F.col(key) == F.col("__k")) & (F.col("__at") >= F.col(ts)) & (F.col("__at") <= F.col(ts) + F.expr(f"interval {within}"))
    return f.join(w, near, "leftOuter").select(*frames.columns, F.coalesce("__text", F.lit(NO_TEXT)).alias("recognised"))


def captured(frames: DataFrame, good: Column) -> DataFrame:
    """Frames that pass the quality test, all of them: capture is not throttled. Null counts as not good."""
    return frames.where(good)


def run(
    frames: DataFrame, work: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str,
    key: str | None = None, ts: str = "ts", tie: str = "event_id", once: bool = True, every: str = "1 second", late: str = "10 seconds",
) -> StreamingQuery:
    """A started query: each micro-batch is worked on and given to the sink with its number. With a
    key only the newest row of each key and interval is taken, as by a worker with a queue of one place that
    looks in at every interval of event time; how files fall into micro-batches does not matter. once: what is there is
    worked on, then the query ends."""
    if key:
        frames = keyed.queued_stream(frames, key, 1, every, ts, tie, late, newest=True)
    writer = frames.writeStream.foreachBatch(lambda batch, number: sink(work(batch), number)).option("checkpointLocation", checkpoint)
    return keyed.started(writer.trigger(availableNow=True) if once else writer)


def batch_folder(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to a folder of its own, over what an earlier try left."""
    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
