"""Greedy minimum gaps by linked rows: no task walks through a key.

Every row is linked to the first row of its key that comes more than the gap after it, by an as-of search
over ranges. The rows that pass are those on the chain of links that begins at a key's first row. In each
round the marked rows mark those that their links lead to, and links are joined to links, so
that they reach twice as far: a chain of n rows takes log2 n rounds of two joins of number pairs, whatever
key it belongs to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from docloom.operators import scan
from docloom.sources.shared import dropped, new_path, written


def _next(times: DataFrame, reach: int) -> DataFrame:
    """i, j: j the first row whose time is at least reach microseconds after that of i."""
    # read backwards: at one time rows come before questions, and of rows the first comes last
    data = times.select("k", (-F.col("t")).alias("a"), F.lit(0).alias("s"), (-F.col("i")).alias("b"), F.col("i").alias("j"), F.lit(None).cast("long").alias("i"))
    asked = times.select("k", (-F.col("t") - reach).alias("a"), F.lit(1).alias("s"), (-F.col("i")).alias("b"), F.lit(None).cast("long").alias("j"), "i")
    found = scan.running_last(data.unionByName(asked), ["k"], ["a", "s", "b"], F.col("j"), "to")
    return found.where("i is not null and to is not null").select("i", F.col("to").alias("j"))


def marked(first: DataFrame, links: DataFrame) -> DataFrame:
    """i of the rows on the chains of links (i, j) that begin at the rows of first (i). A round is one job: it writes what the marked rows
    lead to (kind 0) and the links of twice the reach (kind 1), and counts the former. The marked rows are the union of all rounds'."""
    spark = first.sparkSession
    shape = "i long, j long, kind int"
    marks = lambda rows: rows.select("i", F.lit(None).cast("long").alias("j"), F.lit(0).alias("kind"))
    rows, on, path = marks(first).union(links.select("i", "j", F.lit(1).alias("kind"))), None, None
    while True:
        told, at = Observation(), new_path(spark, "round")
        rows.observe(told, F.count(F.when(F.col("kind") == 0, 1)).alias("n")).write.partitionBy("kind").parquet(at)
        if path is not None:
            dropped(spark, f"{path}/kind=1")
        if not told.get["n"] and on is not None:
            dropped(spark, at)
            return on
        path, done = at, spark.read.schema(shape).parquet(at)
        new, jump = done.where("kind = 0").select("i"), done.where("kind = 1").select("i", "j")
        on = new if on is None else on.union(new)
        step = jump.join(jump.select(F.col("i").alias("j"), F.col("j").alias("to")), "j").select("i", F.col("to").alias("j"), F.lit(1).alias("kind"))
        rows = marks(on.join(jump, "i").select(F.col("j").alias("i"))).union(step)


def spaced(rows: DataFrame, key: str, gap: float, inclusive: bool, ts: str, order: list[str]) -> DataFrame:
    """The rows of each key that come more than gap seconds (or at least gap, if inclusive) after the
    last one that stays, the first one among them; rows of one time in the given order. Rows without a time go."""
    reach = round(gap * 1_000_000) + (not inclusive)
    timed = rows.where(F.col(ts).isNotNull())
    if reach <= 0:
        return timed
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [key, ts, *order]
    placed = timed.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("__i", F.monotonically_increasing_id())
    placed = written(placed, "rows")
    times = placed.select(F.col(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col("__i").alias("i"))
    first = times.groupBy("k").agg(F.min("i").alias("i")).select("i")
    on = marked(first, _next(times, reach))
    return placed.join(on.select(F.col("i").alias("__i")), "__i", "left_semi").select(*rows.columns)
