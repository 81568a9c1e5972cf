"""Running values in the order of a key's rows, without a task that holds a whole key.

Rows are dealt by ranges of key and order, so that a key of any size lies in several parts; each part
is scanned by itself, and what a key brings from the parts before is carried over from one
total for each part and key. At most one key of a part began before it, so no more totals than parts are carried, and
these are broadcast. The dealt rows are written to the shared folder: parts must not change
between the passes, and a lost executor costs one part.

Nulls: a null key is a key; null orders come first; null values count nothing in a sum and are
passed over by `last`. Rows that agree in key and order stay in one part, in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docloom.sources.shared import written

PART = "__part"


def dealt(rows: DataFrame, key: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """rows with the number of their part, written."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(n, *key, *order).withColumn(PART, F.spark_partition_id()), "ranges")


def _before(totals: DataFrame, key: list[str], carries: dict[str, Column]) -> DataFrame:
    """What each part of a key finds: the carries over the key's earlier parts, for parts that have some."""
    w = Window.partitionBy(*key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    seen = totals.withColumns({n: c.over(w) for n, c in carries.items()} | {"__some": F.count(F.lit(1)).over(w) > 0})
    return seen.where("__some").select(PART, *key, *carries)


def _joined(rows: DataFrame, before: DataFrame, key: list[str]) -> DataFrame:
    """rows with the carried columns; before has a row for each part at most."""
    names = [PART, *key]
    b = before.withColumnsRenamed({n: f"__b_{n}" for n in names})
    on = [rows[n].eqNullSafe(b[f"__b_{n}"]) for n in names]
    return rows.join(F.broadcast(b), on, "left").drop(*[f"__b_{n}" for n in names])


def _local(key: list[str], order: list[str]) -> Window:
    return Window.partitionBy(PART, *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def running_sum(rows: DataFrame, key: list[str], order: list[str], value: Column, out: str, parts: int | None = None) -> DataFrame:
    """rows with the sum of value over the key's rows so far."""
    placed = dealt(rows.withColumn("__v", value), key, order, parts)
    totals = placed.groupBy(PART, *key).agg(F.sum("__v").alias("__t"))
    before = _before(totals, key, {"__c": F.sum("__t")})
    local = placed.withColumn(out, F.sum("__v").over(_local(key, order)))
    return _joined(local, before, key).withColumn(out, F.when(F.col("__c").isNull(), F.col(out)).otherwise(F.coalesce(F.col(out), F.lit(0)) + F.col("__c"))).drop("__c", "__v", PART)


def running_last(rows: DataFrame, key: list[str], order: list[str], value: Column, out: str, parts: int | None = None) -> DataFrame:
    """rows with the last value so far that is not null."""
    placed = dealt(rows.withColumn("__v", value), key, order, parts)
    newest = F.max(F.when(F.col("__v").isNotNull(), F.struct(*[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)], "__v")))
    totals = placed.groupBy(PART, *key).agg(newest["__v"].alias("__t"))
    before = _before(totals, key, {"__c": F.last("__t", ignorenulls=True)})
    local = placed.withColumn(out, F.last("__v", ignorenulls=True).over(_local(key, order)))
    return _joined(local, before, key).withColumn(out, F.coalesce(out, "__c")).drop("__c", "__v", PART)


def runs(rows: DataFrame, key: list[str], order: list[str], value: str, starts: callable, out: str, chunk: Column) -> DataFrame:
    """rows with the number of their run in the key: a new run begins where starts(value, value of the row
    before) holds, null counts as no. chunk: a column that grows with the order and bounds how many
    rows one task takes of a key, such as a place divided by a constant; rows of one chunk lie together."""
    placed = rows.withColumn(PART, chunk)
    line = Window.partitionBy(*key, PART).orderBy(*order)
    begin = lambda now, before: F.coalesce(starts(now, before).cast("long"), F.lit(0))
    jumped = placed.withColumn("__j", begin(F.col(value), F.lag(value).over(line)))
    local = jumped.withColumn(out, F.sum("__j").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct(*order)
    totals = jumped.groupBy(*key, PART).agg(F.sum("__j").alias("__n"), F.min_by(value, at).alias("__first"), F.max_by(value, at).alias("__last"))
    w = Window.partitionBy(*key).orderBy(PART)
    met = totals.withColumn("__b", begin(F.col("__first"), F.lag("__last").over(w)))
    offset = F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = met.select(*key, PART, offset.alias("__c")).where("__c > 0")
    names = [*key, PART]
    b = before.withColumnsRenamed({n: f"__b_{n}" for n in names})
    joined = local.join(b, [local[n].eqNullSafe(b[f"__b_{n}"]) for n in names], "left").drop(*[f"__b_{n}" for n in names])
    return joined.withColumn(out, F.col(out) + F.coalesce("__c", F.lit(0))).drop("__c", "__j", PART)


def asof(left: DataFrame, right: DataFrame, key: str, ts: str, values: list[str], tie: str, left_order: str, within: float | None = None, parts: int | None = None) -> DataFrame:
    """left with the values of the last row of right that has its key and is not newer (equal times count; of
    right rows of one time that of the largest tie), and with `found_ts`, its time. within: seconds after
    which a right row is forgotten. Null where there is none; left rows without a time find none."""
    held = F.struct(F.col(ts).alias("found_ts"), *values)
    kind = left.schema[left_order].dataType
    r = right.where(F.col(ts).isNotNull()).select(F.col(key).alias("__k"), F.col(ts).alias("__t"), F.lit(0).alias("__s"), F.col(tie).cast(kind).alias("__o"), held.alias("__r"))
    rows = left.select(F.col(key).alias("__k"), F.col(ts).alias("__t"), F.lit(1).alias("__s"), F.col(left_order).alias("__o"), F.struct(*left.columns).alias("__l"))
    both = rows.unionByName(r, allowMissingColumns=True)
    out = running_last(both, ["__k"], ["__t", "__s", "__o"], F.col("__r"), "__h", parts).where("__s = 1")
    fresh = F.col("__h.found_ts") >= F.col("__t") - F.make_dt_interval(secs=F.lit(within)) if within is not None else F.lit(True)
    return out.select("__l.*", *[F.when(fresh & F.col("__t").isNotNull(), F.col(f"__h.{n}")).alias(n) for n in ("found_ts", *values)])
