"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised at equal-frequency edges, a row's cells give its
index on the Hilbert curve, and rows sorted by (index, id) are cut into runs whose row counts
differ by one at most (law "rows"). Rows of a shard are then near in every dimension, so the
minimum and maximum that a file keeps of each dimension prune reads by any of them. A string
dimension is the place of the whole value in the order of all different values.

Ranks: rows are range-partitioned and sorted; a row's place in its partition is known where it
is sorted, and the driver adds up one count per partition. The sort key ends with the id and a
checksum, so one crowded cell is spread over many partitions.

Defined cases: a null text has no bytes; a null tag counts as an empty one, in the lowest cell, as does an id that is
null or no number; a tag column that is not there is no dimension; equal rows take neighbouring places in any order; with fewer rows than shards the last shards are empty;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import written

#: Bits kept of each dimension.
BITS = 8
#: Up to so many different tags are broadcast; more are joined.
SMALL = 10_000
_INDEX = (1 << 33) - 1


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of rows of `cells` (n by d, below 2**bits). Gray-code walk
    from the top bit down: reflect or exchange the lower bits by what the upper bit says, then
    undo the Gray code and interleave."""
    x = cells.astype(np.uint64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        low, bit = np.uint64((1 << level) - 1), np.uint64(level)
        for d in range(dims):
            up = (x[d] >> bit) & np.uint64(1) == 1
            swap = np.where(up, np.uint64(0), (x[0] ^ x[d]) & low)
            x[0] ^= np.where(up, low, swap)
            x[d] ^= swap if d else np.uint64(0)
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    fix = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        fix ^= np.where((x[-1] >> np.uint64(level)) & np.uint64(1) == 1, np.uint64((1 << level) - 1), np.uint64(0))
    x ^= fix
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            out = (out << np.uint64(1)) | ((x[d] >> np.uint64(level)) & np.uint64(1))
    return out.astype(np.int64)


def curve(df: DataFrame, dims: Sequence[str], bits: int = BITS) -> DataFrame:
    """df with `cell_<dim>` for each numeric column of dims and `hilbert`. The edges come from
    one mergeable quantile sketch over all rows, 2**bits - 1 numbers a dimension."""
    marks = [i / (1 << bits) for i in range(1, 1 << bits)]
    sketch = df.agg(*[F.percentile_approx(F.col(d).cast("double"), marks, 20_000).alias(d) for d in dims]).first()
    edges = [np.unique(np.array(sketch[d] or [], dtype=float)) for d in dims]
    top = (1 << bits) - 1  # a dimension of few values is spread over all cells, so that it counts in the high bits

    @F.pandas_udf("array<long>")
    def place(*cols: pd.Series) -> pd.Series:
        cells = np.stack([
            np.searchsorted(e, c.fillna(-np.inf).to_numpy(float), side="right") * top // len(e) if len(e) else np.zeros(len(c), int)
            for e, c in zip(edges, cols, strict=True)
        ], axis=1)
        return pd.Series(list(np.column_stack([cells, hilbert_index(cells, bits)])))

    placed = df.withColumn("__at", place(*[F.col(d).cast("double") for d in dims]))
    return placed.withColumns(
        {f"cell_{d}": F.col("__at")[i] for i, d in enumerate(dims)} | {"hilbert": F.col("__at")[len(dims)]}
    ).drop("__at")


def ranked(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, int]:
    """df with `rank`, its place from 0 in the order of keys, and the number of rows."""
    spark = df.sparkSession
    placed = written(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__m", F.monotonically_increasing_id()),
        "ranked",
    )
    part = F.shiftright("__m", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # one a partition
    total, offsets = 0, []
    for r in counts:
        offsets.append((r["part"], total))
        total += r["n"]
    at = spark.createDataFrame(offsets, "__part long, __offset long")
    out = (
        placed.withColumn("__part", part).join(F.broadcast(at), "__part")
        .withColumn("rank", F.col("__offset") + F.col("__m").bitwiseAND(F.lit(_INDEX)))
        .drop("__m", "__part", "__offset")
    )
    return out, total


def with_order(df: DataFrame, values: DataFrame, tag: str, name: str) -> DataFrame:
    """df with `name`, the place of its whole tag in the order of the different tags of values."""
    order, n = ranked(values.select(tag).distinct(), [tag])
    order = order.select(tag, F.col("rank").cast("double").alias(name))
    return df.join(F.broadcast(order) if n <= SMALL else order, tag)


def cut_rows(df: DataFrame, total: int, shards: int) -> DataFrame:
    """shard and slot by `rank`: the first total % shards shards hold one row more."""
    size, more = divmod(total, shards)
    rank, head = F.col("rank"), more * (size + 1)
    rest = rank - F.lit(head)
    full = rank < head
    return df.withColumns({
        "shard": F.when(full, F.floor(rank / (size + 1))).otherwise(more + F.floor(rest / max(size, 1))).cast("int"),
        "slot": F.when(full, rank % (size + 1)).otherwise(rest % max(size, 1)).cast("long"),
    })


def hilbert_shards(
    docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
    tags: Sequence[str] = ("lang", "source"), bits: int = BITS,
) -> DataFrame:
    """One row per row of docs: id, size, text_crc32, dimensions, cells, hilbert, rank, shard,
    slot. Dimensions: the text's bytes, those columns of `tags` that there are, as strings, the id."""
    text = F.coalesce(docs[text_col], F.lit(""))
    tags = [t for t in tags if t in docs.columns]
    rows = docs.select(
        docs[id_col].alias("id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *[F.coalesce(docs[t].cast("string"), F.lit("")).alias(f"tag_{t}") for t in tags],
    ).withColumns({"dim_size": F.col("size").cast("double"), "dim_id": F.col("id").try_cast("double")})
    dims = ["dim_size", *[f"dim_{t}" for t in tags], "dim_id"]
    meta = written(rows, "meta")
    places = meta
    for t in tags:
        places = with_order(places, meta, f"tag_{t}", f"dim_{t}")
    places = places.drop(*[f"tag_{t}" for t in tags])
    placed, total = ranked(curve(places, dims, bits), ["hilbert", "id", "text_crc32"])
    return cut_rows(placed, total, shards)


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Writes docs as Parquet, one folder a shard, rows in curve order. Ids must be unique."""
    at = assigned.select(F.col("id").alias("__sid"), F.col("shard"), F.col("slot"))
    (docs.join(at, F.col(id_col) == F.col("__sid")).drop("__sid")
     .repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.mode("overwrite").partitionBy("shard").parquet(path))
