"""Exact duplicates by a heavy-hitter split.

Texts are equal when their digests (SHA-256 of the text without ASCII white space) are equal.
A Misra-Gries summary of each partition finds every digest that could be frequent; their exact
sizes and winners are counted, and these verified winners, at most `counters` + 1 rows, are
broadcast, so that rows of frequent digests are decided in the map, without a shuffle. What is
left has no digest with more than 2 n / (counters + 1) rows and goes through an ordinary
shuffle. Only ids, digests and sizes are shuffled: `drop_exact` reads the texts once more and
drops rows in the scan, by the broadcast winners of all groups of two and more where these were
counted to be BROADCAST_ROWS at most; beyond that the light rows are joined to theirs by merge.

Defined cases: a null text counts as empty, so null, empty and all-white texts form one group;
of rows that agree in length and id (repeated rows) exactly one stays; an empty table gives an
empty result; null ids sort first; further columns are ignored by `exact_groups` and kept
unchanged by `drop_exact`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import map_batches, written

#: Counters of a Misra-Gries summary; four for each shuffle partition if these are more.
COUNTERS = 2048
#: Winners of light groups that are broadcast at most.
BROADCAST_ROWS = 200_000
#: The white space that does not count: [\x20\x09-\x0D].
BLANK = "[\\x20\\x09-\\x0D]"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\f\r", "")


def summarise(counts: dict, batch: dict, k: int) -> dict:
    """Misra-Gries summary of two summaries: sums, less the (k + 1)-th largest."""
    for key, n in batch.items():
        counts[key] = counts.get(key, 0) + n
    if len(counts) > k:
        cut = sorted(counts.values(), reverse=True)[k]
        counts = {key: n - cut for key, n in counts.items() if n > cut}
    return counts


def _summaries(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        for batch in batches:
            counted = batch.column(0).value_counts()
            part = dict(zip(counted.field("values").to_pylist(), counted.field("counts").to_pylist(), strict=True))
            counts = summarise(counts, part, k)
        if counts:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                ["digest", "n"],
            )

    return run


def frequent(rows: DataFrame, k: int) -> DataFrame:
    """Every digest that more than 2 n / (k + 1) of the n rows have, and a few others. A
    partition's summary falls short of a true count by n_p / (k + 1) at most, so the sums of
    these digests exceed n / (k + 1); at most k + 1 sums can, as all of them add up to n."""
    n = rows.count()
    sums = map_batches(rows.select("digest"), _summaries(k), "digest binary, n long")
    return sums.groupBy("digest").agg(F.sum("n").alias("n")).where(F.col("n") > n / (k + 1)).select("digest")


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs[text_col]
    return docs.select(
        docs[id_col].alias("id"),
        F.unhex(F.sha2(normalised(text), 256)).alias("digest"),
        F.char_length(F.coalesce(text, F.lit(""))).cast("long").alias("size"),
    )


def _counters(docs: DataFrame, counters: int | None) -> int:
    return counters or max(COUNTERS, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int | None = None
) -> DataFrame:
    """One row per row of docs: id, keep_id (of the row that stays: the longest text, then the
    smallest id), group_size, kept, digest (binary), size (code points)."""
    rows = written(_digests(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "digests")
    hot = F.broadcast(frequent(rows, _counters(docs, counters)))
    order = F.struct((-F.col("size")).alias("s"), F.col("id"), F.col("row"))

    def winners(of: DataFrame) -> DataFrame:
        best = of.groupBy("digest").agg(F.min(order).alias("w"), F.count("*").alias("group_size"))
        return best.select("digest", F.col("w.id").alias("keep_id"), F.col("w.row").alias("keep_row"), "group_size")

    first = written(winners(rows.join(hot, "digest", "left_semi")), "winners")  # at most counters + 1 rows
    light = rows.join(F.broadcast(first.select("digest")), "digest", "left_anti")
    decided = rows.join(F.broadcast(first), "digest").unionByName(light.join(winners(light), "digest"))
    return decided.select("id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest", "size")


def drop_exact(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int | None = None, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """docs without the rows that `exact_groups` drops, with all their columns. Rows that agree
    in id, digest and length count as repeated rows; one of them stays."""
    rows = written(_digests(docs, id_col, text_col), "digests")
    hot = F.broadcast(frequent(rows, _counters(docs, counters)))

    def winners(of: DataFrame) -> DataFrame:
        """Of each group of two and more the id and size of the row that stays and how often it
        is repeated."""
        alike = of.groupBy("digest", "id", "size").agg(F.count("*").alias("same"))
        best = alike.groupBy("digest").agg(F.min(F.struct((-F.col("size")).alias("s"), F.col("id"), F.col("same"))).alias("w"), F.sum("same").alias("n"))
        return best.where("n > 1").select(F.col("digest").alias("__w_digest"), F.col("w.id").alias("__w_id"), (-F.col("w.s")).alias("__w_size"), F.col("w.same").alias("__w_same"))

    first = written(winners(rows.join(hot, "digest", "left_semi")), "winners")
    light = rows.join(F.broadcast(first), F.col("digest") == F.col("__w_digest"), "left_anti")
    others = written(winners(light), "light-winners")
    text = docs[text_col]
    keyed = docs.withColumns({
        "__r_id": docs[id_col],
        "__r_digest": F.unhex(F.sha2(normalised(text), 256)),
        "__r_size": F.char_length(F.coalesce(text, F.lit(""))).cast("long"),
    })

    def tested(of: DataFrame, by: DataFrame) -> DataFrame:
        """of, joined to its winners, without the rows that lose."""
        met = of.join(by, F.col("__r_digest") == F.col("__w_digest"), "left")
        wins = F.col("__r_id").eqNullSafe(F.col("__w_id")) & (F.col("__r_size") == F.col("__w_size"))
        return met.where(F.col("__w_digest").isNull() | wins)

    if others.count() <= broadcast_rows:
        stay = tested(keyed, F.broadcast(first.union(others)))
    else:
        met = tested(keyed, F.broadcast(first))
        rest = met.where("__w_digest is null").drop("__w_digest", "__w_id", "__w_size", "__w_same")
        stay = met.where("__w_digest is not null").unionByName(tested(rest, others.hint("merge")))
    again = F.coalesce(F.col("__w_same"), F.lit(1)) > 1
    repeated = stay.where(again).dropDuplicates(["__r_id", "__r_digest", "__r_size"])
    return stay.where(~again).unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])
