"""What the operators of this subpackage share.

Words: A-Z are lower-cased, then a word is a run of characters outside the ASCII
separators (WORD_RX). All bytes of a non-ASCII character are word bytes, so the same
words come from UTF-8 bytes (`byte_words`) and from strings (`words_col`).

Every operator takes the columns it needs from its input by name and works on internal
names, so further columns of any name never clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docloom.sources.shared import new_path as scratch, released, shared_dir, watched, written, written_at  # noqa: F401  for the operators

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_RX = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32
    for b in range(256)
)


def byte_words(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text; none for None."""
    return text.translate(_TABLE).split() if text else []


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words_col(text: Column) -> Column:
    """The words of a string column, an empty array for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def n_words_col(text: Column) -> Column:
    """Number of words: upper-case ASCII letters count as word characters here, which
    gives the same runs as lower-casing first."""
    runs = F.split(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    return F.size(F.array_remove(runs, "")).cast("long")


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts small; a setting made by the caller stays."""
    for key, default, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"),
        ("spark.sql.execution.arrow.maxBytesPerBatch", None, str(32 << 20)),
    ):
        try:
            if default is None or spark.conf.get(key) == default:
                spark.conf.set(key, value)
        except Exception:  # noqa: BLE001  a Spark version without the setting
            continue


def blocks(df: DataFrame, key: str, max_rows: int) -> list[DataFrame]:
    """df cut into parts of about max_rows rows by a hash of key, each fit to be broadcast.
    The number of rows is counted first."""
    n = df.count()
    parts = -(-n // max_rows) or 1
    if parts == 1:
        return [df]
    h = F.pmod(F.xxhash64(key), F.lit(2 * parts))
    return [df.where(h == i) for i in range(2 * parts)]


def map_batches(
    df: DataFrame, fn: Callable, schema: str
) -> DataFrame:
    """mapInArrow over small batches."""
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def components(nodes: DataFrame | None, edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Connected components by contraction: in each round every node takes its smallest
    neighbour as its label, edges are rewritten to labels, and loops and doubles go. A round
    at least halves the nodes of a component that still have edges. Only a count of the
    remaining edges reaches the driver.

    edges: columns a, b (long). Returns node, comp (the smallest node of its component) for
    every node that has an edge to another one.
    """
    spark = edges.sparkSession
    live = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    member = None
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(
            both.groupBy("a").agg(F.min("b").alias("m"))
            .select(F.col("a").alias("node"), F.least("a", "m").alias("to")),
            "labels",
        )
        if member is None:
            member = step.select("node", F.col("to").alias("comp"))
        else:
            member = written(
                member.join(step.select(F.col("node").alias("comp"), "to"), "comp", "left")
                .select("node", F.coalesce("to", "comp").alias("comp")),
                "members",
            )
        s = step.select(F.col("node").alias("a"), F.col("to").alias("x"))
        t = step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        live = written(
            live.join(s, "a").join(t, "b").where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            "edges",
        )
    else:
        raise RuntimeError("components did not settle")
    if member is None:
        return spark.createDataFrame([], "node long, comp long")
    return member
