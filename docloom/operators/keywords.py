"""Scores of texts by keyword tables of any size.

A table has rows (kind, keyword, rank). A text's words and the single spaces between them make n-grams, one for each number of
words that some keyword has; these are joined with the table, which is broadcast only where it was counted to be small. What is
counted is what the pattern of all keywords of a kind, in the order of their ranks, between word boundaries and without regard to case would
find: from the left, at each place the keyword of the smallest rank, none inside another.

Nulls: a null text has no words; null keywords and kinds match nothing; a keyword that is not words with single
spaces between matches nothing. Texts with equal ids are told apart by a hash of the text and score the same where both agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows of a keyword table that is broadcast at most.
BROADCAST_ROWS = 500_000


def folded(c: Column) -> Column:
    """Lower case, with the letters that only Unicode folds as plain ones."""
    return F.lower(F.translate(c, "ſıİK", "siik"))


def table_of(spark: SparkSession, lists: dict[str, tuple[str, ...]]) -> DataFrame:
    rows = [(kind, word, i) for kind, words in lists.items() for i, word in enumerate(words)]
    return spark.createDataFrame(rows, "kind string, keyword string, rank int")


def grams(docs: DataFrame, sizes: list[int], id_col: str, text_col: str) -> DataFrame:
    """id, h, at, size, gram: runs of so many words with single spaces between, at: number of the first word."""
    runs = F.regexp_extract_all(F.coalesce(docs[text_col], F.lit("")), F.lit(r"(?U)\w+|\W+"), F.lit(0))
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("h"), runs.alias("runs"))
    # words stand at every other place, from the first or the second
    first = F.when(F.rlike(F.get("runs", F.lit(0)), F.lit(r"(?U)\A\w")), F.lit(0)).otherwise(F.lit(1))
    n_words = F.floor((F.size("runs") - F.col("first") + 1) / 2).cast("int")
    rows = rows.withColumn("first", first).withColumn("n", n_words).where("n > 0")
    parts = []
    for size in sizes:
        spans = F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - size, F.lit(0))), lambda at: F.struct(at.alias("at"), F.array_join(F.slice(F.col("runs"), F.col("first") + 1 + 2 * at, 2 * size - 1), "").alias("gram")))
        some = F.when(F.col("n") >= size, spans).otherwise(F.array().cast("array<struct<at:int,gram:string>>"))
        parts.append(rows.select("id", "h", F.explode(some).alias("g")).select("id", "h", "g.at", F.lit(size).alias("size"), folded(F.col("g.gram")).alias("gram")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _left_to_right(found: Column) -> Column:
    """How many of the (at, rank, size) are taken from the left, none inside another."""
    start = F.struct(F.lit(0).alias("free"), F.lit(0).cast("long").alias("n"))
    take = lambda s, x: F.when(x["at"] >= s["free"], F.struct((x["at"] + x["size"]).alias("free"), (s["n"] + 1).alias("n"))).otherwise(s)
    return F.aggregate(F.array_sort(found), start, take, lambda s: s["n"])


def scores(docs: DataFrame, keywords: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, kind, score of every kind that a text has keywords of; once for rows that agree in id and text."""
    known = keywords.where("kind is not null and keyword is not null").select("kind", folded(F.col("keyword")).alias("gram"), F.col("rank"))
    known = known.groupBy("kind", "gram").agg(F.min("rank").alias("rank")).withColumn("size", F.size(F.split("gram", " ", -1)))
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())  # a few numbers
    if not sizes:
        return docs.select(docs[id_col].alias("id"), F.lit("").alias("kind"), F.lit(0).cast("long").alias("score")).limit(0)
    few = known.count() <= BROADCAST_ROWS
    met = grams(docs, sizes, id_col, text_col).join(F.broadcast(known) if few else known, ["gram", "size"])
    found = met.groupBy("id", "h", "kind").agg(F.collect_set(F.struct("at", "rank", "size")).alias("found"))
    return found.select("id", "kind", _left_to_right(F.col("found")).alias("score"))


def types(docs: DataFrame, keywords: DataFrame, order: list[str], default: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, doc_type of texts with keywords of some kind: the kind of the largest score, ties to the earlier in order. Other texts have no row; they
    are of the default type."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("kind"))
    best = F.max_by("kind", F.struct("score", -place))
    return scores(docs, keywords, id_col, text_col).groupBy("id").agg(F.coalesce(best, F.lit(default)).alias("doc_type"))
