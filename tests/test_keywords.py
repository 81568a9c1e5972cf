import random
import statistics

from pyspark.sql import functions as F

from docloom.functions import rx
from docloom.operators import classify, keywords, text as tx


def test_scores_equal_the_patterns(spark):
    rng = random.Random(2)
    words = [w for k in rx.KEYWORDS.values() for w in k] + ["Credit", "card", "ID", "Number", "é", "nameé", "ſign", "x_date", "total2", "Tax's"]
    texts = [(i, "".join(rng.choice(words).title() if rng.random() < 0.2 else rng.choice(words) for _ in range(1)) + "".join(rng.choice([" ", " ", "  ", "\n", ", ", "-", ""]) + rng.choice(words) for _ in range(rng.randrange(30)))) for i in range(400)]
    docs = spark.createDataFrame([*texts, (900, None), (901, ""), (902, " .")], "doc_id long, text string")
    got = {(r.id, r.kind): r.score for r in keywords.scores(docs, keywords.table_of(spark, rx.KEYWORDS)).collect()}
    plain = docs.select("doc_id", *[s.alias(k) for k, s in tx.type_scores(F.col("text")).items()]).collect()
    assert got == {(r.doc_id, k): r[k] for r in plain for k in rx.KEYWORDS if r[k]}
    kinds = {r.id: r.doc_type for r in keywords.types(docs, keywords.table_of(spark, rx.KEYWORDS), list(rx.KEYWORDS), "text_document").collect()}
    assert all(kinds.get(r.doc_id, "text_document") == r.t for r in docs.select("doc_id", tx.doc_type(F.col("text")).alias("t")).collect())


def test_overlapping_keywords_and_large_tables(spark, monkeypatch):
    lists = {"a": ("b c", "a b", "b", "a b c d"), "n": ("a b c d", "a b", "d")}
    docs = spark.createDataFrame([(1, "a b c d b c"), (2, "A  b C d"), (3, "d d,d")], "doc_id long, text string")
    want = {(1, "a"): 2, (1, "n"): 1, (2, "a"): 1, (2, "n"): 1, (3, "n"): 3}
    assert {(r.id, r.kind): r.score for r in keywords.scores(docs, keywords.table_of(spark, lists)).collect()} == want
    many = spark.range(100_000).select((F.col("id") % 7).cast("string").alias("kind"), F.concat(F.lit("w"), "id").alias("keyword"), F.col("id").cast("int").alias("rank"))
    texts = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit("w"), F.col("id") * k) for k in range(1, 9)]).alias("text"))
    sums = []
    for limit in (500_000, 10):
        monkeypatch.setattr(keywords, "BROADCAST_ROWS", limit)
        sums.append(keywords.scores(texts, many).agg(F.sum("score")).first()[0])
    assert sums == [8 * 300, 8 * 300]
    assert keywords.scores(texts, many.limit(0)).count() == 0 and keywords.scores(texts.limit(0), many).count() == 0


def test_median_is_exact_and_its_bracket_small(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, rng.random(), float(rng.randrange(3))])) for k in [None, *"abcdefgh"] for _ in range(rng.randrange(1, 400))] + [("one", 5.0), ("none", None), ("same", 2.0), ("same", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    want = {}
    for k, v in rows:
        if v is not None:
            want.setdefault(k, []).append(v)
    for accuracy in (10_000, 50, 4):
        got = {r.k: r["median"] for r in classify.exact_median(df, "k", "v", accuracy).collect()}
        assert got == {k: statistics.median(v) for k, v in want.items()}
    got = {r.k: (r.raw, r.angle) for r in classify.median_angle(df.withColumn("v", F.col("v") * 100), "k", "v").collect()}
    assert got["none"] == (None, None) and got["same"] == (200.0, 200.0) and len(got) == 12
    many = spark.range(300_000).select(F.lit(1).alias("k"), F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("v"))
    assert classify.exact_median(many, "k", "v").first()["median"] == many.select(F.percentile("v", 0.5)).first()[0]
