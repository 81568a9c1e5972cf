import random

from pyspark.sql import functions as F

from docloom.llm import decontaminate

from . import cases


def items(spark):
    rng = random.Random(3)
    t = cases.texts()
    w = t[30].split(" ")
    return spark.createDataFrame(
        [(1, " ".join(w[5:40])), (2, "one"), (3, None), (4, "!!"), (5, cases.prose(rng, 30)), (6, " ".join(w[20:31]).upper() + " other words here"),
         (7, "one"), (8, "ab c d"), (9, "b C d"), (10, t[40])],
        "item_id long, text string",
    )


def brute(docs, its):
    out = []
    for i, t in docs:
        dw = cases.words(t)
        hit, ids = set(), set()
        for item, text in its:
            iw = cases.words(text)
            n = min(10, len(iw))
            for s in range(len(iw) - n + 1 if n else 0):
                for p in range(len(dw) - n + 1):
                    if dw[p : p + n] == iw[s : s + n]:
                        hit |= set(range(p, p + n))
                        ids.add(str(item))
        out.append((i, len(dw), len(hit), ",".join(sorted(ids))))
    return sorted(out)


def test_matches_brute_force(spark):
    docs, its = cases.frame(spark), items(spark)
    got = decontaminate.decontaminate(docs, its).collect()
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in its.collect()])
    assert sorted((r.id, r.n_words, r.n_hit, ",".join(r["items"])) for r in got) == want
    assert sum(w[2] > 0 for w in want) >= 4


def test_blocks_of_a_large_test_set_give_the_same(spark, monkeypatch):
    docs, its = cases.frame(spark), items(spark)
    want = sorted(map(tuple, decontaminate.decontaminate(docs, its).select("id", "n_hit").collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 7)
    assert sorted(map(tuple, decontaminate.decontaminate(docs, its).select("id", "n_hit").collect())) == want


def test_empty_tables(spark):
    docs, its = cases.frame(spark), items(spark)
    assert decontaminate.decontaminate(cases.empty(spark), its).count() == 0
    assert decontaminate.decontaminate(docs, its.limit(0)).where("contaminated").count() == 0


def test_drop_and_proximity(spark):
    docs, its = cases.frame(spark), items(spark)
    dirty = {r.id for r in decontaminate.decontaminate(docs, its).where("contaminated").collect()}
    left = decontaminate.drop_contaminated(docs, its)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in docs.collect()} - dirty
    near = spark.createDataFrame([(1, "zz rare1 gap gap rare2 zz"), (2, "rare1 " + "gap " * 20 + "rare2")], "doc_id long, text string")
    test = spark.createDataFrame([(1, "rare1 rare2")], "item_id long, text string")
    assert [r.id for r in decontaminate.proximity_matches(near, test, slop=3).collect()] == [1]
    assert decontaminate.phrase_matches(near, test).where(F.lit(True)).count() == 0


def test_an_item_of_many_words(spark):
    rng = random.Random(9)
    words = cases.prose(rng, 20_000, 9_000).split(" ")
    long = " ".join(words)
    docs = spark.createDataFrame([(1, f"before {' '.join(words[7000:7025])} after"), (2, "nothing here"), (3, long)], "doc_id long, text string")
    its = spark.createDataFrame([(1, long), (2, None)], "item_id long, text string")
    named = decontaminate._items(its, "item_id", "text")
    assert decontaminate._window_terms(decontaminate._passages(named, 10)).count() <= 10 * 20_000
    got = sorted((r.id, r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.decontaminate(docs, its).collect())
    assert got == [(1, 27, 25, ["1"]), (2, 2, 0, []), (3, 20_000, 20_000, ["1"])]
