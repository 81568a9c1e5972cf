import math
import random
import zlib
from collections import Counter

import numpy as np

from docloom.llm import toxicity

from . import cases


def corpus(spark, n=600):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        w = cases.prose(rng, rng.randrange(20, 80)).split(" ")
        bad = i % 6 == 0
        for _ in range(rng.randrange(1, 5) if bad else 0):
            w[rng.randrange(len(w))] = rng.choice(["vile", "nasty"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_held_out_accuracy(spark):
    docs, labels, truth = corpus(spark)
    model = toxicity.fit(docs, labels.where("doc_id < 400"))
    assert (np.diff(model.thetas) > 0).all()
    got = {r.id: r for r in toxicity.score(docs, model).collect()}
    held = [(got[i].toxic, bool(t)) for i, _, t in truth if i >= 400]
    assert sum(a == b for a, b in held) / len(held) > 0.98
    assert all(0 <= r.expected_severity <= toxicity.GRADES for r in got.values())
    left = toxicity.drop_toxic(docs, model)
    assert {r.doc_id for r in left.collect()} == {i for i, r in got.items() if not r.toxic}


def test_toxicity_edge_cases(spark):
    docs, labels, _ = corpus(spark)
    model = toxicity.fit(docs, labels)
    odd = cases.frame(spark)
    assert toxicity.score(odd, model).where("toxic").count() == 0
    assert toxicity.drop_toxic(odd, model).columns == odd.columns
    assert toxicity.score(cases.empty(spark), model).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, none).where("toxic").count() == 0


def slow_score(text, model):
    """The definition, word by word and bucket by bucket."""
    words = cases.words(text)
    of = dict(zip(model.buckets.tolist(), model.weights.tolist()))
    n = Counter()
    for w in words:
        for part in [w.encode()] + [b"\x01" + w[:k].encode() for k in (4, 5, 6, 7) if len(w) > k]:
            n[zlib.crc32(part) % 2**20] += 1
    z = sum(of.get(b, 0.0) * math.log(1 + 100 * k / len(words)) for b, k in n.items())
    return [1 / (1 + math.exp(t - z)) for t in model.thetas]


def test_scores_equal_the_definition(spark):
    docs, labels, _ = corpus(spark)
    model = toxicity.fit(docs, labels)
    rows = docs.union(cases.frame(spark).select("doc_id", "text")).where("doc_id < 200")
    texts = {(r.doc_id, r.text) for r in rows.collect()}
    got = {(round(r.expected_severity, 6), round(r.p_toxic, 6)) for r in toxicity.score(rows, model).collect()}
    want = {(round(sum(p), 6), round(p[0], 6)) for p in (slow_score(t, model) for _, t in texts)}
    assert got == want


def test_held_out_recall_on_the_tables(spark):
    """Labels whose id is even fit, the others are held out."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where("doc_id % 2 = 0"))
    got = toxicity.score(docs, model).join(labels.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "id").withColumnRenamed("toxic", "truth"), "id")
    caught, wrong = got.selectExpr("avg(if(truth = 1, int(toxic), null))", "avg(if(truth = 0, int(toxic), null))").first()
    print(f"held-out recall {caught:.3f}, false positives {wrong:.4f}")
    assert caught >= 0.9 and wrong <= 0.01


def test_ordinal_fit_recovers_order_and_shared_weights():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    latent = x @ [2.0, -1.0] + rng.logistic(size=4000)
    grade = np.searchsorted([-1.0, 1.0, 3.0], latent)
    w, theta = toxicity.fit_ordinal(x, grade, 4)
    assert np.allclose(w, [2, -1], atol=0.25) and np.allclose(theta, [-1, 1, 3], atol=0.3)
