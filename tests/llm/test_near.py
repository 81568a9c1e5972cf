import itertools
import random
from collections import Counter

import numpy as np

from docloom.llm import common, dartminhash as dm

from . import cases


def strips(text):
    w = cases.words(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])
    return Counter(grams)


def jaccard(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if both else float(not a and not b)


def brute(rows):
    sets = [strips(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if jaccard(sets[a], sets[b]) >= 0.8:
            root[find(a)] = find(b)
    low: dict = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), i), i)
    return sorted((i, low[find(k)]) for k, (i, _) in enumerate(rows))


def test_classes_match_brute_force(spark):
    docs = cases.frame(spark)
    got = dm.near_groups(docs).collect()
    assert sorted((r.id, r.class_id) for r in got) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r.kept for r in got) == len({r.class_id for r in got})


def test_chain_whose_ends_differ_is_one_class(spark):
    w = [f"t{i}" for i in range(200)]
    chain = [" ".join(x if j >= 4 * k else f"n{j}" for j, x in enumerate(w)) for k in range(0, 10)]
    docs = spark.createDataFrame(list(enumerate(chain)), "doc_id long, text string")
    assert {(r.id, r.class_id) for r in dm.near_groups(docs).collect()} == set(brute(list(enumerate(chain))))


def test_family_around_the_threshold_matches_brute_force(spark):
    rng = random.Random(3)
    base = [f"t{i}" for i in range(150)]
    rows = []
    for k in range(60):
        w = list(base)
        for place in rng.sample(range(150), rng.randrange(1, 9)):
            w[place] = f"m{rng.randrange(40)}"
        rows.append((k, " ".join(w)))
    got = {(r.id, r.class_id) for r in dm.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == set(brute(rows))
    assert len({c for _, c in got}) > 5


def test_drop_and_empty(spark):
    docs = cases.frame(spark)
    left = dm.drop_near(docs)
    assert left.columns == docs.columns
    assert left.count() == len({c for _, c in brute([(r.doc_id, r.text) for r in docs.collect()])})
    assert dm.near_groups(cases.empty(spark)).count() == 0


def test_drop_tells_rows_of_one_id_apart(spark):
    """Ids clash, or are null, with different texts: each text's class keeps one row."""
    rng = random.Random(3)
    a, b, c = (cases.prose(rng, 60) for _ in range(3))
    rows = [(3, a), (7, a), (7, b), (None, c), (None, a), (None, c)]
    left = dm.drop_near(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text for r in left) == sorted([a, b, c])


def test_signature_agreement_estimates_weighted_jaccard():
    a = "x y z " * 30 + " ".join(f"a{i}" for i in range(60))
    b = "x y z " * 20 + " ".join(f"a{i}" for i in range(70))
    h, bounds = dm.elements([common.byte_words(t.encode()) for t in (a, b)], dm.Hashes())
    sig = dm.signatures(h, bounds, 2000)
    assert abs((sig[0] == sig[1]).mean() - jaccard(strips(a), strips(b))) < 0.05
    exact = len(np.intersect1d(h[: bounds[1]], h[bounds[1] :])) / len(np.union1d(h[: bounds[1]], h[bounds[1] :]))
    assert abs(exact - jaccard(strips(a), strips(b))) < 1e-9


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (3, 7), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25), (5, 5)]
    got = common.components(None, spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.comp for r in got} == {1: 1, 2: 1, 3: 1, 7: 1, 10: 10, 11: 10, **{i: 20 for i in range(20, 26)}}
