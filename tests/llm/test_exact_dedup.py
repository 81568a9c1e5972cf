import re
from collections import defaultdict

from docloom.llm import exact_dedup

from . import cases


def brute(rows):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[cases.sha(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode())].append((-len(t or ""), i, k))
    out = []
    for digest, g in groups.items():
        best = min(g)
        out += [(i, best[1], len(g), digest) for _, i, _ in g]
    return sorted(out)


def test_matches_brute_force_with_and_without_heavy_hitters(spark):
    docs = cases.frame(spark)
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    for counters in (1, 3, 2048):
        got = exact_dedup.exact_groups(docs, counters=counters).collect()
        assert sorted((r.id, r.keep_id, r.group_size, bytes(r.digest).hex()) for r in got) == want
        assert sum(r.kept for r in got) == len({w[3] for w in want})


def test_drop_keeps_one_row_of_a_group_and_all_columns(spark):
    docs = cases.frame(spark)
    best = {}
    for r in docs.collect():
        key = re.sub(r"\s", "", r.text or "")
        best[key] = min(best.get(key, (1, 0)), (-len(r.text or ""), r.doc_id))
    for counters, most in ((2048, 200_000), (3, 0), (2048, 0)):
        out = exact_dedup.drop_exact(docs, counters=counters, broadcast_rows=most)
        assert out.columns == docs.columns
        assert sorted(r.doc_id for r in out.collect()) == sorted(i for _, i in best.values())
    assert exact_dedup.drop_exact(cases.empty(spark)).count() == 0


def test_misra_gries_bound():
    stream = ["a"] * 50 + [str(i) for i in range(100)] + ["b"] * 30
    counts: dict = {}
    for x in stream:
        counts = exact_dedup.summarise(counts, {x: 1}, 5)
    assert len(counts) <= 5
    assert counts["a"] >= 50 - len(stream) / 6


def test_frequent_digests_are_found(spark):
    rows = spark.createDataFrame([(bytes([i % 7 and i % 250]),) for i in range(1000)], "digest binary")
    assert {bytes(r.digest) for r in exact_dedup.frequent(rows, 20).collect()} >= {b"\0"}
