import math
from collections import Counter

import pytest

from docloom.llm import ngram_score as ng
from docloom.llm.queries import op10_lm_score

from . import cases


def slow(texts, vocab, mu=ng.MU):
    seq = [["<>", *cases.words(t)] for t in texts]
    c1 = Counter(w for s in seq for w in s[1:])
    c2 = Counter(p for s in seq for p in zip(s, s[1:]))
    ctx = Counter(b for s in seq for b in s if len(s) > 1)
    total = sum(c1.values())

    def loss(b, c):
        p1 = (c1[c] + mu / vocab) / (total + mu)
        return -math.log2((c2[b, c] + mu * p1) / (ctx[b] + mu))

    return loss


@pytest.mark.parametrize(("chunk", "docs_each", "places"), [(2000, 1 << 16, 1 << 22), (8 << 20, 1 << 16, 0), (8 << 20, 7, 1 << 22)])
def test_scores_match_a_plain_version(spark, monkeypatch, chunk, docs_each, places):
    monkeypatch.setattr(ng, "BROADCAST_PLACES", places)
    docs = cases.frame(spark)
    rows = docs.collect()
    near = {i for i in range(90) if i % 3 == 0} | {10**9}
    got = ng.ngram_scores(docs, spark.createDataFrame([(i,) for i in near], "doc_id long"), parts=3, chunk=chunk, chunk_docs=docs_each).collect()
    assert sorted(r.id for r in got) == sorted(r.doc_id for r in rows)
    vocab = len({w for r in rows for w in cases.words(r.text)})
    t, b = slow([r.text for r in rows if r.doc_id in near], vocab), slow([r.text for r in rows], vocab)
    want = {}
    for r in rows:
        s = ["<>", *cases.words(r.text)]
        pairs = list(zip(s, s[1:]))
        want.setdefault(r.doc_id, []).append((len(pairs), *((sum(f(*p) for p in pairs) / len(pairs) for f in (t, b)) if pairs else (None, None))))
    for r in got:
        assert any(
            n == r.n_tokens and (r.ce_diff is None if x is None else abs(r.loss_target - x) < 1e-9 and abs(r.loss_background - y) < 1e-9 and abs(r.ce_diff - x + y) < 1e-9)
            for n, x, y in want[r.id]
        )


def test_empty_inputs(spark):
    docs = cases.frame(spark)
    none = docs.select("doc_id").limit(0)
    assert ng.ngram_scores(cases.empty(spark), docs.select("doc_id")).count() == 0
    assert all(r.loss_target is None or r.loss_target > 0 for r in ng.ngram_scores(docs, none).collect())


def test_word_order_counts_in_the_query(spark, tmp_path):
    # the same words in another order
    good, bad = "abc abd " * 40, "abd abc abc abd " * 20
    rows = [(i, good if i % 2 else bad) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in op10_lm_score(spark, str(tmp_path)).collect()}
    assert got[35].n_tokens == 80 and got[35].ce_diff < 0 < got[36].ce_diff
