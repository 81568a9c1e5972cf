import random
from collections import defaultdict

import numpy as np
import pytest

from docloom.llm import suffix_dedup as sd

from . import cases


def brute(rows, least):
    where = defaultdict(list)
    for k, (_, t) in enumerate(rows):
        b = (t or "").encode()
        for s in range(len(b) - least + 1):
            where[b[s : s + least]].append((k, s))
    gone = defaultdict(set)
    for at in where.values():
        if len(at) > 1:
            for k, s in at:
                gone[k] |= set(range(s, s + least))
    out = []
    for k, (i, t) in enumerate(rows):
        b = (t or "").encode()
        g = gone[k]
        spans = sum(1 for x in g if x - 1 not in g)
        out.append((i, len(b), len(g), spans, cases.sha(bytes(x for j, x in enumerate(b) if j not in g))))
    return sorted(out)


@pytest.mark.parametrize("hot", [sd.HOT, 1])
def test_matches_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(sd, "HOT", hot)
    rows = [t if t is None or len(t) < 20_000 else t[:6000] for t in cases.texts()]
    docs = cases.frame(spark, rows)
    got = sorted((r.id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in sd.dedup_passages(docs).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], 400)
    assert sum(g[2] for g in got) > 10_000


def test_spans_touching_and_empty(spark):
    assert sd.dedup_passages(cases.empty(spark)).count() == 0
    assert sd._merged([(0, 3), (403, 403), (900, 900)], 400) == [(0, 803), (900, 1300)]


@pytest.mark.parametrize("seed", range(5))
def test_transform_against_sorted_suffixes(seed):
    rng = random.Random(seed)
    strings = ["".join(rng.choices("ab", k=rng.randrange(0, 12))).encode() for _ in range(rng.randrange(1, 9))]
    bwt, owner, start = sd.bwt_rows(strings)
    want = sorted((s[k:], i, k) for i, s in enumerate(strings) for k in range(len(s) + 1))
    assert [(int(o), int(k)) for o, k in zip(owner, start, strict=True)] == [(i, k) for _, i, k in want]
    assert bwt.tolist() == [strings[i][k - 1] + 1 if k else 0 for _, i, k in want]


def test_anchors_of_equal_passages_are_equal():
    rng = np.random.default_rng(0)
    common = rng.integers(0, 4, 700).astype(np.uint8)
    found = []
    for n in (37, 411):
        b = np.concatenate([rng.integers(0, 4, n).astype(np.uint8), common])
        fp, first, last, tied = sd.anchors(b)
        assert first[0] == 0 and last[-1] == len(b) - 400 and (first[1:] == last[:-1] + 1).all() and not tied.any()
        found.append({s - n: f for f, a, z in zip(fp.tolist(), first.tolist(), last.tolist(), strict=True) for s in range(a, z + 1) if s >= n})
    assert found[0] == found[1]


def test_one_repeated_byte_has_few_segments_and_goes_wholly(spark):
    _, first, last, tied = sd.anchors(np.full(1_000_000, 97, np.uint8))
    assert len(first) < 4_000 and tied.all() and (first[1:] == last[:-1] + 1).all() and last[-1] == 1_000_000 - 400
    docs = spark.createDataFrame([(1, "a" * 5_000_000), (2, "ab" * 2_000 + "tail"), (2, "other text " + "b" * 390), (3, "a" * 400)], "doc_id long, text string")
    assert sd.segments(docs.selectExpr("doc_id as id", "cast(text as binary) as text", "xxhash64(text) as h")).where("id = 1").count() < 20_000
    got = {(r.id, r.n_bytes): (r.n_removed, len(r.spans), bytes(r.kept)) for r in sd.dedup_passages(docs).collect()}
    assert got == {(1, 5_000_000): (5_000_000, 1, b""), (2, 4_004): (4_000, 1, b"tail"), (2, 401): (0, 0, b"other text " + b"b" * 390), (3, 400): (400, 1, b"")}


def test_periods_and_shared_passages_in_different_surroundings(spark):
    rng = random.Random(3)
    passage = "".join(rng.choices("abcd ", k=430))
    rows = ["xyz" * 300, "yzx" * 250 + "end", "q" * 399, "q" * 401] + [cases.prose(rng, 30) + passage[rng.randrange(30) :] + cases.prose(rng, 40) for _ in range(6)] + [passage * 3]
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate(rows)], "doc_id long, text string")
    got = sorted((r.id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in sd.dedup_passages(docs).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], 400)
