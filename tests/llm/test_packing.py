import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from docloom.llm import packing
from docloom.llm.queries import tokenizer_path

from . import cases


def test_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    docs = cases.frame(spark)
    rows = docs.collect()
    got = packing.pack_documents(docs, tokenizer_path()).collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.id].append(r)
    for i, rs in by_doc.items():
        text = next(r.text for r in rows if r.doc_id == i) or ""
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [0], "<u4")
        if i == 3:
            rs = rs[:1]
        rs.sort(key=lambda r: r.piece)
        assert [r.piece for r in rs] == list(range(len(rs)))
        assert [r.length for r in rs[1:]] == [2048] * (len(rs) - 1)
        for r in rs:
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert sum(r.length for r in rs) == len(ids)
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(seqs) <= -(-total // 2048) + 1
    assert packing.pack_documents(cases.empty(spark), tokenizer_path()).count() == 0


def test_sequences_hold_the_ids(spark):
    docs = cases.frame(spark, cases.texts()[:30]).dropDuplicates(["doc_id"])
    packed = packing.pack_documents(docs, tokenizer_path())
    out = packing.sequences(docs, packed, tokenizer_path()).collect()
    assert sum(len(r.ids) for r in out) == packed.selectExpr("sum(length)").first()[0]


@pytest.mark.parametrize("seed", range(4))
def test_groups_join_in_levels(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([rng.randrange(1, 100), rng.randrange(1, 64), 33, 100])) for i in range(500)]
    parts = spark.createDataFrame(rows, "k long, length long")
    out = packing.pack(parts, 100, group=60).collect()
    assert sorted(r.k for r in out) == list(range(500))
    fill = defaultdict(int)
    for r in out:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 100
    assert sum(f <= 50 for f in fill.values()) <= 1


def test_local_search_empties_a_bin():
    lengths = np.array([6, 4, 4, 6, 5, 5])  # bins of 10
    bins = packing.improve([[0, 1], [2, 3], [4], [5]], lengths, 10)
    assert len(bins) == 3
    lengths = np.array([7, 6, 4, 3])
    assert len(packing.improve([[0], [1, 3], [2]], lengths, 10)) == 2  # a swap is needed


def test_cuts():
    assert packing.cuts(1, 4) == [(0, 1)]
    assert packing.cuts(4, 4) == [(0, 4)]
    assert packing.cuts(9, 4) == [(0, 1), (1, 4), (5, 4)]
    assert packing.cuts(8, 4) == [(0, 4), (4, 4)]


def test_words_encode_as_whole_texts_do():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    encode = packing.Encoder(tokenizer_path())
    rng = random.Random(1)
    signs = list("ab Z\n\t\r\x0b\x1c\x1f  é'sllt12½ß漢字😀<|endoftext|>._-́\u0000")
    for text in ["", " ", "don't  stop\n\n x", *("".join(rng.choices(signs, k=rng.randrange(60))) for _ in range(2000))]:
        assert np.frombuffer(encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def fewest(lengths, capacity):
    """The smallest number of bins, over all subsets: (bins, fill of the last one) for each."""
    best = {0: (1, 0)}
    for mask in range(1, 1 << len(lengths)):
        best[mask] = min(
            (b, f + n) if f + n <= capacity else (b + 1, n)
            for i, n in enumerate(lengths) if mask >> i & 1 for b, f in [best[mask ^ (1 << i)]]
        )
    return best[(1 << len(lengths)) - 1][0]


def test_small_groups_against_all_packings():
    rng = random.Random(3)
    over, searched = 0, 0
    for _ in range(150):
        lengths = np.array([rng.choice([rng.randrange(1, 60), rng.randrange(20, 50)]) for _ in range(rng.randrange(1, 11))])
        where, offset, fill, moved = packing.pack_group(lengths, 60)
        assert all(fill[i] == lengths[where == where[i]].sum() <= 60 for i in range(len(lengths)))
        assert all(sorted(zip(offset[where == k], lengths[where == k]))[0][0] == 0 for k in set(where))
        more = len(set(where)) - fewest(lengths.tolist(), 60)
        assert 0 <= more <= 1
        over, searched = over + more, searched + bool(moved.any())
    assert over <= 3 and searched > 15


def test_exact_fills_raise_the_squares_and_lose_nothing():
    rng = random.Random(4)
    for _ in range(30):
        lengths = np.array([rng.randrange(1, 100) for _ in range(rng.randrange(1, 200))])
        start = packing.best_fit(lengths, 100, falling=False)
        bins = packing.fill_up([list(b) for b in start], lengths, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        fills = [[int(lengths[b].sum()) for b in x] for x in (start, bins)]
        assert max(fills[1]) <= 100 and sum(f * f for f in fills[1]) >= sum(f * f for f in fills[0])
