import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from docloom.llm import hilbert_shards as hs

from . import cases


def test_curve_visits_every_cell_and_moves_one_step():
    for bits, dims in ((2, 2), (3, 2), (2, 3), (1, 4), (2, 4)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        order = np.argsort(hs.hilbert_index(cells, bits))
        assert sorted(hs.hilbert_index(cells, bits).tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_rows_law_slots_and_values(spark):
    docs = cases.frame(spark)
    rows = docs.collect()
    for shards in (1, 7, 40, 200):
        out = hs.hilbert_shards(docs, shards).collect()
        assert len(out) == len(rows)
        count = Counter(r.shard for r in out)
        sizes = [count.get(s, 0) for s in range(shards)]
        assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
        slots = defaultdict(list)
        for r in out:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        ranked = sorted(out, key=lambda r: r.rank)
        assert [r.hilbert for r in ranked] == sorted(r.hilbert for r in out)
    want = sorted((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in rows)
    assert sorted((r.id, r["size"], r.text_crc32) for r in out) == want


def test_empty_and_written(spark, tmp_path):
    assert hs.hilbert_shards(cases.empty(spark)).count() == 0
    docs = cases.frame(spark).dropDuplicates(["doc_id"])
    hs.write_shards(docs, hs.hilbert_shards(docs, 5), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


def test_tags_with_a_shared_start_spread(spark, monkeypatch):
    rows = [(i, "text", "en", f"https://site{i * 7 % 16:02d}.example.com") for i in range(1600)] + [(5000, "text", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for small in (10_000, 0):  # broadcast and joined
        monkeypatch.setattr(hs, "SMALL", small)
        got = hs.hilbert_shards(docs, 16).collect()
        assert len(got) == 1601
        source = {r[0]: r[3] or "" for r in rows}
        assert {r.dim_source: source[r.id] for r in got} == dict(enumerate(sorted(set(source.values()))))
        assert len({r.cell_dim_source for r in got}) >= 16


def test_ids_of_any_kind_and_missing_tags(spark):
    docs = spark.createDataFrame([("a", "x", "en"), (None, "yy", None), ("7", None, "de"), ("a", "x", "en")], "doc_id string, text string, lang string")
    got = hs.hilbert_shards(docs, 3).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(0, 0), (0, 1), (1, 0), (2, 0)]
    assert sorted((r.id or "", r.size) for r in got) == [("", 18), ("7", 16), ("a", 17), ("a", 17)]


def test_smallest_and_largest_values_prune_shards(spark):
    """Of 40 shards few hold a source, a language or a range of ids, by their smallest and largest values."""
    rng = random.Random(4)
    rows = [(i, "x" * rng.randrange(2000), rng.choice("abcd"), f"https://host/{rng.randrange(16):02d}") for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    of = {r.id: r.shard for r in hs.hilbert_shards(docs, 40).collect()}
    span = {}
    for i, t, lang, source in rows:
        for name, v in (("source", source), ("lang", lang), ("id", i), ("size", len(t))):
            low, high = span.get((of[i], name), (v, v))
            span[of[i], name] = min(low, v), max(high, v)
    read = lambda name, a, b: sum(span[s, name][0] <= b and span[s, name][1] >= a for s in range(40))
    assert read("lang", "b", "b") <= 24 and read("source", "https://host/03", "https://host/03") <= 28
    assert read("id", 1000, 1400) <= 24 and read("size", 100, 200) <= 24


def brute_rows(docs, shards, bits=hs.BITS):
    """id, shard, slot by sorting all rows: cells from equal-frequency edges of every dimension, taken from all values."""
    rows = docs.collect()
    sizes = [len((r.text or "").encode()) + 16 for r in rows]
    tags = [[r[t] or "" for r in rows] for t in ("lang", "source")]
    dims = [sizes, *[[sorted(set(tag)).index(v) for v in tag] for tag in tags], [r.doc_id for r in rows]]
    top, cells = (1 << bits) - 1, []
    for values in dims:
        line, n = sorted(values), len(values)
        edges = sorted({line[max(-(-i * n // (top + 1)) - 1, 0)] for i in range(1, top + 1)})
        cells.append([sum(e <= v for e in edges) * top // len(edges) for v in values])
    index = hs.hilbert_index(np.array(cells).T, bits).tolist()
    order = sorted(range(len(rows)), key=lambda i: (index[i], rows[i].doc_id, zlib.crc32((rows[i].text or "").encode())))
    size, more = divmod(len(rows), shards)
    out = []
    for place, i in enumerate(order):
        shard = place // (size + 1) if place < more * (size + 1) else more + (place - more * (size + 1)) // size
        out.append((rows[i].doc_id, sizes[i], shard, place - shard * size - min(shard, more)))
    return sorted(out)


def test_cells_order_and_cuts_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, None if i % 29 == 0 else "w " * rng.choice([3, 3, rng.randrange(200)]), rng.choice(["de", "en", "en", None]), rng.choice("abcdefg")) for i in range(403)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    for shards in (7, 40):
        got = sorted((r.id, r["size"], r.shard, r.slot) for r in hs.hilbert_shards(docs, shards).collect())
        assert got == brute_rows(docs, shards)
