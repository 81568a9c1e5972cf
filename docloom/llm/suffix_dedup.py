"""Removal of repeated passages with column-wise Burrows-Wheeler construction.

A byte goes if a passage of `least` bytes that covers it starts anywhere else too.

1. Winnowing: among the GRAM-byte hashes of a passage the smallest is its anchor. Equal passages
   have equal anchors, so only text around an anchor that occurs twice can
   repeat. Neighbouring passages with equal anchors form a segment, wherever in them the anchor stands, of as many passages as
   a window has places at most; so a text of one repeated byte has no more segments than others. Each passage is in one segment.
2. Segments that are equal as a whole repeat wholly. Of an anchor with several different
   segments, one copy of each goes into a collection; so does a segment in which its anchor stands twice.
3. Segments are trimmed to the part whose 2 * GRAM-byte runs occur twice in the collection; what
   falls away cannot repeat. Collections (all segments of an anchor are in the same one) get their Burrows-Wheeler
   transform column by column: each round inserts, for every segment at once, the next symbol
   from the right, at the place that rank counting on the transform gives. The same counting on
   the finished transform gives the row of each suffix. Suffixes with a common prefix of `least` bytes stand together in the end;
   neighbours that have one are marked.
4. Marked passages of all copies of a segment are merged to spans and cut out.

Tables between the steps are Parquet in the shared folder, read in sequence; they are the
external files of the construction. The columns of one collection are held in memory; its size
is bounded by the number of collections. An anchor with more than HOT different segments is
not put into one collection; its passages are compared by 128-bit digests, dealt evenly.

Defined cases: null is empty; texts below `least` bytes keep everything; repeated rows count as
occurrences of each other; documents sharing an id are told apart by a text hash; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, released, written, written_at

LEAST = 400
GRAM = 128
#: Bytes of segments in a collection, about.
COLLECTION = 1 << 20
HOT = 5_000

_U = np.uint64
_CHUNK = 1 << 20
_C = _U(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(29))


_BYTE = _mix((np.arange(256, dtype=np.uint64) + _U(1)) * _C)


def gram_hashes(b: np.ndarray, length: int = GRAM) -> np.ndarray:
    """A hash of each run of `length` (a power of two) bytes, by doubling."""
    h, n = _BYTE[b], 1
    while n < length:
        h = h[:-n] * _C + h[n:]
        h ^= h >> _U(32)
        n *= 2
    return _mix(h)


def anchors(b: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of a text of at least `least` bytes: anchor hash, first and last passage start, and whether the
    anchor stands in it twice, so that one of its passages may stand there twice."""
    g = gram_hashes(b, gram)
    w = least - gram + 1
    n = len(g)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = g
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    low = np.minimum(back[: n - w + 1], ahead[w - 1 : n])
    begin = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    run = np.repeat(begin, np.diff(np.append(begin, len(low))))
    first = np.flatnonzero((np.arange(len(low)) - run) % w == 0)
    last = np.append(first[1:] - 1, len(low) - 1)
    tied = [np.count_nonzero(g[a : z + w] == m) > 1 for a, z, m in zip(first.tolist(), last.tolist(), low[first], strict=True)]
    return low[first], first, last, np.array(tied, bool)


def _segments(least: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, fps, segs, s0, s1, twice = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                whole = len(text or b"")
                for base in range(0, max(whole - least + 1, 0), _CHUNK):
                    part = text[base : base + _CHUNK + least - 1]
                    fp, a, b, tied = anchors(np.frombuffer(part, np.uint8), least, gram)
                    at.append(np.full(len(a), i))
                    fps.append(fp), s0.append(a + base), s1.append(b + base), twice.append(tied)
                    segs.extend(xxhash.xxh3_64_intdigest(part[x : y + least]) for x, y in zip(a.tolist(), b.tolist(), strict=True))
            if at:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(np.concatenate(at))), batch.column("h").take(pa.array(np.concatenate(at))),
                     pa.array(np.concatenate(fps).view(np.int64)), pa.array(np.array(segs, np.uint64).view(np.int64)),
                     pa.array(np.concatenate(s0).astype(np.int64)), pa.array(np.concatenate(s1).astype(np.int64)), pa.array(np.concatenate(twice))],
                    ["id", "h", "fp", "seg", "s0", "s1", "tied"],
                )

    return run


class _Column:
    """The transform while it grows: symbols in row order, cut into blocks of about BLOCK rows
    with the number of each symbol in each block, so that ranks need one block only."""

    BLOCK = 256

    def __init__(self, symbols: np.ndarray, kinds: int) -> None:
        self.rows, self.kinds = symbols, kinds
        self._count()

    def _count(self) -> None:
        self.size = max(1, -(-len(self.rows) // self.BLOCK))
        self.at = np.minimum(np.arange(self.size + 1) * self.BLOCK, len(self.rows))
        cell = np.repeat(np.arange(self.size) * self.kinds, np.diff(self.at)) + self.rows
        self.n = np.bincount(cell, minlength=self.size * self.kinds).astype(np.int32).reshape(self.size, self.kinds)

    def rank(self, places: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Number of smaller symbols in the transform and of equal ones above each place; the
        end mark does not count."""
        above = np.cumsum(self.n, axis=0, dtype=np.int32)
        smaller = np.concatenate([[0, 0], np.cumsum(above[-1][1:])])[:-1]
        block = np.searchsorted(self.at, places, "right") - 1
        width = -(-int(np.diff(self.at).max()) // 8) * 8
        padded = np.concatenate([self.rows, np.zeros(width, np.uint8)])
        window = np.lib.stride_tricks.sliding_window_view(padded, width)[self.at[block]]
        before = np.arange(width, dtype=np.uint16) < (places - self.at[block]).astype(np.uint16)[:, None]
        same = ((window == symbols[:, None]) & before).view(np.uint64)  # eight counters a word
        inside = np.ascontiguousarray(same.sum(axis=1)).view(np.uint8).reshape(-1, 8).sum(axis=1, dtype=np.int64)
        return smaller[symbols] + above[block, symbols] - self.n[block, symbols] + inside

    def insert(self, places: np.ndarray, symbols: np.ndarray) -> None:
        """Puts symbols in; places are their rows afterwards, ascending."""
        old = np.ones(len(self.rows) + len(places), bool)
        old[places] = False
        grown = np.empty(len(old), np.uint8)
        grown[old], grown[places] = self.rows, symbols
        self.rows = grown
        block = np.minimum(np.searchsorted(self.at, places - np.arange(len(places)), "right") - 1, self.size - 1)
        np.add.at(self.n, (block, symbols), 1)
        self.at[1:] += np.cumsum(np.bincount(block, minlength=self.size))
        if np.diff(self.at).max() > 2 * self.BLOCK:
            self._count()


def bwt_rows(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The Burrows-Wheeler transform of the strings, each with its own end mark (0, equal marks
    in the order of the strings; bytes count one more), and string and start of the suffix of
    every row. Round j puts the suffixes of length j of all strings to
    their places: with c the symbol before a suffix at row r, the suffix that starts with this c
    comes after all suffixes of smaller symbols and after as many c's as the transform has above
    r. The same step on the finished transform gives the row of every suffix."""
    m = len(strings)
    n = np.array([len(s) for s in strings], np.int64)
    flat = np.frombuffer(b"".join(strings), np.uint8)
    used = np.flatnonzero(np.bincount(flat, minlength=256))
    if len(used) > 255:
        raise ValueError("a byte value must be free for the end mark")
    code = np.zeros(256, np.uint8)
    code[used] = np.arange(1, len(used) + 1)
    # the symbol before a string's first one is its end mark
    ends = np.cumsum(n) + np.arange(1, m + 1)
    text = np.zeros(len(flat) + m + 1, np.uint8)
    inner = np.ones(len(flat) + m, bool)
    inner[ends - n - 1] = False
    text[: len(flat) + m][inner] = code[flat]
    column = _Column(text[ends - 1] if m else np.zeros(0, np.uint8), len(used) + 1)
    who, rows, left = np.arange(m), np.arange(m), n.copy()
    while True:
        symbols = column.rows[rows]
        live = symbols > 0
        who, rows, symbols = who[live], rows[live], symbols[live]
        if not len(rows):
            break
        rows = m + column.rank(rows, symbols)
        order = np.argsort(rows)
        who, rows = who[order], rows[order]
        left[who] -= 1
        column.insert(rows, text[ends[who] - n[who] + left[who] - 1])
    bwt = column.rows
    named = np.concatenate([[0], used + 1]).astype(np.uint16)
    step = np.empty(len(bwt), np.int32)
    step[np.argsort(bwt, kind="stable")] = np.arange(len(bwt), dtype=np.int32)
    owner, start = np.empty(len(bwt), np.int32), np.empty(len(bwt), np.int32)
    who, rows, left = np.arange(m), np.arange(m), n
    while len(rows):
        owner[rows], start[rows] = who, left
        live = left > 0
        who, rows, left = who[live], step[rows[live]], left[live] - 1
    return named[bwt], owner, start


def repeated_starts(strings: list[bytes], least: int = LEAST) -> list[np.ndarray]:
    """For each string the starts of its passages of `least` bytes that also start elsewhere in
    the strings, ascending."""
    long_ones = [i for i, s in enumerate(strings) if len(s) >= least]
    out = [np.zeros(0, np.int64)] * len(strings)
    if not long_ones:
        return out
    kept = [strings[i] for i in long_ones]
    _, owner, start = bwt_rows(kept)
    n = np.array([len(s) for s in kept])
    base = np.cumsum(n) - n
    rows = np.flatnonzero(n[owner] - start >= least)
    at = base[owner[rows]] + start[rows]
    flat = np.frombuffer(b"".join(kept), np.uint8)
    prefix = np.lib.stride_tricks.sliding_window_view(flat, least)
    equal = np.zeros(len(rows), bool)
    # a long suffix with an equal prefix follows its like at once
    for i in range(1, len(rows), 1 << 14):
        j = np.arange(i, min(i + (1 << 14), len(rows)))
        for step in range(0, least, 100):
            span = slice(step, min(step + 100, least))
            j = j[(prefix[at[j], span] == prefix[at[j - 1], span]).all(axis=1)]
        equal[j] = True
    marked = equal.copy()
    marked[:-1] |= equal[1:]
    who, first = owner[rows[marked]], start[rows[marked]]
    order = np.lexsort((first, who))
    cuts = np.searchsorted(who[order], np.arange(len(kept) + 1))
    first = first[order].astype(np.int64)
    for k, i in enumerate(long_ones):
        out[i] = first[cuts[k] : cuts[k + 1]]
    return out


def possible(strings: list[bytes], least: int = LEAST, gram: int = 2 * GRAM) -> list[tuple[int, int]]:
    """For each string the part from, to outside of which no passage can repeat: all runs of
    `gram` bytes in a repeated passage occur twice. (0, 0) if there is none."""
    if gram > least:
        return [(0, len(x)) for x in strings]
    hashes = [gram_hashes(np.frombuffer(x, np.uint8), gram) for x in strings]
    _, at, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    twice, need, out, base = n[at] > 1, least - gram + 1, [], 0
    for h in hashes:
        long = [(a, b) for a, b in _runs(np.flatnonzero(twice[base : base + len(h)])) if b - a + 1 >= need]
        out.append((long[0][0], long[-1][1] + gram) if long else (0, 0))
        base += len(h)
    return out


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of consecutive numbers."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), starts[np.concatenate([cut, [len(starts) - 1]])].tolist(), strict=True))


def segments(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    kind = docs.schema["id"].dataType.simpleString()
    return map_batches(docs.where(F.length("text") >= least), _segments(least, gram), f"id {kind}, h long, fp long, seg long, s0 long, s1 long, tied boolean")


def repeated_passages(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """id, h, first, last: starts of repeated passages, in runs. docs: id, h, text (binary)."""
    spark = docs.sparkSession
    seen = written(segments(docs, least, gram), "segments")
    kinds = seen.groupBy("fp", "seg").agg(F.count("*").alias("n"), F.min(F.struct("id", "h", "s0", "s1")).alias("one"), F.max("tied").alias("tied"))
    kinds, all_kinds = written_at(kinds, "kinds")
    several = kinds.groupBy("fp").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"), F.max("tied").alias("any")).where("n > 1 or any")
    kinds = written(kinds.join(several.select("fp", "kinds"), "fp"), "repeated-kinds")
    released(spark, all_kinds)
    whole = kinds.where("n > 1").select("fp", "seg")
    alone = kinds.where("kinds > 1 or n = 1 and tied")
    size = alone.agg(F.sum(F.col("one.s1") - F.col("one.s0") + least)).first()[0] or 0
    collections = max(1, -(-size // COLLECTION))
    carriers = alone.select("fp", "seg", "kinds", F.col("one.id").alias("cid"), F.col("one.h").alias("ch"), F.col("one.s0").alias("s0"), F.col("one.s1").alias("s1"))
    texts = docs.join(carriers.hint("merge"), docs["id"].eqNullSafe(F.col("cid")) & (docs["h"] == F.col("ch")))
    cut = texts.select("fp", "seg", "kinds", F.substring("text", F.col("s0").cast("int") + 1, (F.col("s1") - F.col("s0")).cast("int") + least).alias("part")).dropDuplicates(["fp", "seg"])
    parts, all_parts = written_at(cut, "parts")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = pdf["part"].tolist()
        spans = possible(parts, least)
        found = repeated_starts([x[a:b] for x, (a, b) in zip(parts, spans, strict=True)], least)
        rows = [
            (f, s, a + lo, b + lo)
            for f, s, starts, (lo, _) in zip(pdf["fp"], pdf["seg"], found, spans, strict=True) for a, b in _runs(starts)
        ]
        return pd.DataFrame(rows, columns=["fp", "seg", "a", "b"]).astype("int64")

    shape = "fp long, seg long, a long, b long"
    some = (
        parts.where(F.col("kinds") <= HOT).withColumn("c", F.pmod(F.xxhash64("fp"), F.lit(collections)))
        .groupBy("c").applyInPandas(lambda pdf: build(pdf), shape)
    )

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.column("part")[i].as_py()
                n = len(part) - least + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_128_digest(part[k : k + least]) for k in range(n)], pa.binary()),
                     pa.array([batch.column("fp")[i].as_py()] * n), pa.array([batch.column("seg")[i].as_py()] * n), pa.array(range(n), pa.int64())],
                    ["d", "fp", "seg", "a"],
                )

    hot = parts.where(F.col("kinds") > HOT)
    result = written(some, "marked")
    if not hot.isEmpty():
        each = written(map_batches(hot.select("fp", "seg", "part"), passages, "d binary, fp long, seg long, a long"), "passages")
        twice = each.groupBy("d").agg(F.count("*").alias("n")).where("n > 1").select("d")
        result = result.union(each.join(twice, "d").select("fp", "seg", "a", F.col("a").alias("b")))
    released(spark, all_parts)
    spans = whole.select("fp", "seg", F.lit(0).cast("long").alias("a"), F.lit(None).cast("long").alias("b")).union(result)
    return seen.join(spans, ["fp", "seg"]).select("id", "h", (F.col("s0") + F.col("a")).alias("first"), F.coalesce(F.col("s0") + F.col("b"), F.col("s1")).alias("last"))


def _merged(spans: list, least: int) -> list[tuple[int, int]]:
    """Byte spans [from, to) that the runs of starts cover, merged where they touch."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + least)
        else:
            out.append([a, b + least])
    return [(a, b) for a, b in out]


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, spans (array of from, to), kept (binary)
    and kept_sha256."""
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    found = repeated_passages(rows, least, gram)
    spans = found.groupBy(F.col("id").alias("d2"), F.col("h").alias("h2")).agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    joined = rows.join(spans.hint("merge"), rows["id"].eqNullSafe(F.col("d2")) & (rows["h"] == F.col("h2")), "left").select("id", "text", "runs")
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, all_, kept, sha = [], [], [], [], []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                spans = _merged([(r["first"], r["last"]) for r in runs or ()], least)
                edges = [0, *(x for s in spans for x in s), len(text)]
                rest = b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                n.append(len(text)), gone.append(len(text) - len(rest)), all_.append([{"from": a, "to": b} for a, b in spans])
                kept.append(rest), sha.append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(all_, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), pa.array(kept, pa.binary()), pa.array(sha)],
                ["id", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"],
            )

    return map_batches(joined, cut, f"id {kind}, n_bytes long, n_removed long, spans array<struct<from:long,to:long>>, kept binary, kept_sha256 string")
