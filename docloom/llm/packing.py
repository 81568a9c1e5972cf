"""Best-fit packing with swap-based local search.

Documents are tokenised, ended by one id, and only those longer than `capacity` are cut into
pieces of exactly `capacity` tokens, the first piece taking the remainder. Pieces are dealt into
groups of bounded size by a hash of their row. Each group is packed by best fit in order of arrival, and
local search then empties sequences. First it fills them exactly: one takes a piece, or exchanges one or two of its
pieces for a longer one, from another that is not full either. Then a piece moves from the emptiest sequence to a fuller
one, or it, or two of its pieces, are exchanged for a shorter one there. Each step raises the sum of squared
fills, and sequences that become empty go, until there are as few as the tokens need or no step is
left. Best fit on falling lengths packs each group too, and the result of fewer sequences stays. Sequences at most half full of all groups (one a group)
are opened and packed together again, until they fit in one group; so a group can hold one sequence
more than its tokens need.

Defined cases: a null or empty text is the end id alone; ties in length are taken in any order;
repeated rows are packed each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, written

CAPACITY = 2048
#: Pieces in a group.
GROUP = 20_000
#: The pieces of text that byte-level BPE merges within (white space by Unicode property).
SPLIT = (
    r" ?\p{L}+| ?\p{N}+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: The same for texts of ASCII and Latin letters only, where the classes can be spelt out.
_L, _S = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F", r"\t-\r "
LATIN = rf" ?[{_L}]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{_S}0-9{_L}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
_OTHER = re.compile("[^\x00-\x7F\u00C0-\u024F]").search


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: itself if it is printable, else the
    next one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder(dict):
    """Ids of whole texts as little-endian unsigned 32-bit bytes. A text's ids are the ids of
    the words that the tokenizer's own pattern splits it into, one after the other; each word is
    encoded by the tokenizer's model once and kept, up to `keep` words."""

    def __init__(self, path: str, keep: int = 800_000):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self._any, self._latin = regex.compile(SPLIT).findall, re.compile(LATIN).findall
        self._model, self._keep = Tokenizer.from_file(path).model, keep
        self._letters = _byte_letters()

    def __missing__(self, word: str) -> bytes:
        letters = word.encode().decode("latin-1").translate(self._letters)
        ids = self[word] = array("I", [t.id for t in self._model.tokenize(letters)]).tobytes()
        return ids

    def __call__(self, text: str) -> bytes:
        if len(self) > self._keep:
            self.clear()
        words = self._any(text) if _OTHER(text) else self._latin(text)
        return b"".join([self[w] for w in words])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this process; it stays for the next task of a worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _pieces(tokenizer: str, capacity: int, end: bytes, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                raw = encode(text or "") + end
                for k, (s, n) in enumerate(cuts(len(raw) // 4, capacity)):
                    at.append(i), piece.append(k), start.append(s), length.append(n)
                    part = raw[4 * s : 4 * (s + n)]
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            cols = [batch.column("id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 and, if asked for, ids."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return map_batches(rows, _pieces(tokenizer, capacity, end, with_ids), schema)


def best_fit(lengths: np.ndarray, capacity: int, falling: bool = True) -> list[list[int]]:
    """Bins of indices by best fit, on falling lengths or in the given order. `open_` has a bit for
    each gap that some bin has, so the smallest gap that takes a piece is its lowest bit from the length up."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0
    order = np.argsort(-lengths, kind="stable") if falling else np.arange(len(lengths))
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fit = open_ >> n
        if fit:
            gap = n + (fit & -fit).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                open_ ^= 1 << gap
            bins[b].append(i)
        else:
            gap, b = capacity, len(bins)
            bins.append([i])
        gap -= n
        if gap:
            by_gap[gap].append(b)
            open_ |= 1 << gap
    return bins


def improve(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Local search on the underfull bins; see the module's text. The emptiest bin gives pieces
    away until it is empty or no step helps, then the next one is tried."""
    fill = np.array([int(lengths[b].sum()) for b in bins], np.int64)
    least = -(-int(fill.sum()) // capacity)
    full = [b for b, f in zip(bins, fill, strict=True) if f == capacity]
    bins = [b for b, f in zip(bins, fill, strict=True) if f < capacity]
    fill = fill[fill < capacity]
    home = np.empty(len(lengths), np.int64)
    for k, b in enumerate(bins):
        home[b] = k
    items = np.array([i for b in bins for i in b], np.int64)
    size = lengths[items] if len(items) else items
    alive, stuck, left = np.ones(len(bins), bool), np.zeros(len(bins), bool), len(bins)

    def shift(i: int, to: int) -> None:
        bins[home[i]].remove(i)
        fill[home[i]] -= lengths[i]
        bins[to].append(i)
        fill[to] += lengths[i]
        home[i] = to

    def step(source: int) -> bool:
        own = sorted(bins[source], key=lambda i: -lengths[i])
        gap = np.where(alive & (fill >= fill[source]), capacity - fill, -1)
        gap[source] = -1
        for i in own:  # move
            fits = np.flatnonzero(gap >= lengths[i])
            if len(fits):
                shift(i, int(fits[np.argmin(gap[fits])]))
                return True
        room = gap[home[items]]
        kinds = list({int(lengths[i]): i for i in reversed(own)}.items())  # one piece of each length, the longest first
        kinds.sort(reverse=True)
        twin = {n: j for n, i in kinds for j in own if j != i and lengths[j] == n}
        pairs = [(i,) for _, i in kinds] + [(i, j) for k, (_, i) in enumerate(kinds) for _, j in kinds[k + 1 :]] + [(i, twin[n]) for n, i in kinds if n in twin]
        for give in pairs:  # one for one, two for one; as lengths differ, 63 kinds at most
            more = int(lengths[list(give)].sum()) - size
            gain = np.where((more > 0) & (more <= room), more, 0)
            if len(gain) and (best := int(gain.argmax())) >= 0 and gain[best] > 0:
                taken = int(items[best])
                to = int(home[taken])
                shift(taken, source)
                for i in give:
                    shift(i, to)
                return True
        return False

    while len(full) + left > least:
        free = np.flatnonzero(alive & ~stuck)
        if not len(free):
            break
        source = int(free[np.argmin(fill[free])])
        if not step(source):
            stuck[source] = True
        elif not bins[source]:
            alive[source] = False
            left -= 1
            stuck[:] = False
    return full + [b for b in bins if b]


def fill_up(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Local search whose steps fill a bin exactly: an underfull bin, that of the longest piece first, takes a piece of the length of its gap from another
    underfull one, or exchanges one or two of its pieces for one there that is longer by its gap, long ones rather than short ones. Of two
    underfull bins that is the step that raises the squares most. It gathers the room in few bins, which `improve` then empties. `at` lists the pieces of each length that
    lie in underfull bins; those that have left are passed over when they are met."""
    size = lengths.tolist()
    fill = [sum(size[i] for i in b) for b in bins]
    home = [0] * len(size)
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    for k, b in enumerate(bins):
        for i in b:
            home[i] = k
            if fill[k] < capacity:
                at[size[i]].append(i)

    def other(n: int, k: int) -> int:
        """A piece of length n in an underfull bin other than k, -1 if there is none."""
        held = at[n] if n <= capacity else ()
        for j in range(len(held) - 1, -1, -1):
            i = held[j]
            if fill[home[i]] == capacity:
                held[j] = held[-1]
                held.pop()
            elif home[i] != k:
                return i
        return -1

    def trade(k: int, give: tuple[int, ...], take: int) -> None:
        to = home[take]
        bins[to].remove(take)
        bins[k].append(take)
        home[take] = k
        for i in give:
            bins[k].remove(i)
            bins[to].append(i)
            home[i] = to
        more = size[take] - sum(size[i] for i in give)
        fill[k] += more
        fill[to] -= more

    for _ in range(2):
        for k in sorted((k for k in range(len(bins)) if bins[k] and fill[k] < capacity), key=lambda k: -max(size[i] for i in bins[k])):
            gap, own = capacity - fill[k], bins[k]
            if gap == 0 or not own:
                continue
            some = sorted(own, key=lambda i: -size[i])
            steps = [(i, j) for x, i in enumerate(some) for j in some[x + 1 :]] + [(i,) for i in some] + [()]
            for give in sorted(steps, key=lambda g: -sum(size[i] for i in g)):
                take = other(gap + sum(size[i] for i in give), k)
                if take >= 0:
                    trade(k, give, take)
                    break
    return [b for b in bins if b]


def pack_group(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """bin, offset and fill of the bin of each piece, and whether the search has brought it there: most
    tokens of its bin come from another bin than its own of the start. The search begins from best fit in order of arrival; where best fit
    on falling lengths needs fewer bins, its result is taken and nothing has moved."""
    first = best_fit(lengths, capacity, falling=False)
    bins = improve(fill_up([list(b) for b in first], lengths, capacity), lengths, capacity)
    falling = best_fit(lengths, capacity)
    if len(falling) < len(bins):
        first = bins = falling
    where, offset, fill, before = (np.zeros(len(lengths), np.int64) for _ in range(4))
    for k, b in enumerate(first):
        before[b] = k
    moved = np.zeros(len(lengths), bool)
    for k, b in enumerate(bins):
        n = lengths[b]
        where[b], offset[b], fill[b] = k, np.cumsum(n) - n, n.sum()
        own = before[b]
        moved[b] = own != np.bincount(own, weights=n).argmax()
    return where, offset, fill, moved


def _packer(level: int, capacity: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        where, offset, fill, moved = pack_group(pdf["length"].to_numpy(np.int64), capacity)
        return pdf.drop(columns="grp").assign(sequence_id=(level << 58) + (int(key[0]) << 20) + where, offset=offset, moved=moved, fill=fill)

    return run


def pack(parts: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Sequences for rows with a column `length` (1 to capacity): adds sequence_id, offset and moved (brought
    to its sequence by the search). Rows must not have columns named row, grp, fill."""
    rows = written(parts.withColumn("row", F.monotonically_increasing_id()), "pieces")
    whole = rows.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("row"), "offset": F.lit(0).cast("long"), "moved": F.lit(False)})
    out = [whole.drop("row")]
    rest = rows.where(F.col("length") < capacity)
    names = [f.name for f in parts.schema.fields]
    for level in count():
        groups = -(-rest.count() // group)
        if not groups:
            break

        done = written(
            rest.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)))
            .groupBy("grp").applyInPandas(_packer(level, capacity), rest.schema.simpleString()[7:-1] + ", sequence_id long, offset long, moved boolean, fill long"),
            "packed",
        )
        if groups == 1:
            out.append(done.drop("row", "fill"))
            break
        out.append(done.where(F.col("fill") * 2 > capacity).drop("row", "fill"))
        rest = done.where(F.col("fill") * 2 <= capacity).select(*names, "row")
    result = out[0]
    for o in out[1:]:
        result = result.unionByName(o)
    return result


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset, moved."""
    return pack(pieces(docs, tokenizer, id_col, text_col, capacity, end_id), capacity)


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (array), starts (offsets of pieces).
    Ids of documents must be unique."""
    ids = pieces(docs, tokenizer, id_col, text_col, capacity, end_id, with_ids=True).select("id", "piece", "ids")
    return (
        packed.join(ids, ["id", "piece"])
        .groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
        .select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.offset").alias("starts"))
    )
