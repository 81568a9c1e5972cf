"""Near duplicates by DartMinHash signatures and banded joining.

A document is the weighted set of its five-word shingles, weighted by their counts; similarity
is the weighted Jaccard sum(min) / sum(max). A weight w takes w strips of unit width of an
element's region, and each cell of a strip and a unit of rank gets Poisson(1) darts whose number
and places follow from the hash of element, strip and cell. A dart has a coordinate and a rank;
the earliest dart of each coordinate is the signature. Ranks up to (k ln k + 2 k) / (total
weight) are thrown first, and more until no coordinate is empty, so the work for a document is
its weight plus k log k.

Documents with equal words are one node. Nodes that agree in a band are candidates: each bucket
compares its members with its most central one (the largest sum of bucket sizes), exactly, on the
shingles. Components of the links found are then known; what is compared last are members of a
bucket that are still in different components, so no link is lost to the star and groups of copies
give no pairs. Before that, strips that only one of these nodes has are counted: with w shared
strips of n, a pair's intersection is at most the smaller w, which bounds its similarity. Nodes
with w < 0.8 n have no partner and go, as do buckets left with one component; then the strips are
counted again among those that stay. What the bound rules out cannot be a link, so leaving it out
is exact.

Defined cases: a text of one to four words is one shingle; null texts and texts without words
are one class of their own kind (equal words); repeated rows fall in one class; null ids are
kept and sort first; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import byte_words, components, map_batches, written

WORDS = 5
SIMILAR = 0.8
#: k = BANDS * ROWS coordinates; a pair at 0.8 shares no band with probability (1 - 0.8**5)**24 < 1e-4.
BANDS, ROWS = 24, 5
#: Members that one task compares with a leader before the leader is repeated.
RUN = 512
#: Strips in a row of the table of strips.
CHUNK = 64
#: Times that shared strips are counted; any number gives the same links, further ones rule out little.
COUNTS = 2

_U = np.uint64
#: P(at most j darts) of Poisson(1).
_CDF = np.cumsum([np.exp(-1)] + list(np.exp(-1) / np.cumprod(np.arange(1.0, 18.0))))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (multiply and shift)."""
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def elements(docs: list[list[bytes]], hashes: Hashes, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(strips, bounds): the strip numbers of document i, sorted, are strips[bounds[i]:bounds[i + 1]].
    The j-th occurrence of a shingle is its strip j; the weighted Jaccard of two documents is the
    Jaccard of their strips."""
    n = np.array([len(d) for d in docs], np.int64)
    flat = np.fromiter((hashes[w] for d in docs for w in d), np.uint64, int(n.sum()))
    ends = np.cumsum(n)
    size = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    bounds = np.concatenate([[0], np.cumsum(size)])
    doc = np.repeat(np.arange(len(docs)), size)
    start = (ends - n)[doc] + np.arange(len(doc)) - bounds[doc]
    h = np.zeros(len(doc), np.uint64)
    for j in range(words):
        inside = start + j < ends[doc]
        at = np.minimum(start + j, max(len(flat) - 1, 0))
        h = np.where(inside, mix(h * _U(0x9E3779B97F4A7C15) + flat[at] + _U(j + 1)), h) if len(flat) else h
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        h[a:b].sort()
    k = np.arange(len(h))
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    layer = k - np.maximum.accumulate(np.where(new, k, 0))
    again = layer > 0
    if again.any():
        h[again] = mix(h[again] + layer[again].astype(np.uint64) * _U(0xA0761D6478BD642F))
        for d in np.unique(doc[again]).tolist():
            h[bounds[d] : bounds[d + 1]].sort()
    return h, bounds


def signatures(strips: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """k numbers for each document; a number names the earliest dart of a coordinate. All ones
    for documents without elements."""
    n = np.diff(bounds)
    out = np.full(len(n) * k, np.iinfo(np.uint64).max, np.uint64)
    throws = k * log(k) + 2 * k if k > 1 else 4.0
    ranks = np.ceil(throws / np.maximum(n, 1)).astype(np.int64)
    done, live = np.zeros(len(n), np.int64), np.flatnonzero(n)
    while len(live):
        steps = (ranks - done)[live]
        cells = n[live] * steps
        of = np.repeat(live, cells)
        i = np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
        rank = done[of] + i // n[of]
        cell = mix(strips[bounds[:-1][of] + i % n[of]] + (rank.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15))
        darts = np.searchsorted(_CDF, (cell >> _U(11)).astype(np.float64) * 2.0**-53, side="right")
        keep = np.repeat(np.arange(len(of)), darts)
        nth = np.arange(len(keep)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = mix(cell[keep] + (nth.astype(np.uint64) + _U(1)) * _U(0xE7037ED1A0B428DB))
        place = (dart >> _U(44)) % _U(k)
        value = (rank[keep].astype(np.uint64) << _U(44)) | (dart & _U((1 << 44) - 1))
        np.minimum.at(out, of[keep] * k + place.astype(np.int64), value)
        done[live] = ranks[live]
        empty = (out.reshape(-1, k)[live] == np.iinfo(np.uint64).max).any(axis=1)
        live = live[empty]
        ranks[live] *= 2
    return out.reshape(-1, k)


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit number for each band, its place included."""
    parts = sig.reshape(len(sig), -1, rows)
    h = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(rows):
        h = mix(h * _U(0x9E3779B97F4A7C15) + parts[:, :, r])
    return h.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = Hashes()
    for whole in batches:
        for at in range(0, whole.num_rows, 250):
            batch = whole.slice(at, 250)
            docs = [byte_words(t) for t in batch.column("text").to_pylist()]
            strips, bounds = elements(docs, hashes)
            b = bands(signatures(strips, bounds, BANDS * ROWS))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * BANDS), pa.array(b.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("h"), pa.array([xxhash.xxh3_128_digest(b" ".join(d)) for d in docs], pa.binary()), pa.array(np.diff(bounds)), lists],
                ["id", "h", "words", "n", "bands"],
            )


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted so that a leader stands before the members to compare with it."""
    hashes, lead, key = Hashes(), None, None
    for batch in batches:
        a, b, sim = [], [], []
        for dst, salt, node, words, text in zip(*(batch.column(c).to_pylist() for c in ("dst", "salt", "node", "words", "text")), strict=True):
            tokens = byte_words(text)
            if xxhash.xxh3_128_digest(b" ".join(tokens)) != words:
                continue  # another row with the same id
            own, _ = elements([tokens], hashes)
            if node == dst:
                lead, key = own, (dst, salt)
            elif key == (dst, salt):
                both = len(np.intersect1d(lead, own, assume_unique=True))
                a.append(dst), b.append(node), sim.append(both / (len(lead) + len(own) - both))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sim, pa.float64())], ["a", "b", "similarity"])


def _strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strips of each node, CHUNK in a row."""
    hashes = Hashes()
    for batch in batches:
        for node, words, text in zip(*(batch.column(c).to_pylist() for c in ("node", "words", "text")), strict=True):
            tokens = byte_words(text)
            if xxhash.xxh3_128_digest(b" ".join(tokens)) != words:
                continue  # another row with the same id
            own = elements([tokens], hashes)[0].view(np.int64)
            cuts = np.append(np.arange(0, len(own), CHUNK), len(own)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(own))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lists), node)), lists], ["node", "strips"])


def strips_of(some: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """node, strips: the strips of the nodes of `some`, in pieces."""
    wanted = written(some.select("node").distinct().join(nodes, "node"), "wanted")
    fetched = wanted.hint("merge").join(rows, wanted["id"].eqNullSafe(rows["id"])).select("node", "words", "text")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(map_batches(fetched, _strips, "node long, strips array<long>").repartition(n), "strips")


def several(open_: DataFrame) -> DataFrame:
    """The rows of buckets h that have more than one component comp."""
    split = open_.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("h")
    return open_.join(split, "h", "left_semi")


def bounded(open_: DataFrame, strips: DataFrame, similar: float) -> DataFrame:
    """open_ with w, the number of strips of a node that another node of open_ has too, without
    what cannot have a partner. A node that comes twice in strips counts as two, which only makes w larger."""
    each = strips.join(open_.select("node").distinct(), "node", "left_semi").select("node", F.explode("strips").alias("strip"))
    alone = each.groupBy("strip").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1")
    u = alone.groupBy("node").agg(F.count("*").alias("u"))
    w = open_.drop("w").join(u, "node", "left").withColumn("w", F.col("n") - F.coalesce("u", F.lit(0))).drop("u")
    return written(several(w.where(F.col("w") >= similar * F.col("n") - 1e-6)), "bounded")


def compared(pairs: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """a, b, similarity of pairs of nodes. A leader `a` with many partners is repeated for each
    RUN of them. nodes: node, id, words; rows: id, text (binary)."""
    runs = pairs.groupBy("a").agg(F.count("*").alias("c")).withColumn("runs", F.ceil(F.col("c") / RUN))
    leaders = runs.select(F.col("a").alias("dst"), F.explode(F.sequence(F.lit(0), (F.col("runs") - 1).cast("int"))).alias("salt"), F.col("a").alias("node"))
    members = pairs.join(runs, "a").select(
        F.col("a").alias("dst"), F.pmod(F.xxhash64("b"), F.col("runs")).cast("int").alias("salt"), F.col("b").alias("node")
    )
    visits = written(leaders.union(members).join(nodes, "node"), "visits")
    fetched = visits.hint("merge").join(rows, visits["id"].eqNullSafe(rows["id"])).select("dst", "salt", "node", "words", "text")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lined = fetched.repartition(n, "dst", "salt").sortWithinPartitions("dst", "salt", F.col("node") != F.col("dst"))
    return map_batches(lined, _compare, "a long, b long, similarity double").distinct()


def _sizes_allow(a: str, b: str, similar: float):
    """Whether two weights can belong to a similar pair: Jaccard is at most their ratio."""
    return F.least(a, b) >= similar * F.greatest(a, b)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row per row of docs: id, h (hash of its text), row, class_id (smallest id of its class), class_size (rows),
    n_links (compared nodes found similar to its node), kept (one row of each class)."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("binary").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    signed = written(
        map_batches(rows.withColumn("h", F.xxhash64("text")), _sign, f"id {kind}, h long, words binary, n long, bands array<long>")
        .withColumn("row", F.monotonically_increasing_id()),
        "signed",
    )
    first = signed.groupBy("words").agg(F.min("row").alias("node"))
    texts = signed.join(first.select(F.col("node").alias("row")), "row", "left_semi")
    nodes = texts.select(F.col("row").alias("node"), "id", "words")
    members = written(texts.where("n > 0").select(F.explode("bands").alias("h"), F.col("row").alias("node"), "n"), "bands")
    shared = members.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    placed = written(members.join(shared, "h"), "placed")
    central = placed.groupBy("node").agg(F.sum("c").alias("central"))
    leads = placed.join(central, "node").groupBy("h").agg(F.max(F.struct("central", "node", "n")).alias("l"))
    buckets = written(placed.drop("c").join(leads.select("h", F.col("l.node").alias("lead"), F.col("l.n").alias("lead_n")), "h"), "buckets")
    stars = written(buckets.where((F.col("node") != F.col("lead")) & _sizes_allow("n", "lead_n", similar)).select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    links = written(compared(stars, nodes, rows).where(F.col("similarity") >= similar), "links")
    comps = components(None, links.select("a", "b"))
    placed = buckets.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    open_ = written(several(placed.select("h", "node", "comp", "n")), "open")
    strips = strips_of(open_, nodes, rows)
    for _ in range(COUNTS):
        open_ = bounded(open_, strips, similar)
    own = open_.select("node").distinct().join(signed.select(F.col("row").alias("node"), "bands"), "node")
    open_ = written(open_.join(own, "node"), "open")
    other = open_.select("h", F.col("node").alias("node2"), F.col("comp").alias("comp2"), F.col("n").alias("n2"), F.col("w").alias("w2"), F.col("bands").alias("bands2"))
    both = F.least("w", "w2")
    met = (F.col("node") < F.col("node2")) & (F.col("comp") != F.col("comp2")) & (both >= similar * (F.col("n") + F.col("n2") - both) - 1e-6)
    once = met & (F.array_min(F.array_intersect("bands", "bands2")) == F.col("h"))  # a pair meets in the first bucket it shares
    known = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = written(
        open_.join(other, "h").where(once).select(F.col("node").alias("a"), F.col("node2").alias("b")).join(known, ["a", "b"], "left_anti"),
        "rest",
    )
    if not rest.isEmpty():
        links = links.union(written(compared(rest, nodes, rows).where(F.col("similarity") >= similar), "links"))
        comps = components(None, links.select("a", "b"))
    degree = links.select(F.col("a").alias("node"), F.col("b").alias("o")).union(links.select("b", "a")).groupBy("node").agg(F.countDistinct("o").alias("n_links"))
    at = written(
        first.join(comps, "node", "left").join(degree, "node", "left")
        .select("words", F.coalesce("comp", "node").alias("comp"), F.coalesce("n_links", F.lit(0)).alias("n_links")),
        "classes",
    )
    tagged = written(signed.select("id", "h", "row", "words").join(at, "words").drop("words"), "tagged")
    best = F.min(F.struct("id", "row"))
    sizes = tagged.groupBy("comp").agg(best.alias("best"), F.count("*").alias("class_size"))
    return tagged.join(sizes, "comp").select(
        "id", "h", "row", F.col("best.id").alias("class_id"), "class_size", "n_links", (F.col("row") == F.col("best.row")).alias("kept")
    )


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """docs with one row of each class, all columns kept. Rows are told apart by id and text; of
    rows that agree in both one stays."""
    kept = near_groups(docs, id_col, text_col, similar).where("kept").select(F.col("id").alias("__k_id"), F.col("h").alias("__k_h")).hint("merge")
    keyed = docs.withColumns({"__r_id": docs[id_col], "__r_h": F.xxhash64(docs[text_col].cast("binary"))})
    stay = keyed.join(kept, F.col("__r_id").eqNullSafe(F.col("__k_id")) & (F.col("__r_h") == F.col("__k_h")), "left_semi")
    return stay.dropDuplicates(["__r_id", "__r_h"]).select(*[F.col(f"`{c}`") for c in docs.columns])
