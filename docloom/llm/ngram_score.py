"""Word n-gram scores over tables that grow with the corpus.

Two matched bigram models over words (`common.WORD_RX`), one of the target documents and one of all
documents (background), with one shared vocabulary: all V different words of the whole corpus.
Before a text stands a mark. Both models use the interpolated estimate

    P(c)     = (n(c) + MU / V) / (N + MU)
    P(c | b) = (n(b c) + MU * P(c)) / (n(b) + MU)

n(b) counts b also where a text ends with it, so an end of text has the share that is left; it is
not scored. A word's loss is -log2 P(c | b). No word or bigram is dropped and nothing that is
counted is broadcast. Counts are tables dealt by the hash of the gram: each chunk of documents
asks the parts for its different grams, every part adds up what all chunks brought and answers
each chunk with the corpus counts of its grams, and the chunk scores its documents from the
answers. A gram takes at most one entry a chunk, so a frequent gram makes no large task. Parts
grow in number with the words of the corpus, so that each stays of one size.

Words and bigrams are known by 64-bit hashes; two of m different grams share one with a
probability of about m * m / 2**65. Which documents are target documents is found by a join of
ids and joined to the chunks as places; nothing of that passes through the driver's Python. A row goes from a chunk to
a part only if it has grams, so there are never more rows than grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import byte_words, map_batches, written

MU = 64.0
CHUNK = 2 << 20  # bytes of text
CHUNK_DOCS = 1 << 16  # documents of a chunk at most
#: Places of target documents that are broadcast at most (16 MB).
BROADCAST_PLACES = 1 << 22
PARTS = 256  # at least; a part holds its share of the different grams of all chunks
PART_WORDS = 1 << 22  # words of the corpus for each part
MARK = np.uint64(0x9E3779B97F4A7C15)
_HOME = "chunk long, ids array<{0}>, words long, home binary"
_ASK = "part int, chunk long, kind int, grams binary, n binary, t binary"


def _pair(b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Hash of a bigram from the hashes of its words (uint64, wraps around)."""
    x = b * np.uint64(0xBF58476D1CE4E5B9) + (c ^ (c >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def _packed(*arrays: np.ndarray) -> bytes:
    """The arrays byte by byte: first the lowest bytes of all numbers, then the next ones, compressed."""
    sizes = np.array([a.size for a in arrays], np.int64).tobytes()
    raw = sizes + b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(data: bytes, *kinds: type) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    sizes, at, out = np.frombuffer(raw, np.int64, len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        wide = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * wide, at).reshape(wide, n).T).view(kind).reshape(-1))
        at += n * wide
    return out


def _packed_grams(keys: np.ndarray, parts: int) -> bytes:
    """Ascending numbers of one part, by the steps between their quotients."""
    return _packed(np.diff(keys // np.uint64(parts), prepend=np.uint64(0)))


def _unpacked_grams(data: bytes, part: int, parts: int) -> np.ndarray:
    return np.cumsum(_unpacked(data, np.uint64)[0], dtype=np.uint64) * np.uint64(parts) + np.uint64(part)


def _homes(batches: Iterator[pa.RecordBatch], most: int, docs: int) -> Iterator[pa.RecordBatch]:
    """Chunks of at least `most` bytes, the last one excepted: ids; number of words; hash of each
    different word, lengths of texts and words as numbers."""
    from pyspark import TaskContext

    chunk = TaskContext.get().partitionId() << 32
    ids, lens, words, known, size, kind = [], [], [], {}, 0, None

    def row() -> pa.RecordBatch:
        h = np.array([xxhash.xxh3_64_intdigest(w) for w in known], np.uint64)
        data = _packed(h, np.array(lens, np.int32), np.concatenate(words) if words else np.zeros(0, np.int32))
        return pa.RecordBatch.from_arrays(
            [pa.array([chunk], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([sum(lens)], pa.int64()), pa.array([data], pa.binary())],
            ["chunk", "ids", "words", "home"],
        )

    for batch in batches:
        kind = batch.column(0).type
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            w = byte_words(text)
            ids.append(key)
            lens.append(len(w))
            words.append(np.array([known.setdefault(x, len(known)) for x in w], np.int32))
            size += len(text or b"")
            if size >= most or len(ids) >= docs:
                yield row()
                chunk, ids, lens, words, known, size = chunk + 1, [], [], [], {}, 0
    if ids:
        yield row()


def _grams(home: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of texts, and for every word its text's number, its context's hash and its hash."""
    h, lens, seq = _unpacked(home, np.uint64, np.int32, np.int32)
    c = h[seq] if len(seq) else np.zeros(0, np.uint64)
    b = np.empty_like(c)
    b[1:] = c[:-1]
    starts = np.cumsum(lens) - lens
    b[starts[lens > 0]] = MARK
    return lens, np.repeat(np.arange(len(lens)), lens), b, c


def _asked(text: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple:
    """The two kinds of grams of a chunk, each with the number of its text: its words and a mark
    for each text with words; its bigrams."""
    texts = np.unique(text)
    return (np.concatenate([c, np.full(len(texts), MARK)]), np.concatenate([text, texts])), (_pair(b, c), text)


def ngram_scores(docs: DataFrame, target: DataFrame, parts: int | None = None, chunk: int = CHUNK, chunk_docs: int = CHUNK_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, loss_target, loss_background, ce_diff (bits a word). target: ids (a column
    named as id_col). A text without words has null losses; an empty target gives 1 / V
    everywhere; repeated rows count each time; target ids without a document change nothing."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("binary").alias("text"))
    homes = written(map_batches(rows, lambda batches: _homes(batches, chunk, chunk_docs), _HOME.format(kind)), "homes")
    words = homes.agg(F.sum("words")).first()[0] or 0
    parts = parts or max(PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // PART_WORDS))
    places = homes.select("chunk", F.posexplode("ids").alias("pos", "id"))
    ids = target.select(F.col(id_col).alias("id")).distinct().hint("merge")
    # the places of target documents, four bytes each: broadcast to the chunks where they were counted to be few, else merged
    flags = written(places.join(ids, "id", "left_semi").groupBy("chunk").agg(F.sort_array(F.collect_list("pos")).alias("near")), "targets")
    few = (flags.agg(F.sum(F.size("near"))).first()[0] or 0) <= BROADCAST_PLACES
    flagged = homes.select("chunk", "home").join(F.broadcast(flags) if few else flags.hint("merge"), "chunk", "left")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, home, places in zip(batch.column("chunk").to_pylist(), batch.column("home").to_pylist(), batch.column("near"), strict=True):
                lens, text, b, c = _grams(home)
                near = np.zeros(len(lens), bool)
                if places.is_valid:
                    near[places.values.to_numpy()] = True
                for k, (g, of_text) in enumerate(_asked(text, b, c)):
                    keys, inverse, n = np.unique(g, return_inverse=True, return_counts=True)
                    t = np.bincount(inverse[near[of_text]], minlength=len(keys))
                    of = (keys % np.uint64(parts)).astype(np.int64)
                    order = np.argsort(of, kind="stable")
                    cuts = np.searchsorted(of[order], np.arange(parts + 1))
                    out = [[], [], []]
                    held = []
                    for p in range(parts):
                        at = order[cuts[p] : cuts[p + 1]]
                        if len(at):
                            held.append(p)
                            out[0].append(_packed_grams(keys[at], parts))
                            out[1].append(_packed(n[at].astype(np.int32)))
                            out[2].append(_packed(t[at].astype(np.int32)))
                    size = len(held)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(held, pa.int32()), pa.array([chunk] * size, pa.int64()), pa.array([k] * size, pa.int32()), *(pa.array(x, pa.binary()) for x in out)],
                        ["part", "chunk", "kind", "grams", "n", "t"],
                    )

    def answer(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Corpus counts of each chunk's grams of one kind in one part, and the part's different
        grams, background and target tokens, marks left out."""
        grams = [_unpacked_grams(x, int(key[0]), parts) for x in pdf["grams"]]
        keys, inverse = np.unique(np.concatenate(grams), return_inverse=True)
        sums = [np.bincount(inverse, np.concatenate([_unpacked(x, np.int32)[0] for x in pdf[c]]), len(keys)).astype(np.int64) for c in ("n", "t")]
        ends = np.cumsum([len(g) for g in grams])[:-1]
        got = [_packed(*(s[i] for s in sums)) for i in np.split(inverse, ends)]
        real = keys != MARK
        return pd.DataFrame({
            "chunk": pdf["chunk"], "part": key[0], "kind": key[1], "counts": got,
            "v": int(real.sum()), "tokens": int(sums[0][real].sum()), "near": int(sums[1][real].sum()),
        })

    asks = map_batches(flagged, ask, _ASK)
    answers = written(
        asks.groupBy("part", "kind").applyInPandas(answer, "chunk long, part int, kind int, counts binary, v long, tokens long, near long"), "answers"
    )
    total = answers.where("kind = 0").groupBy("part").agg(*[F.max(x).alias(x) for x in ("v", "tokens", "near")]).agg(F.sum("v"), F.sum("tokens"), F.sum("near")).first()
    v, n_all, n_near = (int(x or 0) for x in total)

    def finish(key: tuple, home: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        ids = home["ids"].iloc[0]
        lens, text, b, c = _grams(home["home"].iloc[0])
        counts = []
        by = {(k, p): x for k, p, x in zip(got["kind"], got["part"], got["counts"], strict=True)}
        for k, (g, _) in enumerate(_asked(text, b, c)):
            keys, inverse = np.unique(g, return_inverse=True)
            of = (keys % np.uint64(parts)).astype(np.int64)
            order = np.argsort(of, kind="stable")
            cuts = np.searchsorted(of[order], np.arange(parts + 1))
            both = np.zeros((2, len(keys)))
            for p in range(parts):
                at = order[cuts[p] : cuts[p + 1]]
                if len(at):
                    both[:, at] = _unpacked(by[k, p], np.int64, np.int64)
            counts.append(both[:, inverse])
        word, pair = counts[0][:, : len(c)], counts[1]
        before = np.concatenate([counts[0][:, -1:], word[:, :-1]], axis=1)[:, : len(c)]
        before[:, b == MARK] = counts[0][:, -1:]  # the mark stands last
        with np.errstate(invalid="ignore", divide="ignore"):
            loss = []
            for m, n in ((1, n_near), (0, n_all)):
                p1 = (word[m] + MU / max(v, 1)) / (n + MU)
                p2 = (pair[m] + MU * p1) / (before[m] + MU)
                loss.append(np.where(lens > 0, np.bincount(text, -np.log2(p2), len(lens)) / lens, np.nan))
        out = pd.DataFrame({"id": list(ids), "n_tokens": lens.astype(np.int64), "loss_target": loss[0], "loss_background": loss[1], "ce_diff": loss[0] - loss[1]})
        return out.astype({x: object for x in ("loss_target", "loss_background", "ce_diff")}).where(out.notna(), None)

    return homes.groupBy("chunk").cogroup(answers.select("chunk", "part", "kind", "counts").groupBy("chunk")).applyInPandas(
        finish, f"id {kind}, n_tokens long, loss_target double, loss_background double, ce_diff double"
    )
