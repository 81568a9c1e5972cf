"""Toxicity by cumulative-link ordinal regression.

Grades 0..K are ordered. One weight vector over sparse text features is shared by all
thresholds: P(grade >= k | x) = sigmoid(w x - theta_k), theta_1 < ... < theta_K. A document's
expected severity is the sum of these probabilities; it is toxic if P(grade >= 1) is at least
`cut`.

Features: each word and its beginnings of PREFIXES characters (words of one stem share weights),
hashed to 2**HASH_BITS buckets. A bucket's value is log(1 + 100 * count / words of the text), so
what a long text holds by chance weighs little. Buckets stay if their document frequency among
rows of grade 1 and above departs from the expected one by Z standard deviations, with at least
MIN_DF such rows; of these the MAX_BUCKETS that depart most.

Where labels are only toxic or not, `grades_from_flags` grades the toxic training rows by the
share of their words that fall in toxic buckets, cut at the terciles.

The model is fitted on at most `max_rows` labelled rows, those with the smallest hash of the id;
every document is scored by its whole text.

Defined cases: a null or empty text has no features and is not toxic unless the thresholds say
so of an empty text; labelled rows without a label or text are not trained on; with no labelled
rows of both kinds nothing is toxic; repeated rows get equal scores.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import byte_words, map_batches, written

HASH_BITS = 20
#: Lengths of the beginnings of words that are features.
PREFIXES = (4, 5, 6, 7)
MIN_DF, Z = 5, 3.0
#: Buckets of the model at most.
MAX_BUCKETS = 4096
#: Labelled rows that the model is fitted on at most.
MAX_ROWS = 12_000
GRADES = 3


def _buckets(word: bytes) -> list[int]:
    """Buckets of a word and of its beginnings; a mark keeps them apart from whole words."""
    text = word.decode("utf-8", "replace")
    parts = [word, *(b"\x01" + text[:n].encode("utf-8", "replace") for n in PREFIXES if len(text) > n)]
    return [zlib.crc32(x) & ((1 << HASH_BITS) - 1) for x in parts]


def value(count: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The value of a feature that occurs `count` times among `words` words."""
    return np.log1p(100 * count / np.maximum(words, 1))


@dataclass(frozen=True)
class OrdinalModel:
    buckets: np.ndarray  # sorted
    weights: np.ndarray
    thetas: np.ndarray  # ascending

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= k), a column for each k from 1."""
        return _sigmoid(np.asarray(z)[:, None] - self.thetas[None, :])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def fit_ordinal(x: np.ndarray, grade: np.ndarray, n_grades: int, l2: float = 1e-4, steps: int = 400, rate: float = 0.1):
    """Weights and ascending thresholds by full-batch Adam on the mean log loss. theta_1 is
    free, each gap to the next one is exp of a free number."""
    n, f = x.shape
    k = n_grades - 1
    params = np.concatenate([np.zeros(f), [1.0], np.zeros(k - 1)])
    m, v = np.zeros_like(params), np.zeros_like(params)
    rows, x = np.arange(n), np.ascontiguousarray(x, np.float32)
    for step in range(1, steps + 1):
        w, first, gaps = params[:f], params[f], np.exp(params[f + 1 :])
        theta = np.concatenate([[first], first + np.cumsum(gaps)])
        s = _sigmoid((x @ w.astype(np.float32)).astype(float)[:, None] - theta)
        above = np.concatenate([np.ones((n, 1)), s, np.zeros((n, 1))], axis=1)
        p = np.maximum(above[rows, grade] - above[rows, grade + 1], 1e-9)
        slope = np.concatenate([np.zeros((n, 1)), s * (1 - s), np.zeros((n, 1))], axis=1)
        lower, upper = slope[rows, grade] / p, slope[rows, grade + 1] / p
        gz = -(lower - upper) / n
        g_theta = np.zeros(k + 2)
        np.add.at(g_theta, grade, lower / n)
        np.add.at(g_theta, grade + 1, -upper / n)
        g_theta = g_theta[1 : k + 1]
        tail = np.cumsum(g_theta[::-1])[::-1]
        grad = np.concatenate([(gz.astype(np.float32) @ x).astype(float) + l2 * w, [tail[0]], tail[1:] * gaps])
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        params = params - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    first, gaps = params[f], np.exp(params[f + 1 :])
    return params[:f], np.concatenate([[first], first + np.cumsum(gaps)])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, counts, words = [], [], []
        for text in batch.column("text").to_pylist():
            c: Counter = Counter()
            own = Counter(byte_words(text))
            for word, n in own.items():
                for b in _buckets(word):
                    c[b] += n
            keys.append(list(c))
            counts.append(list(c.values()))
            words.append(own.total())
        yield pa.RecordBatch.from_arrays(
            [batch.column("flag"), pa.array(words, pa.int64()), pa.array(keys, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
            ["flag", "words", "keys", "counts"],
        )


def select_buckets(sample: DataFrame) -> np.ndarray:
    """Buckets whose frequency among flagged rows departs from chance, ascending; at most
    MAX_BUCKETS of them reach the driver."""
    flagged = F.col("flag") > 0
    n, p = sample.agg(F.count("*"), F.avg(flagged.cast("double"))).first()
    if not n or not 0 < p < 1:
        return np.zeros(0, np.int64)
    each = sample.select(flagged.cast("int").alias("f"), F.explode("keys").alias("b"))
    count = each.groupBy("b").agg(F.count("*").alias("df"), F.sum("f").alias("hit"))
    z = (F.col("hit") - F.col("df") * p) / F.sqrt(F.col("df") * p * (1 - p))
    apart = count.withColumn("z", z).where(((F.col("z") >= Z) & (F.col("hit") >= MIN_DF)) | ((F.col("z") <= -Z) & (F.col("df") - F.col("hit") >= MIN_DF)))
    top = apart.orderBy(F.desc(F.abs("z")), "b").limit(MAX_BUCKETS).select("b")
    return np.sort(top.toArrow()["b"].to_numpy().astype(np.int64))


def _chosen_only(chosen: np.ndarray):
    """The chosen buckets of each row as places in `chosen`."""
    place = {b: i for i, b in enumerate(chosen.tolist())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = [], []
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                kept = [(place[k], c) for k, c in zip(keys, counts, strict=True) if k in place]
                at.append([k for k, _ in kept])
                n.append([c for _, c in kept])
            yield pa.RecordBatch.from_arrays(
                [batch.column("flag"), batch.column("words"), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))],
                ["flag", "words", "at", "counts"],
            )

    return run


def grades_from_flags(flag: np.ndarray, share: np.ndarray, n_grades: int) -> np.ndarray:
    """0 for rows without the flag; the others by the quantile of their share, from 1."""
    cuts = np.quantile(share[flag], np.arange(1, n_grades - 1) / (n_grades - 1)) if flag.any() else []
    return np.where(flag, 1 + np.searchsorted(cuts, share, side="right"), 0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        flag_col: str = "toxic", max_rows: int = MAX_ROWS, n_grades: int = GRADES + 1) -> OrdinalModel:
    """The model from labelled rows. The driver receives at most max_rows rows, of the chosen
    buckets only."""
    flags = (
        labels.where(F.col(flag_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id")).agg(F.max(flag_col).alias("flag"))
        .orderBy(F.xxhash64("id"), "id").limit(max_rows)
    )
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("binary").alias("text")).where("text is not null")
    sample = written(map_batches(
        rows.join(F.broadcast(flags), "id").select("text", F.col("flag").cast("int").alias("flag")),
        _hashed, "flag int, words long, keys array<int>, counts array<int>",
    ), "labelled")
    chosen = select_buckets(sample)
    if not len(chosen):
        return OrdinalModel(np.zeros(0, int), np.zeros(0), np.arange(n_grades - 1) + 10.0)
    got = map_batches(sample, _chosen_only(chosen), "flag int, words long, at array<int>, counts array<int>").toArrow()
    flag, total = got["flag"].to_numpy() > 0, got["words"].to_numpy()
    places, counts = got["at"].combine_chunks(), got["counts"].combine_chunks()
    doc = np.repeat(np.arange(len(flag)), np.diff(places.offsets.to_numpy()))
    at, count = places.flatten().to_numpy(), counts.flatten().to_numpy()
    x = np.zeros((len(flag), len(chosen)), np.float32)
    x[doc, at] = value(count, total[doc])
    toxic_side = (x[flag] > 0).mean(0) > 2 * (x > 0).mean(0)  # at least twice as frequent
    share = np.bincount(doc, weights=count * toxic_side[at], minlength=len(flag)) / np.maximum(total, 1)
    grade = grades_from_flags(flag, share, n_grades)
    weights, thetas = fit_ordinal(x, grade, n_grades)
    return OrdinalModel(chosen, weights, thetas)


class Scorer:
    """Log-odds that a text's grade is above a threshold of 0. The buckets of words are looked
    up once and kept."""

    def __init__(self, model: OrdinalModel) -> None:
        self.weight = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))
        self.known: dict[bytes, tuple[int, ...]] = {}

    def __call__(self, text: bytes | None) -> float:
        if len(self.known) > 500_000:
            self.known.clear()
        found: Counter = Counter()
        words = Counter(byte_words(text))
        for word, n in words.items():
            own = self.known.get(word)
            if own is None:
                own = self.known[word] = tuple(b for b in _buckets(word) if b in self.weight)
            for b in own:
                found[b] += n
        total = words.total()
        return sum(self.weight[b] * log1p(100 * n / total) for b, n in sorted(found.items()))


def _scored(model: OrdinalModel, cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_of = Scorer(model)
        for batch in batches:
            p = model.probabilities(np.array([score_of(t) for t in batch.column("text").to_pylist()], float))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(p.sum(1)), pa.array((p >= 0.5).sum(1).astype(np.int32)), pa.array(p[:, 0]), pa.array(p[:, 0] >= cut)],
                names=["id", "expected_severity", "grade", "p_toxic", "toxic"],
            )

    return run


OUT = "expected_severity double, grade int, p_toxic double, toxic boolean"


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """id, expected_severity, grade (largest k with P(grade >= k) >= 1/2), p_toxic, toxic."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("binary").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(rows, _scored(model, cut), f"id {kind}, {OUT}")


def drop_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """docs without the rows that the model calls toxic, all columns kept; one pass, no shuffle."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_of = Scorer(model)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist()
            z = np.array([score_of(t) for t in texts], float)
            yield batch.filter(pa.array(model.probabilities(z)[:, 0] < cut))

    return map_batches(docs, keep, docs.schema)
