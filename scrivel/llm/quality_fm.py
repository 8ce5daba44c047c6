"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of a feature vector x is sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): the
sum-of-squares identity gives every pairwise interaction in time linear in the number of features.

Edge cases: a null text counts as empty and gets a score like any other; a null n_chars has a bin of its own; rows with
equal doc_id are scored one by one; labels other than 0 and 1, and labels without a document, are ignored, and a
document with contradicting labels takes their mean, at least 0.5 as 1. Without labels of both classes every score is
the smoothed share of label 1 (0.5 without any). Empty tables give no rows. Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections import Counter
from math import log1p, log2
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivel.llm.common import batch_of, bounded, map_rows, short, unused

WORDS = 1 << 15
RANK = 8
#: bounds on what the model is fitted on: labelled documents, and features of one of them (a longer text gives its most
#: frequent words); their feature vectors, 8 bytes a feature, go to the driver. Scoring takes all features of every text.
MAX_TRAIN_ROWS, MAX_TRAIN_FEATURES = 12_000, 4_096
THRESHOLD = 0.3

_UPPER, _DIGIT, _SYMBOL = bytes(range(65, 91)), bytes(range(48, 58)), b"#*$%&|<>"
_PUNCT, _MARK = b".,;:'\"()-", b"!?"
#: statistic -> upper edges of its bins
EDGES = {
    "log_chars": [3, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 16],
    "log_words": [0.5, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12],
    "word_len": [2, 3, 3.5, 4, 4.5, 5, 5.5, 6, 7, 8, 10, 15],
    "distinct": [0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97],
    "top_word": [0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3, 0.5],
    "same_next": [0.001, 0.01, 0.03, 0.06, 0.1, 0.2, 0.3, 0.5, 0.8],
    "dup_lines": [0.001, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.7],
    "upper": [0.005, 0.01, 0.02, 0.03, 0.05, 0.1, 0.2, 0.4, 0.6],
    "symbols": [0.0005, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2],
    "digits": [0.0005, 0.002, 0.005, 0.01, 0.03, 0.1, 0.3],
    "marks": [0.0005, 0.002, 0.01, 0.03, 0.1, 0.2],
    "punct": [0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1],
    "line_words": [2, 5, 10, 20, 40, 80, 160, 400],
    "meta_chars": [-0.5, 3, 5, 6, 7, 8, 9, 10, 11, 12, 14],
}
_NAMES = list(EDGES)
_BASE = dict(zip(_NAMES, WORDS + np.cumsum([0] + [len(EDGES[n]) + 1 for n in _NAMES[:-1]])))
DIM = int(_BASE[_NAMES[-1]] + len(EDGES[_NAMES[-1]]) + 1)
_FLAT = [(np.array(EDGES[n]), int(_BASE[n])) for n in _NAMES]


def statistics(text: str, n_chars: int | None) -> list[float]:
    """The structure statistics of a whole text, in the order of EDGES."""
    raw = text.encode("utf-8", "surrogatepass")
    size = max(len(raw), 1)
    words = text.split()
    n = len(words)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    return [
        log2(len(text) + 1),
        log2(n + 1),
        sum(map(len, words)) / n if n else 0.0,
        len(counts) / n if n else 0.0,
        max(counts.values()) / n if n else 0.0,
        sum(map(eq, words, words[1:])) / n if n else 0.0,
        (len(lines) - len(set(lines))) / len(lines) if lines else 0.0,
        share(_UPPER),
        share(_SYMBOL),
        share(_DIGIT),
        share(_MARK),
        share(_PUNCT),
        n / len(lines) if lines else 0.0,
        -1.0 if n_chars is None else log2(max(n_chars, 0) + 1),
    ]


def features(text: str | None, n_chars: int | None, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and values of a text's features; known caches word buckets."""
    text = text or ""
    counts: Counter = Counter()
    for word, k in Counter(text.lower().split()).items():
        at = known.get(word)
        if at is None:
            if len(known) > 500_000:
                known.clear()
            at = known[word] = crc32(word.encode("utf-8", "surrogatepass")) % WORDS
        counts[at] += k
    idx = np.fromiter(counts, np.int32, len(counts))
    val = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
    if len(val):
        val /= np.sqrt((val * val).sum())
    bins = [base + int(np.searchsorted(edges, x, "right")) for (edges, base), x in zip(_FLAT, statistics(text, n_chars))]
    return np.concatenate([idx, np.array(bins, np.int32)]), np.concatenate([val, np.full(len(bins), 0.5, np.float32)])


def strongest(idx: np.ndarray, val: np.ndarray, most: int = MAX_TRAIN_FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """At most so many features: those of the largest values, and all statistics."""
    if len(idx) <= most:
        return idx, val
    pick = np.sort(np.concatenate([np.argsort(-val[: -len(EDGES)], kind="stable")[: most - len(EDGES)], np.arange(len(idx) - len(EDGES), len(idx))]))
    return idx[pick], val[pick]


class Machine:
    """Weights of a factorisation machine; score() is its only use at scoring time."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    def margin(self, idx: np.ndarray, val: np.ndarray) -> float:
        rows = self.v[idx] * val[:, None]
        sums = rows.sum(0)
        return float(self.w0 + self.w[idx] @ val + 0.5 * (sums @ sums - (rows * rows).sum()))

    def score(self, idx: np.ndarray, val: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(idx, val), -30, 30))))


def constant(labels: list[int]) -> Machine:
    p = (sum(labels) + 1) / (len(labels) + 2)
    return Machine(float(np.log(p / (1 - p))), np.zeros(DIM, np.float32), np.zeros((DIM, RANK), np.float32))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], steps: int = 600, batch: int = 128, rate: float = 0.1, decay: float = 2e-5) -> Machine:
    """AdaGrad on the logistic loss, in mini-batches: six passes, and more on few rows, up to about so many steps. Deterministic."""
    if len(set(labels)) < 2:
        return constant(labels)
    rng = np.random.default_rng(7)
    start = constant(labels)
    w0, w, v = start.w0, start.w, rng.normal(0, 0.02, (DIM, RANK)).astype(np.float32)
    gw0, gw, gv = 1e-2, np.full(DIM, 1e-2, np.float32), np.full((DIM, RANK), 1e-2, np.float32)
    y = np.array(labels, np.float32)
    batch = min(batch, max(8, len(rows) // 16))
    for _ in range(max(6, min(60, steps * batch // len(rows)))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            idx = np.concatenate([rows[i][0] for i in pick])
            val = np.concatenate([rows[i][1] for i in pick])
            lens = np.array([len(rows[i][0]) for i in pick])
            starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
            vx = v[idx] * val[:, None]
            sums = np.add.reduceat(vx, starts)
            margin = w0 + np.add.reduceat(w[idx] * val, starts) + 0.5 * ((sums * sums).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
            err = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[pick]
            each = np.repeat(err, lens) * val
            used, inv = np.unique(idx, return_inverse=True)
            dw = np.bincount(inv, each, len(used)) / len(pick) + decay * w[used]
            pull = each[:, None] * (np.repeat(sums, lens, 0) - vx)
            dv = np.stack([np.bincount(inv, pull[:, f], len(used)) for f in range(RANK)], 1) / len(pick) + decay * v[used]
            d0 = float(err.mean())
            gw0 += d0 * d0
            gw[used] += dw * dw
            gv[used] += dv * dv
            w0 -= rate * d0 / gw0**0.5
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= rate * dv / np.sqrt(gv[used])
    return Machine(w0, w, v)


def held_out():
    """True for rows that never give a label: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Machine:
    """Fits the machine on at most max_rows labelled rows, the first by a hash of their id, none of them held out."""
    wanted = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
        .where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    # at most max_rows rows of two numbers: safe to broadcast
    sample = docs.select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars")).join(F.broadcast(wanted), "doc_id")
    schema = "doc_id long, y int, mark long, idx array<int>, val array<float>"

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        known: dict[str, int] = {}
        got = [strongest(*features(t, n, known)) for t, n in zip(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist())]
        return batch_of(schema, [batch.column("doc_id"), batch.column("y"), [crc32(g[0].tobytes() + g[1].tobytes()) for g in got], [g[0] for g in got], [g[1] for g in got]])

    # one row for each label, whichever of the rows with its id has the least mark, so no more than max_rows are collected
    vectors = map_rows(sample, extract, schema).groupBy("doc_id").agg(F.min_by(F.struct("y", "idx", "val"), F.struct("mark", "idx")).alias("one"))
    found = vectors.select("doc_id", "one.*").toArrow().sort_by([("doc_id", "ascending")])
    lists = lambda name, kind: [np.asarray(x.values, kind) for x in found.column(name)]
    return fit(list(zip(lists("idx", np.int32), lists("val", np.float32))), found.column("y").to_pylist())


def scored(docs: DataFrame, machine: Machine, *keep: str) -> DataFrame:
    """doc_id, the columns named in keep, and last the score, for every row and its whole text."""
    sent = docs.sparkSession.sparkContext.broadcast((machine.w0, machine.w, machine.v))  # a fixed number of weights
    columns = [f"`{c}`" for c in dict.fromkeys(["doc_id", "text", "n_chars", *keep])]
    out = list(dict.fromkeys(["doc_id", *keep]))
    kinds = dict(docs.dtypes)
    (name,) = unused(out, "_fm_score")
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in out) + f", `{name}` double"
    known: dict[str, int] = {}

    def run(batches):
        model = Machine(*sent.value)
        for batch in short(batches):
            score = [model.score(*features(t, n, known)) for t, n in zip(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out), pa.array(score, pa.float64())], names=[*out, name])

    return bounded(docs.select(*columns)).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 where score >= threshold)."""
    return scored(docs.select("doc_id", "text", "n_chars"), train(docs, labels)).select(
        "doc_id", held_out().alias("held_out"), F.col("_fm_score").alias("score"), (F.col("_fm_score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier accepts, with all their columns unchanged."""
    every = scored(docs, train(docs, labels), *docs.columns)
    return every.where(F.col(f"`{every.columns[-1]}`") >= threshold).select(*[f"`{c}`" for c in docs.columns])
