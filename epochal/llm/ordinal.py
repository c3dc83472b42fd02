"""Quality classifier: cumulative-link (ordinal) regression on graded ratings.

Grades are 0, 1, ..., here 0 for a toxic document, 1 for a low-quality one and 2
for a good one. One weight vector over hashed text features is shared by all
grades; ordered thresholds cut its score:

    P(grade >= j) = sigmoid(score - threshold_j),  threshold_1 < threshold_2 < ...

The model gives a document's expected grade (the sum of these probabilities) and
the tail probability of the top grade, by which documents are selected.

Features: the document's distinct words, in lower case without outer
punctuation, hashed to ``BINS`` bins, and bins for shares of symbols, capitals,
bars and repeated words, and for length. It is fitted on at most
``MAX_TRAIN_ROWS`` labelled rows (in hash order of their ids), keeping features
whose mean grade differs significantly; their weights are shrunk. Scoring runs
over all documents and whole texts. The fit is deterministic.

Null text has no words. Labels with a null id, quality or toxicity are left out;
of several labels of an id the lowest grade counts. Without any label every
document gets the same score. Rows and ids may repeat: of rows that share a
labelled id, the text of least hash is fitted, once, and all are scored. Texts
of any length are read whole; equal texts get equal scores. An empty table gives
an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, slices

BINS = 1 << 18
MAX_TRAIN_ROWS = 8000
#: Words whose bins a task remembers.
CACHED = 200_000
SHAPES = 64
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_UPPER = bytes(range(65, 91))
_SYMBOLS = b"#*$%&|<>!"


def word_bin(token: str) -> int:
    w = _EDGE.sub("", token).lower()
    return SHAPES + zlib.crc32(w.encode()) % (BINS - SHAPES) if w else -1


def shapes(text: str, tokens: list[str], distinct: int) -> list[int]:
    """Bins 0 to SHAPES - 1."""
    n, raw = max(1, len(tokens)), text.encode()
    share = lambda part, whole: min(7, int(8 * part / max(1, whole)))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    upper = len(raw) - len(raw.translate(None, _UPPER))
    return [share(symbols, n), 8 + share(2 * upper, len(raw)), 16 + share(2 * raw.count(b"|"), n), 24 + share(n - distinct, n), 32 + min(15, int(math.log2(n)) if tokens else 0)]


@dataclass
class Model:
    weights: dict[int, float]
    thresholds: list[float]
    cache: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"weights": self.weights, "thresholds": self.thresholds, "cache": {}}

    def score(self, text: str | None) -> float:
        tokens = (text or "").split()
        distinct = set(tokens)
        w, cache, s = self.weights, self.cache, 0.0
        if len(cache) > CACHED:
            cache.clear()
        seen = set()
        for t in distinct:
            b = cache.get(t)
            if b is None:
                b = word_bin(t)
                cache[t] = b = b if b in w else -1
            if b >= 0:
                seen.add(b)
        seen.update(shapes(text or "", tokens, len(distinct)))
        return float(sum(w.get(b, 0.0) for b in sorted(seen)))

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ..., one column each."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - np.array(self.thresholds)[None, :], -500, 500)))


def features(text: str | None) -> np.ndarray:
    tokens = (text or "").split()
    distinct = set(tokens)
    bins = {b for b in map(word_bin, distinct) if b >= 0}
    bins.update(shapes(text or "", tokens, len(distinct)))
    return np.array(sorted(bins), np.int32)


def train(rows: list[np.ndarray], grades: np.ndarray, n_grades: int = 3, steps: int = 300, rate: float = 0.1, shrink: float = 1e-3, z: float = 4.0) -> Model:
    """Fits weights and thresholds by full-batch Adam on the log-likelihood."""
    n = len(rows)
    if not n:
        return Model({}, [float(j) for j in range(n_grades - 1)])
    size = np.array([len(r) for r in rows])
    col, row = np.concatenate(rows).astype(np.int64), np.repeat(np.arange(n), size)
    count = np.bincount(col, minlength=BINS)
    centred = grades - grades.mean()
    sd = max(1e-9, centred.std())
    mean = np.bincount(col, centred[row], BINS) / np.maximum(count, 1)
    keep = (np.abs(mean) * np.sqrt(count) >= z * sd) & (count >= 5)
    keep[:SHAPES] = True
    ids = np.flatnonzero(keep)
    used = keep[col]
    row, col = row[used], (np.cumsum(keep) - 1)[col[used]]
    k = n_grades - 1
    share = np.array([(grades >= j).mean() for j in range(1, n_grades)]).clip(1e-3, 1 - 1e-3)
    first = -np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(first), 1e-2))
    p = np.concatenate([np.zeros(len(ids)), first[:1], gaps])
    m = v = np.zeros_like(p)
    weight = 1 / np.bincount(grades, minlength=n_grades).clip(1)[grades]
    weight *= n / weight.sum()
    for t in range(1, steps + 1):
        w, cuts = p[: len(ids)], p[len(ids)] + np.concatenate([[0], np.cumsum(np.exp(p[len(ids) + 1 :]))])
        f = np.bincount(row, w[col], n)
        s = 1 / (1 + np.exp(-np.clip(f[:, None] - cuts[None, :], -60, 60)))
        upper = np.concatenate([np.ones((n, 1)), s], 1)[np.arange(n), grades]
        lower = np.concatenate([s, np.zeros((n, 1))], 1)[np.arange(n), grades]
        prob = np.maximum(upper - lower, 1e-12)
        df = weight * (1 - upper - lower)
        slope = s * (1 - s)
        cut_grad = np.zeros(k)
        for j in range(k):
            cut_grad[j] = -(weight * slope[:, j] / prob)[grades == j + 1].sum() + (weight * slope[:, j] / prob)[grades == j].sum()
        g = np.concatenate([np.bincount(col, df[row], len(ids)) / n - shrink * w, [cut_grad.sum() / n], [cut_grad[j + 1 :].sum() * np.exp(p[len(ids) + 1 + j]) / n for j in range(k - 1)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    cuts = p[len(ids)] + np.concatenate([[0], np.cumsum(np.exp(p[len(ids) + 1 :]))])
    return Model({int(i): float(x) for i, x in zip(ids, p) if x}, [float(c) for c in cuts])


def graded(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, grade)`` from quality and toxicity labels."""
    ok = F.col(id_col).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull()
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1)
    return labels.filter(ok).groupBy(id_col).agg(F.min(grade).alias("grade"))


def fit(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_TRAIN_ROWS, n_grades: int = 3) -> Model:
    """Model from ``ratings (id, grade)``, on ``max_rows`` of them at most."""
    chosen = ratings.orderBy(F.xxhash64(id_col, F.lit(11)), id_col).limit(max_rows)

    @released
    def extract(batches):
        for b in (x for whole in batches for x in slices(whole, text_col)):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features(t).tobytes() for t in b.column(2).to_pylist()], pa.binary())], names=["id", "grade", "bins"])

    kind = dict(docs.dtypes)[id_col]
    # max_rows rows of two numbers; of rows that repeat an id, the text of least hash.
    train_rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)
    train_rows = train_rows.groupBy(id_col).agg(F.first("grade").alias("grade"), F.min(F.struct(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))).alias("x")).select(F.col(id_col), "grade", F.col("x.t").alias(text_col))
    rows = sorted(train_rows.mapInArrow(extract, f"id {kind}, grade int, bins binary").collect(), key=lambda r: (r["id"], r["bins"]))  # max_rows documents' bins
    return train([np.frombuffer(r["bins"], np.int32) for r in rows], np.array([r["grade"] for r in rows], np.int64), n_grades)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.35) -> DataFrame:
    """Per document: id, score, expected_grade, p_tail (top grade), kept (``p_tail >= cut``)."""

    @released
    def run(batches):
        for b in (x for whole in batches for x in slices(whole, text_col)):
            s = np.array([model.score(t) for t in b.column(1).to_pylist()], np.float64)
            p = model.tails(s)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array(p.sum(axis=1)), pa.array(p[:, -1]), pa.array(p[:, -1] >= cut)], names=[id_col, "score", "expected_grade", "p_tail", "kept"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, expected_grade double, p_tail double, kept boolean")
