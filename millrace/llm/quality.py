"""Quality by ordinal cumulative-link regression on graded ratings.

A rated text has a grade: 0 where it is rated toxic, 1 where its quality is
rated low, 2 otherwise. One weight vector over hashed text features gives a
score; ordered thresholds cut the logistic scale into grades, so P(grade <= k)
is the logistic function of threshold k minus the score. Selection uses the
expected grade and the tail probability P(grade = 2).

The model is fitted on at most TRAIN_ROWS rated rows (those whose ids hash
lowest), by proximal gradient steps with an L1 penalty; every row is scored
on its whole text.

Defined results: null and empty texts have no features and get the
probabilities of score 0; ratings with a null part, or whose text is missing,
aren't used; a row rated more than once has its lowest grade; without any usable
rating every row has the top grade; repeated rows score alike; extra columns
pass through unless named like an output.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rated rows that the model is fitted on at most.
TRAIN_ROWS = 12_000
#: Hash buckets of features; grades; L1 penalty a row; steps; the tail probability from which a row is kept.
BUCKETS, GRADES, PENALTY, STEPS, KEEP = 1 << 18, 3, 2e-4, 120, 0.5
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_ASCII, _SMALL = bytes(range(128)), bytes(set(range(256)) - set(range(ord("A"), ord("Z") + 1)))


def upper_count(text: str) -> int:
    """How many of a text's characters are upper-case."""
    if text.isascii():
        return len(text.encode().translate(None, _SMALL))
    data = text.encode("utf-8", "surrogatepass")
    return len(data.translate(None, _SMALL)) + sum(map(str.isupper, data.translate(None, _ASCII).decode("utf-8", "surrogatepass")))


def features(text: str | None) -> np.ndarray:
    """The hash buckets of a text: its tokens, and the levels of three ratios."""
    tokens = _TOKEN.findall((text or "").lower())
    if not tokens:
        return np.zeros(0, dtype=np.int32)
    seen = set(tokens)
    upper = upper_count(text)
    marks = {f"\x00distinct{int(8 * len(seen) / len(tokens))}" if len(tokens) >= 20 else "\x00few", f"\x00upper{int(8 * upper / len(text))}"}
    marks.add(f"\x00again{min(4, int(16 * sum(a == b for a, b in zip(tokens, tokens[1:], strict=False)) / len(tokens)))}")
    crc = zlib.crc32
    return np.unique(np.fromiter((crc(t.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for t in seen | marks), dtype=np.int32))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class OrdinalModel:
    """Weights by bucket and ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """P(grade = k) for each score."""
        below = _logistic(self.thresholds[None, :] - score[:, None])
        edge = np.ones((len(score), 1))
        return np.diff(np.hstack((0 * edge, below, edge)), axis=1)

    def score(self, found: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[x].sum() for x in found])


def fit(found: list[np.ndarray], grades: np.ndarray) -> OrdinalModel:
    """Fits by AdaGrad steps on the mean log-likelihood, each followed by the L1 penalty's shrinkage."""
    if not len(grades):
        return OrdinalModel(np.zeros(BUCKETS), np.array([-40.0, -35.0])[: GRADES - 1])
    at = np.concatenate(found) if found else np.zeros(0, dtype=np.int32)
    row = np.repeat(np.arange(len(found)), [len(x) for x in found])
    w, squares, n = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8), len(grades)
    share = np.cumsum(np.bincount(grades, minlength=GRADES) + 0.5)[:-1] / (n + 0.5 * GRADES)
    theta, theta_squares = np.log(share / (1 - share)), np.full(GRADES - 1, 1e-8)
    for _ in range(STEPS):
        score = np.bincount(row, weights=w[at], minlength=n)
        below = np.hstack((np.zeros((n, 1)), _logistic(theta[None, :] - score[:, None]), np.ones((n, 1))))
        slope = below * (1 - below)
        own = np.maximum(below[np.arange(n), grades + 1] - below[np.arange(n), grades], 1e-12)
        up, down = slope[np.arange(n), grades + 1] / own, slope[np.arange(n), grades] / own
        gradient = np.bincount(at, weights=(up - down)[row], minlength=BUCKETS) / n
        squares += gradient**2
        rate = 0.5 / np.sqrt(squares)
        w -= rate * gradient
        w = np.sign(w) * np.maximum(np.abs(w) - rate * PENALTY, 0)
        pull = np.array([(down[grades == k + 1].sum() - up[grades == k].sum()) / n for k in range(GRADES - 1)])
        theta_squares += pull**2
        theta = np.maximum.accumulate(theta - 0.3 / np.sqrt(theta_squares) * pull)
        theta[1:] = np.maximum(theta[1:], theta[:-1] + 1e-3)
    return OrdinalModel(w, theta)


def rated(labels: DataFrame, id_: str = "doc_id") -> DataFrame:
    """(id, grade) from ratings ``quality`` and ``toxic``."""
    usable = labels.filter(F.col(id_).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    grade = F.when(F.col("toxic") != 0, 0).when(F.col("quality") == 0, 1).otherwise(2)
    return usable.groupBy(id_).agg(F.min(grade).alias("grade"))


def train(docs: DataFrame, labels: DataFrame, id_: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> OrdinalModel:
    """Fits the model; the driver gets the features of ``rows`` rows at most."""
    chosen = rated(labels, id_).orderBy(F.xxhash64(id_), id_).limit(rows)
    texts = docs.select(id_, text).join(F.broadcast(chosen), id_).filter(F.col(text).isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("grade"), pa.array([features(x.as_py()).tobytes() for x in b.column("text")], pa.binary())], names=["grade", "found"])

    got = texts.select("grade", F.col(text).alias("text")).mapInArrow(run, "grade int, found binary").limit(rows).toArrow()
    order = sorted(range(got.num_rows), key=lambda i: (got["found"][i].as_py(), got["grade"][i].as_py()))
    return fit([np.frombuffer(got["found"][i].as_py(), dtype=np.int32) for i in order], np.array([got["grade"][i].as_py() for i in order], dtype=np.int64))


def grade(df: DataFrame, model: OrdinalModel, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with ``expected_grade``, ``tail_prob`` and ``keep``."""
    names = ["expected_grade", "tail_prob", "keep"]
    read = [c for c in df.columns if c not in names]
    kept = [c for c in read if keep_text or c != text]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField("expected_grade", T.DoubleType(), False), T.StructField("tail_prob", T.DoubleType(), False), T.StructField("keep", T.BooleanType(), False)])
    sent = df.sparkSession.sparkContext.broadcast((np.flatnonzero(model.weights), model.weights[model.weights != 0], model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, thresholds = sent.value
        own = OrdinalModel(np.zeros(BUCKETS), thresholds)
        own.weights[at] = values
        for b in batches:
            p = own.probabilities(own.score([features(x.as_py()) for x in b.column(b.schema.get_field_index(text))]))
            columns = [p @ np.arange(GRADES), p[:, -1], p[:, -1] >= KEEP]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), *map(pa.array, columns)], names=[*kept, *names])

    return df.select(*read).mapInArrow(run, schema)
