"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text's features are the presence of its words and marks and a few bins of its
shape, hashed into one weight vector. One score for a text and ordered
thresholds give the grades: P(grade <= k) = sigmoid(threshold_k - score). The
expected grade and the tail probability P(grade >= k) follow from the same
score, so every threshold of selection ranks texts alike.

The model is fitted on a bounded sample of labelled rows (`sample`, the rows
whose hashed ids are smallest); only their features, not texts, reach the
driver. Scoring reads every row's whole text.

Cases: a null or empty text has shape features only; rows with a null label or
id are not learned from; rows labelled twice count twice; without any labelled
row, or with one grade only, thresholds fall back to the grades' smoothed
frequencies; equal rows get equal scores.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, sliced

BUCKETS = 1 << 18
#: Labelled rows that the model is fitted on, at most.
SAMPLE = 12_000
#: Grades of the labels: harmful, poor, good.
GRADES = 3
#: A text is kept if P(grade = good) is this at least.
KEEP = 0.5
_TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]+")
_REMEMBERED = 100_000


def grade(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2)


class _Buckets(dict):
    def __missing__(self, token: str) -> int:
        bucket = crc32(token.encode()) % BUCKETS
        if len(self) >= _REMEMBERED:
            self.clear()
        self[token] = bucket
        return bucket


_BUCKET = _Buckets()


def _level(share: float) -> int:
    return min(9, int(share * 10))


def features(text: str | None) -> np.ndarray:
    """Sorted different buckets of a text."""
    text = text or ""
    tokens = set(_TOKEN.findall(text.lower()))
    words = text.split()
    n = max(1, len(words))
    lines = [line for line in text.split("\n") if line]
    upper = sum(map(str.isupper, words))
    marks = len(text) - sum(map(len, re.findall(r"[\w\s]+", text)))
    shape = (
        f"\nupper {_level(upper / n)}", f"\nmarks {_level(5 * marks / max(1, len(text)))}",
        f"\nlong {_level(sum(map(len, words)) / n / 20)}", f"\ndifferent {_level(len(set(words)) / n)}",
        f"\nlines {_level(len(set(lines)) / max(1, len(lines)))}", f"\nsize {len(words).bit_length()}",
    )
    return np.unique(np.array([_BUCKET[t] for t in (*tokens, *shape)], np.int32))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, buckets: np.ndarray) -> float:
        return float(self.weights[buckets].sum())

    def tails(self, score: float) -> np.ndarray:
        """P(grade >= k) for k from 1."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -60, 60)))


def _thresholds(grades: np.ndarray) -> np.ndarray:
    share = np.cumsum(np.bincount(grades, minlength=GRADES) + 1.0)[:-1] / (len(grades) + GRADES)
    return np.log(share / (1 - share))


def fit(rows: list[np.ndarray], grades: np.ndarray, epochs: int = 12, batch: int = 256, rate: float = 0.1, l1: float = 2e-4) -> Model:
    """Minimises the ordinal log loss with adaptive steps; an L1 step keeps weights without evidence at zero."""
    model = Model(np.zeros(BUCKETS), _thresholds(grades))
    if len(rows) == 0:
        return model
    seen = np.bincount(np.concatenate(rows), minlength=BUCKETS)
    rows = [r[seen[r] >= 3] for r in rows]
    w, theta = model.weights, model.thresholds
    w_past, theta_past = np.full(BUCKETS, 1e-6), np.full(len(theta), 1e-6)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        shuffled = order.permutation(len(rows))
        for start in range(0, len(rows), batch):
            chosen = shuffled[start : start + batch]
            idx = np.concatenate([rows[k] for k in chosen])
            owner = np.repeat(np.arange(len(chosen)), [len(rows[k]) for k in chosen])
            score = np.bincount(owner, w[idx], minlength=len(chosen))
            y = grades[chosen]
            # d log P / d score of P(y) = below(y) - below(y - 1), below(k) = sigmoid(theta_k - score)
            below = np.hstack([
                np.zeros((len(y), 1)), 1 / (1 + np.exp(-np.clip(theta[None, :] - score[:, None], -30, 30))), np.ones((len(y), 1))
            ])
            slope = below * (1 - below)
            at = np.arange(len(y))
            p = np.maximum(below[at, y + 1] - below[at, y], 1e-9)
            toward_score = (slope[at, y] - slope[at, y + 1]) / p
            g = np.bincount(idx, toward_score[owner], minlength=BUCKETS) / len(y)
            g_theta = np.zeros(len(theta) + 2)
            np.add.at(g_theta, y + 1, slope[at, y + 1] / p / len(y))
            np.add.at(g_theta, y, -slope[at, y] / p / len(y))
            g_theta = g_theta[1:-1]
            w_past += g * g
            theta_past += g_theta * g_theta
            step = rate / np.sqrt(w_past)
            w += step * g
            np.copyto(w, np.sign(w) * np.maximum(np.abs(w) - step * l1, 0))
            theta += rate / np.sqrt(theta_past) * g_theta
            theta.sort()
    return model


def learn(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text", row_id: str = "doc_id") -> Model:
    """Fit on at most `sample` labelled rows; the sampled labels have that bound, so they are broadcast and texts stay.

    An id may stand in many documents, so the bound holds once more for what they give, by the hash of the features; rows
    after that are not learned from.
    """
    known = labels.select(F.col(row_id).alias("_id"), grade(F.col("quality"), F.col("toxic")).cast("int").alias("_grade"))
    chosen = known.where("_id is not null and _grade is not null").orderBy(F.xxhash64("_id"), "_id", "_grade").limit(sample)
    rows = documents.select(F.col(row_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")

    def row(value, found):
        return found, features(value).tobytes()

    got = map_rows(
        rows, [F.col("_text"), F.col("_grade")], row, "grade int, buckets binary",
        pa.schema([("grade", pa.int32()), ("buckets", pa.binary())]), text_at=0,
    ).orderBy(F.xxhash64("buckets"), "buckets", "grade").limit(sample).collect()
    got.sort()
    return fit([np.frombuffer(b, np.int32) for _, b in got], np.array([g for g, _ in got], np.int64))


def grade_texts(df: DataFrame, model: Model, keep: float = KEEP, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row per input row: the id, `expected_grade`, `p_fair` (grade 1 or more), `p_good` (grade 2) and `keep`."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def row(key, value):
        tails = sent.value.tails(sent.value.score(features(value)))
        return key, float(tails.sum()), float(tails[0]), float(tails[1]), bool(tails[1] >= keep)

    out = map_rows(
        df, [F.col(row_id), F.col(text)], row,
        "row_id, expected_grade double, p_fair double, p_good double, keep boolean",
        pa.schema([("expected_grade", pa.float64()), ("p_fair", pa.float64()),
                   ("p_good", pa.float64()), ("keep", pa.bool_())]),
    )
    return out.select(F.col("row_id").cast(df.schema[row_id].dataType).alias(row_id), "expected_grade", "p_fair", "p_good", "keep")


def select_good(df: DataFrame, model: Model, keep: float = KEEP, text: str = "text") -> DataFrame:
    """The rows of `df` that the model keeps, all columns as they are; a worker is sent the text alone."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        found = []
        for part in sliced(texts):
            found += [bool(sent.value.tails(sent.value.score(features(t)))[1] >= keep) for t in part]
        return pa.array(found, pa.bool_())

    return df.where(good(F.col(text)))
