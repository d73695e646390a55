"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text becomes a set of hashed features (words and their beginnings, runs of marks, bucketed shape
statistics); those that tell the grades of the fitted rows apart have weights. One
weight vector is shared by all grades; ordered thresholds cut its score s into grades:
P(grade <= k) = logistic(threshold_k - s). The expected grade and the tail probability
P(grade >= selected) follow from it; selection keeps texts whose tail probability is high enough.

The fit uses a bounded sample of the labelled rows (``FIT_ROWS``, the first by hash of the id, so the
same rows at any partitioning); their features are collected, at most ``DIMENSIONS`` of 4 bytes for
each. Scoring goes over all rows and whole texts, with the weights (``DIMENSIONS`` doubles) in the
task.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documented bounds of the fit: labelled rows used, features.
FIT_ROWS = 8000
DIMENSIONS = 1 << 21
#: A word also counts by its first so many letters.
BEGINNINGS = (3, 4, 5)
#: A feature needs so many fitted rows, and a shift of some grade's share by so many standard errors.
LEAST_ROWS, LEAST_SHIFT = 5, 4.0
PENALTY = 0.3
STEPS, RATE = 500, 0.15
#: Grades count what speaks for a text: 0 poor and toxic, 1 either, 2 neither. Kept: P(grade >= 2)
#: of at least this.
GRADES, SELECTED, LEAST_TAIL = 3, 2, 0.65

PIECES = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def bucket(share: float) -> int:
    return min(9, int(share * 10))


def hashed(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % DIMENSIONS


@lru_cache(maxsize=60_000)
def piece_features(piece: str) -> tuple[int, ...]:
    """A word itself and its beginnings, so that inflected words share weights; a run of marks."""
    if piece[0].isalpha():
        word = piece.lower()
        return tuple({hashed(f"w {word}"), *(hashed(f"b {word[:n]}") for n in BEGINNINGS if len(word) > n)})
    return () if piece[0].isdigit() else (hashed(f"m {piece[:4]}"),)


def shape(counts: Counter, text: str) -> dict[str, int]:
    """Bucketed statistics of a text with at least one piece."""
    total = sum(counts.values())
    words = {piece: n for piece, n in counts.items() if piece[0].isalpha()}
    marks = {piece: n for piece, n in counts.items() if not piece[0].isalnum()}
    n_words = sum(words.values())
    lines = text.split("\n")
    return {
        "words": min(14, int(math.log2(n_words + 1))),
        "upper": bucket(sum(n for w, n in words.items() if len(w) > 1 and w.isupper()) / max(n_words, 1)),
        "distinct": bucket(len(words) / max(n_words, 1)),
        "most": bucket(max(words.values(), default=0) / max(n_words, 1)),
        "marks": bucket(sum(marks.values()) / total),
        "long marks": bucket(sum(n for m, n in marks.items() if len(m) > 1) / total),
        "digits": bucket(sum(n for p, n in counts.items() if p[0].isdigit()) / total),
        "lines": bucket(len(set(lines)) / len(lines)),
        "word length": min(15, int(sum(len(w) * n for w, n in words.items()) / max(n_words, 1))),
    }


def features(text: str) -> np.ndarray:
    """Sorted distinct hashed features; none for a text without pieces."""
    pieces = PIECES.findall(text)
    counts = Counter(pieces)
    if not counts:
        return np.zeros(0, dtype=np.int32)
    found: set[int] = set()
    for piece in counts:
        found.update(piece_features(piece))
    found.update(hashed(f"s {name} {value}") for name, value in shape(counts, text).items())
    again = Counter(map(eq, pieces, pieces[1:]))[True]
    found.add(hashed(f"s again {min(9, again.bit_length())}"))
    return np.array(sorted(found), dtype=np.int32)


class Model(NamedTuple):
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, found: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        score = self.weights[found].sum()
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -500, 500)))


def grades(labels: DataFrame) -> DataFrame:
    """(id, grade) of each labelled document: one for quality, one for not being toxic.

    Rows without an id or a quality go; a null toxicity counts as none; of several ratings of one
    document the lowest holds.
    """
    points = (F.col("quality") == 1).cast("int") + (F.coalesce(F.col("toxic"), F.lit(0)) != 1).cast("int")
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .select(
            F.col("doc_id").cast("long").alias("labelled"),
            points.alias("grade"),
        )
        .groupBy("labelled")
        .agg(F.min("grade").alias("grade"))
    )


def fit_sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> list[tuple[int, np.ndarray]]:
    """(grade, features) of the sampled labelled documents that the table holds."""
    # Bounded by ``rows``, so it can be broadcast; texts stay where they are.
    sample = grades(labels).orderBy(F.xxhash64("labelled"), "labelled").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    labelled = texts.join(F.broadcast(sample), F.col("doc_id") == F.col("labelled")).select("doc_id", "grade", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(text.as_py()).tobytes() for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("grade"), pa.array(found, pa.binary())],
                names=["doc_id", "grade", "found"],
            )

    lines = labelled.mapInArrow(extract, "doc_id long, grade int, found binary").collect()
    lines.sort(key=lambda line: (line.doc_id, line.grade, bytes(line.found)))
    return [(line.grade, np.frombuffer(line.found, dtype=np.int32)) for line in lines]


def telling_features(rows: np.ndarray, columns: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which features have, among the rows that hold them, another share of some grade than all rows.

    Without this, the thousands of rare words of a long text would add up to noise.
    """
    held = np.bincount(columns, minlength=DIMENSIONS)
    shift = np.zeros(DIMENSIONS)
    for k in range(1, GRADES):
        share = np.mean(y >= k)
        hits = np.bincount(columns, weights=(y >= k)[rows].astype(float), minlength=DIMENSIONS)
        error = np.sqrt(np.maximum(held * share * (1 - share), 1e-9))
        shift = np.maximum(shift, np.abs(hits - held * share) / error)
    return (held >= min(LEAST_ROWS, len(y))) & (shift >= LEAST_SHIFT)


def fit(sample: list[tuple[int, np.ndarray]]) -> Model:
    """Maximum likelihood with a quadratic penalty, by Adam over all rows (deterministic).

    Without labelled rows all tails are 1: nothing is known against any text.
    """
    if not sample:
        return Model(np.zeros(DIMENSIONS), np.full(GRADES - 1, -500.0))
    y = np.array([grade for grade, _ in sample])
    rows = np.repeat(np.arange(len(sample)), [len(found) for _, found in sample])
    columns = np.concatenate([found for _, found in sample]) if len(rows) else np.zeros(0, np.int32)
    telling = telling_features(rows, columns, y)
    rows, columns = rows[telling[columns]], columns[telling[columns]]
    kept, columns = np.unique(columns, return_inverse=True)
    n = len(sample)
    start = [np.clip(np.mean(y < k), 0.01, 0.99) for k in range(1, GRADES)]
    # Thresholds stay ordered: the first, then logarithms of the gaps.
    logits = [math.log(p / (1 - p)) for p in start]
    free = np.concatenate([np.zeros(len(kept)), [logits[0]], np.log(np.maximum(np.diff(logits), 0.1))])
    mean, square = np.zeros_like(free), np.zeros_like(free)
    logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    for step in range(1, STEPS + 1):
        w, first, gaps = free[: len(kept)], free[len(kept)], np.exp(free[len(kept) + 1 :])
        cuts = first + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(rows, weights=w[columns], minlength=n)
        upper = np.where(y < GRADES - 1, logistic(cuts[np.minimum(y, GRADES - 2)] - score), 1.0)
        lower = np.where(y > 0, logistic(cuts[np.maximum(y - 1, 0)] - score), 0.0)
        likely = np.maximum(upper - lower, 1e-12)
        d_upper, d_lower = upper * (1 - upper) / likely, lower * (1 - lower) / likely
        by_score = d_upper - d_lower
        by_cut = [
            -(d_upper[y == k].sum() - d_lower[y == k + 1].sum()) for k in range(GRADES - 1)
        ]
        by_gap = [sum(by_cut[k:]) * gaps[k - 1] for k in range(1, GRADES - 1)]
        gradient = np.concatenate(
            [np.bincount(columns, weights=by_score[rows], minlength=len(kept)) + PENALTY * w, [sum(by_cut)], by_gap]
        )
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        rate = RATE * (1 - step / (STEPS + 1))
        free = free - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(DIMENSIONS)
    weights[kept] = free[: len(kept)]
    gaps = np.exp(free[len(kept) + 1 :])
    return Model(weights, free[len(kept)] + np.concatenate([[0.0], np.cumsum(gaps)]))


def fit_model(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    return fit(fit_sample(docs, labels, rows))


def judge(model: Model, text: str) -> tuple[float, float]:
    """(expected grade, tail probability). An empty text has no evidence: both are 0."""
    found = features(text)
    if not len(found):
        return 0.0, 0.0
    tails = model.tails(found)
    return float(tails.sum()), float(tails[SELECTED - 1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_grade and tail_probability of every row; null and empty texts score 0."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scored = [judge(model, text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([s[0] for s in scored], pa.float64()),
                    pa.array([s[1] for s in scored], pa.float64()),
                ],
                names=["doc_id", "expected_grade", "tail_probability"],
            )

    return texts.mapInArrow(run, "doc_id long, expected_grade double, tail_probability double")


def select(docs: DataFrame, model: Model, least_tail: float = LEAST_TAIL) -> DataFrame:
    """The rows of docs, all their columns, whose tail probability is at least ``least_tail``.

    Null and empty texts go. Rows are judged one by one, so repeated rows and ids fare alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place)
            yield batch.filter(
                pa.array([judge(model, text.as_py() or "")[1] >= least_tail for text in texts], pa.bool_())
            )

    place = docs.columns.index("text")
    return docs.mapInArrow(run, docs.schema)


def select_documents(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """The documents selected for training: doc_id, expected_grade and tail_probability."""
    return score(docs, fit_model(docs, labels, rows)).where(F.col("tail_probability") >= LEAST_TAIL)
