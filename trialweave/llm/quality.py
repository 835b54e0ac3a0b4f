"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds
cut its score: P(grade <= j) = logistic(theta_j - w.x).  Features are byte trigrams, n-grams
of the text's shape (letters by case, digits, punctuation as it is) and immediate word
repeats.  Fitted in numpy by AdaGrad over a bounded, hash-chosen sample of rated texts, in one task.

Defined results: a null or empty text has the score of an empty vector; equal rows get
equal results; without ratings the grade is null and nothing is selected against; an empty
table gives an empty one.  Ids are read as long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm.grams import Grams
from trialweave.llm.text import byte_table, encoded, slices
from trialweave.llm.training import fitted, labelled

#: Most rated texts used for training (and ``training.TRAIN_BYTES`` of text).
TRAIN_BOUND = 8_000
BITS, EPOCHS = 14, 6
_SPACE = byte_table("space")
_SHAPE = bytes(97 if b >= 128 or 97 <= b <= 122 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))


def _shape(text: bytes) -> bytes:
    """Shape with runs of letters or digits squeezed to two."""
    s = text.translate(_SHAPE)
    for c in (b"a", b"A", b"0"):
        while c * 3 in s:
            s = s.replace(c * 6, c * 2).replace(c * 3, c * 2)
    return s


def _lower(text: bytes) -> bytes:
    return text.translate(_SPACE)


def _repeats(text: bytes) -> bytes:
    """One byte per word: 1 if it is the same as the one before, 2 if as the one two before, else 0."""
    w = text.translate(_SPACE).split()
    if len(w) < 2:
        return bytes(len(w))
    same = np.zeros(len(w), np.uint8)
    h = np.fromiter(map(hash, w), np.int64, len(w))
    same[2:][h[2:] == h[:-2]] = 2
    same[1:][h[1:] == h[:-1]] = 1
    return same.tobytes()


GRAMS = Grams([(_lower, (3,)), (_shape, (3, 5)), (_repeats, (1,))], BITS)


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades

    def tails(self, texts: list[bytes]) -> np.ndarray:
        """P(grade > j) for each j: a row per text."""
        f = GRAMS.mean_weights(texts, self.weights[:, None])
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - f, -40, 40)))


def fit(texts: list[str], grades: list[int], n_grades: int, *, epochs: int = EPOCHS, rate: float = 0.5, seed: int = 5) -> OrdinalModel:
    """``grades`` are 0 .. n_grades - 1."""
    rng = np.random.default_rng(seed)
    vectors = GRAMS.vectors([t.encode("utf-8", "replace") for t in texts])
    # Frequent features move a mean vector most: AdaGrad evens the steps out.
    w, seen = np.zeros(GRAMS.width), np.full(GRAMS.width, 1e-8)
    share = np.bincount(grades, minlength=n_grades) / max(1, len(grades))
    cut = np.clip(np.cumsum(share)[:-1], 0.01, 0.99)
    theta = np.maximum.accumulate(np.log(cut / (1 - cut)) + 1e-3 * np.arange(n_grades - 1))
    theta_seen = np.full(n_grades - 1, 1e-8)
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs) + 0.02
        for i in rng.permutation(len(texts)):
            ids, x = vectors[i]
            f = float(w[ids] @ x)
            c = 1 / (1 + np.exp(np.clip(f - theta, -40, 40)))  # P(grade <= j)
            g = grades[i]
            hi, lo = (c[g] if g < n_grades - 1 else 1.0), (c[g - 1] if g else 0.0)
            d_hi, d_lo = hi * (1 - hi), lo * (1 - lo)
            p = max(hi - lo, 1e-9)
            back = (d_hi - d_lo) / p  # derivative of -log p with respect to f
            grad = back * x
            seen[ids] += grad * grad
            w[ids] -= lr * grad / np.sqrt(seen[ids])
            turn = np.zeros(n_grades - 1)
            if g < n_grades - 1:
                turn[g] -= d_hi / p
            if g:
                turn[g - 1] += d_lo / p
            theta_seen += turn * turn
            theta = theta - 0.1 * lr * turn / np.sqrt(theta_seen)
            theta = np.maximum.accumulate(theta)
    return OrdinalModel(w, theta)


def fit_on(docs: DataFrame, ratings: DataFrame, n_grades: int, *, bound: int = TRAIN_BOUND) -> OrdinalModel | None:
    """Model from ``docs(doc_id, text)`` and ``ratings(doc_id, grade)``."""
    some = ratings.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("label"))
    return fitted(labelled(docs, some, bound), partial(fit, n_grades=n_grades), bound=bound)


def grade(docs: DataFrame, model: OrdinalModel | None, *, tail_from: int = 1, least_tail: float = 0.5) -> DataFrame:
    """``docs(doc_id, text)`` to doc_id, expected_grade, tail_probability (grade at least ``tail_from``), selected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                if model is None:
                    values = [pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.array([True] * n, pa.bool_())]
                else:
                    tails = model.tails(encoded(part.column("text")))
                    tail = tails[:, tail_from - 1]
                    values = [pa.array(tails.sum(axis=1)), pa.array(tail), pa.array(tail >= least_tail)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *values], ["doc_id", "expected_grade", "tail_probability", "selected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, selected boolean")
