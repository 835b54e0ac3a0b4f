"""Language identification: averaged hashed subword embeddings with a linear softmax.

Subwords are the 3- and 4-byte grams of lower-cased words with their borders.  A text's
vector is the mean of its subwords' embeddings; a linear softmax gives the languages.
Training is plain stochastic gradient descent in numpy, in one task, over a bounded,
hash-chosen sample of labelled texts; a part of the sample is kept out to fit a temperature, so that scores
are calibrated, and the score under which a prediction is rejected.

Scoring multiplies embeddings and softmax once into a table of logits per subword; a text
costs one lookup per subword, whatever its length.

Defined results: a null text or one without a letter is ``und`` with score 0; equal rows
get equal results; of equally likely languages the first by name is taken; without any
labelled text all are ``und``; an empty table gives an empty one.  Ids are read as long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm.grams import Grams
from trialweave.llm.text import slices
from trialweave.llm.training import bounded_sample, fitted

#: Most labelled texts used for training (and ``training.TRAIN_BYTES`` of text).
TRAIN_BOUND = 6_000
BITS, DIM, EPOCHS, LEAST_STEPS = 16, 16, 4, 6_000
_TABLE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str) -> bool:
    if text.isascii():
        return not text.encode().translate(None, bytes(b for b in range(128) if chr(b).isalpha())) == text.encode()
    return any(map(str.isalpha, text))


def _words(text: bytes) -> bytes:
    return b" " + b" ".join(text.translate(_TABLE).split()) + b" "


GRAMS = Grams([(_words, (3, 4))], BITS)


@dataclass
class LanguageModel:
    languages: list[str]
    logits: np.ndarray  # subword bucket x language, divided by the temperature
    bias: np.ndarray
    reject_below: float

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        z = GRAMS.mean_weights(texts, self.logits) + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def fit(texts: list[str], languages: list[str], *, dim: int = DIM, epochs: int = EPOCHS, rate: float = 0.5, seed: int = 7) -> LanguageModel:
    names = sorted(set(languages))
    y = np.array([names.index(x) for x in languages])
    rng = np.random.default_rng(seed)
    vectors = GRAMS.vectors([t.lower().encode("utf-8", "replace") for t in texts])
    used = np.unique(np.concatenate([ids for ids, _ in vectors])) if vectors else np.zeros(0, np.int64)
    place = np.full(GRAMS.width, -1)
    place[used] = np.arange(len(used))
    vectors = [(place[ids], share) for ids, share in vectors]
    emb = rng.normal(0, 1 / dim, (len(used), dim))
    out, bias = np.zeros((dim, len(names))), np.zeros(len(names))
    order = rng.permutation(len(texts))
    dev, train = order[: len(order) // 5], order[len(order) // 5 :]
    steps = max(epochs * len(train), LEAST_STEPS)
    for step in range(steps if len(train) else 0):
        if step % len(train) == 0:
            rng.shuffle(train)
        i = train[step % len(train)]
        ids, share = vectors[i]
        lr = rate * (1 - step / steps) + 0.01
        h = share @ emb[ids]
        g = _softmax(h @ out + bias)
        g[y[i]] -= 1.0
        back = out @ g
        out -= lr * np.outer(h, g)
        bias -= lr * 0.1 * g
        # Shares are tiny: the step on embeddings is scaled by their squared length.
        emb[ids] -= lr / max(1e-9, float(share @ share)) * 0.2 * np.outer(share, back)
    raw = np.stack([share @ emb[ids] for ids, share in vectors]) @ out + bias if vectors else np.zeros((0, len(names)))
    held = dev if len(dev) else order
    temperature = min((0.25 * 1.25**k for k in range(24)), key=lambda t: -float(np.log(_softmax(raw[held] / t)[np.arange(len(held)), y[held]] + 1e-12).sum())) if len(held) else 1.0
    top = _softmax(raw[held] / temperature).max(axis=1) if len(held) else np.ones(1)
    logits = np.zeros((GRAMS.width, len(names)))
    logits[used] = emb @ out
    return LanguageModel(names, (logits / temperature).astype(np.float32), bias / temperature, float(np.quantile(top, 0.01)))


def _fit_lettered(texts: list[str], languages: list[str]) -> LanguageModel | None:
    rows = [(t, x) for t, x in zip(texts, languages, strict=True) if has_letter(t)]
    return fit([t for t, _ in rows], [x for _, x in rows]) if rows else None


def fit_on(docs: DataFrame, *, bound: int = TRAIN_BOUND) -> LanguageModel | None:
    """Model from ``docs(doc_id, text, lang)``, rows with both text and lang."""
    rows = docs.where("text is not null and lang is not null").select("doc_id", F.col("lang").alias("label"), "text")
    return fitted(bounded_sample(rows, "doc_id", bound), _fit_lettered, bound=bound)


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``docs(doc_id, text)`` to doc_id, lang_pred, score, accepted (score not under the rejection bound)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                ok = [model is not None and bool(t) and has_letter(t) for t in texts]
                names, scores = ["und"] * len(texts), [0.0] * len(texts)
                if any(ok):
                    p = model.probabilities([t.lower().encode("utf-8", "replace") for t, k in zip(texts, ok, strict=True) if k])
                    at = [i for i, k in enumerate(ok) if k]
                    for i, best, s in zip(at, p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
                        names[i], scores[i] = model.languages[best], min(1.0, s)
                accepted = [n != "und" and s >= model.reject_below for n, s in zip(names, scores, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())], ["doc_id", "lang_pred", "score", "accepted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")
