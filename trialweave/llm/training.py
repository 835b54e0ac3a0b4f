"""Fitting of models on bounded samples of labelled texts, in one task away from the driver."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm.shared import Scratch

#: Most bytes of text that a model is fitted on.
TRAIN_BYTES = 48 << 20


def bounded_sample(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """About ``bound`` rows, the same ones each time: those whose key hashes low.

    ``rows`` should be narrow (ids and labels): it is counted once.
    """
    n = rows.count()
    if n <= bound:
        return rows
    share = int(bound / n * (1 << 30))
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30)) < share)


def labelled(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """(doc_id, label, text) of the texts of at most ``bound`` rows of ``labels(doc_id, label)``."""
    some = bounded_sample(labels.where("doc_id is not null and label is not null").distinct(), "doc_id", bound).orderBy(F.xxhash64("doc_id", "label")).limit(bound)
    return docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id").select("doc_id", "label", "text")  # ``bound`` narrow rows


def fitted(rows: DataFrame, fit: Callable[[list[str], list[Any]], Any], *, bound: int, most_bytes: int = TRAIN_BYTES) -> Any:
    """``fit(texts, labels)`` on rows of ``rows(doc_id, label, text)``, or None without rows.

    Equal rows count once.  At most ``bound`` rows, and ``most_bytes`` of text, are taken in the order of
    a hash; a text that no longer fits is passed over.  ``rows`` are read once, into a table; only sizes
    come to the driver; the texts go to one task, which sends back the model."""
    scratch = Scratch(rows.sparkSession, "training")
    keyed = rows.withColumn("text_key", F.xxhash64("text")).groupBy("doc_id", "label", "text_key").agg(F.first("text").alias("text"))
    kept = scratch.table(keyed, "texts")
    order = F.xxhash64("doc_id", "text_key", "label")
    sizes = kept.select("doc_id", "label", "text_key", F.octet_length("text").alias("size")).orderBy(order, "doc_id", "label").limit(bound).collect()
    left, chosen = most_bytes, []
    for r in sizes:
        if r["size"] <= left:
            left -= r["size"]
            chosen.append((r["doc_id"], r["label"], r["text_key"]))
    if not chosen:
        scratch.close()
        return None
    kinds = dict(kept.dtypes)
    some = rows.sparkSession.createDataFrame(chosen, f"_id {kinds['doc_id']}, _label {kinds['label']}, _key long")
    on = kept["doc_id"].eqNullSafe(some["_id"]) & (kept["label"] == some["_label"]) & (kept["text_key"] == some["_key"])
    taken = kept.join(F.broadcast(some), on, "left_semi")  # ``bound`` narrow rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("doc_id", "label", "text")), strict=True)]
        found.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
        model = fit([r[2] for r in found], [r[1] for r in found])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    model = taken.repartition(1).mapInArrow(run, "model binary").first()["model"]
    scratch.close()
    return pickle.loads(model)
