"""Writers of recordings, estimates and models."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from trialweave.plans.event_model import EventModel


def write_samples(samples: DataFrame, path: str) -> None:
    """Parquet by participant, so that participants are pruned when read."""
    samples.write.mode("overwrite").partitionBy("participant").parquet(path)


def write_event_probabilities_csv(probs: DataFrame, path: str) -> None:
    """Tidy CSV of participant, epoch, grp, event, sample, prob."""
    probs.write.mode("overwrite").csv(path, header=True)


def write_generating_events(triggers: DataFrame, path: str) -> None:
    """Triggers of a simulated recording as CSV, a folder per participant, each file in order of the samples."""
    rows = triggers.select("participant", "sample", "prev", "code")
    rows.repartition("participant").sortWithinPartitions("participant", "sample", "code").write.mode("overwrite").partitionBy("participant").csv(path, header=True)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_model(model: EventModel, path: str, spark: SparkSession) -> None:
    """One JSON text, on whatever file system Spark writes to."""
    spark.createDataFrame([(json.dumps(model.save()),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_model(path: str, spark: SparkSession) -> EventModel:
    return EventModel.load(json.loads(spark.read.text(path).first()["value"]))
