"""Preprocessing: standardising, centring, reduction of channels, z-scores."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from pyspark.sql.window import Window

from trialweave.operators import reduction, signal
from trialweave.schema import TRIAL, by_trial


class ZScore(Enum):
    ALL = "all"
    PARTICIPANT = "participant"
    TRIAL = "trial"
    NONE = "none"

    @classmethod
    def parse(cls, option: object) -> ZScore:
        if isinstance(option, cls):
            return option
        if option is None or option is False or option == "dont_apply":
            return cls.NONE
        if option is True:
            return cls.TRIAL
        return cls(str(option).lower())


class Method(Enum):
    PCA = "pca"
    MCCA = "mcca"
    NONE = "none"

    @classmethod
    def parse(cls, option: object) -> Method:
        if isinstance(option, cls):
            return option
        return cls.NONE if option in (None, "no_analysis") else cls(str(option).lower())


def drop_incomplete(samples: DataFrame) -> DataFrame:
    """Rows with any null or NaN value go."""
    return samples.na.drop(how="any")


def center(samples: DataFrame) -> DataFrame:
    """Less the mean of each trial and channel."""
    return samples.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy(*TRIAL, "channel")))


def standardize(samples: DataFrame) -> DataFrame:
    """Each participant's values over their standard deviation, times the mean deviation of all participants."""
    spread = samples.groupBy("participant").agg(F.stddev_pop("value").alias("_sd"))
    mean = spread.agg(F.avg("_sd").alias("_mean"), F.count("*").alias("_n"))
    factors = spread.crossJoin(F.broadcast(mean)).select("participant", F.when(F.col("_n") > 1, F.col("_mean") / F.col("_sd")).otherwise(1.0).alias("_f"))  # one row
    return samples.join(factors, "participant").withColumn("value", F.col("value") * F.col("_f")).drop("_f")


def zscore_keys(mode: ZScore, across: bool) -> list[str]:
    keys = {ZScore.ALL: [], ZScore.PARTICIPANT: ["participant"], ZScore.TRIAL: TRIAL}[mode]
    return keys if across else [*keys, "channel"]


def zscore(samples: DataFrame, option: object = True, across: bool = False) -> DataFrame:
    """z-scores with the population deviation; a group without spread gives null.

    Wide groups (all rows of a channel) are met by partial aggregates joined back; a trial's
    rows stand together in a window."""
    mode = ZScore.parse(option)
    if mode is ZScore.NONE:
        return samples
    keys = zscore_keys(mode, across)
    if mode is ZScore.TRIAL:
        w = Window.partitionBy(*keys)
        m, sd = F.avg("value").over(w), F.stddev_pop("value").over(w)
        return samples.withColumn("value", F.when(sd > 0, (F.col("value") - m) / sd))
    stats = samples.groupBy(*keys).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_sd"))
    joined = samples.join(stats, keys) if keys else samples.crossJoin(F.broadcast(stats))  # one row
    return joined.withColumn("value", F.when(F.col("_sd") > 0, (F.col("value") - F.col("_m")) / F.col("_sd"))).drop("_m", "_sd")


def empty_channels(samples: DataFrame) -> DataFrame:
    """(participant, channel) pairs without a single value."""
    kind = samples.schema["channel"].dataType
    names = F.array(*(F.lit(n) for n in reduction.channel_names(samples))).cast(ArrayType(kind))
    good = F.col("value").isNotNull() & ~F.isnan("value")
    found = samples.groupBy("participant").agg(F.collect_set(F.when(good, F.col("channel"))).alias("_found"))  # a channel once
    return found.select("participant", F.explode(F.array_except(names, "_found")).alias("channel"))


def project(samples: DataFrame, weights: DataFrame) -> DataFrame:
    """Channels times ``weights(channel, component, w)``: rows of components."""
    return (
        samples.join(weights, "channel")  # Spark broadcasts the weights if it finds them small
        .groupBy(*TRIAL, "sample", "component")
        .agg(F.sum(F.col("value") * F.col("w")).alias("value"))
        .withColumnRenamed("component", "channel")
    )


def channels_as_components(samples: DataFrame) -> DataFrame:
    """Without reduction: components are the channels in order of their names."""
    names = reduction.channel_names(samples)
    number = F.create_map(*(x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))))
    return samples.withColumn("channel", F.element_at(number, F.col("channel")).cast("string"))


def unstacked(samples: DataFrame, channels: list[str]) -> DataFrame:
    """One row per sample, a column per channel (null where it has no value)."""
    return samples.groupBy(*TRIAL, "sample").pivot("channel", channels).agg(F.max("value"))


def gathered(samples: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """One row per trial: duration and x, an array over samples of arrays over channels (by name).

    Order inside a trial comes from sorting, never from arrival.  Every sample of a trial must have all
    its channels."""
    keys = [*TRIAL, *(extra or [])]
    rows = samples.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("sample", "channel", "value"))).alias("_rows"))
    rows = rows.withColumn("duration", F.size(F.array_distinct(F.transform("_rows", lambda r: r["sample"]))))
    width = (F.size("_rows") / F.col("duration")).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.col("duration") - 1), lambda i: F.transform(F.slice("_rows", i * width + 1, width), lambda r: r["value"]))
    return rows.select(*keys, "duration", F.when(width * F.col("duration") == F.size("_rows"), cut).otherwise(F.raise_error(F.lit("a sample of a trial lacks a channel"))).alias("x"))


def cross_correlate(samples: DataFrame, template: tuple[float, ...] | list[float]) -> DataFrame:
    """Sliding product with the template, centred, zeros beyond the trial: out[i] = sum_j x[i + j - M//2] w[j]."""
    w = Window.partitionBy(*TRIAL, "channel").orderBy("sample")
    half = len(template) // 2
    out: Column = F.lit(0.0)
    for j, weight in enumerate(template):
        k = j - half
        x = F.col("value") if k == 0 else F.lead("value", k, 0.0).over(w) if k > 0 else F.lag("value", -k, 0.0).over(w)
        out = out + x * F.lit(float(weight))
    return samples.withColumn("value", out)


@dataclass(frozen=True)
class Preprocessed:
    samples: DataFrame  # channel holds the component's number
    weights: DataFrame | None
    explained: list[float] | None


def preprocess(
    samples: DataFrame,
    *,
    method: object = "pca",
    n_comp: int | None = None,
    apply_standard: bool = False,
    centering: bool = True,
    apply_zscore: object = True,
    zscore_across: bool = False,
    bandfilter: tuple[float | None, float | None] | None = None,
    sfreq: float | None = None,
    mcca: dict | None = None,
) -> Preprocessed:
    """Guard, filter, standardise, centre, reduce, z-score, drop incomplete rows, in this order."""
    method = Method.parse(method)
    missing = empty_channels(samples).take(1)
    if missing:
        raise ValueError(f"channel {missing[0]['channel']} of participant {missing[0]['participant']} has no values")
    samples = by_trial(samples)
    if bandfilter is not None:
        if sfreq is None:
            raise ValueError("a filter needs sfreq")
        samples = signal.filter_trials(samples, sfreq, *bandfilter)
    if apply_standard:
        samples = standardize(samples)
    if centering or method is Method.MCCA:
        samples = center(samples)
    weights, explained = None, None
    if method is Method.PCA:
        weights, explained = reduction.pca(samples, n_comp)
        samples = project(samples, weights)
    elif method is Method.MCCA:
        model = reduction.fit_mcca(samples, n_comp or 3, **(mcca or {}))
        samples, weights = model.transform(samples), model.weights(samples.sparkSession)
    else:
        samples = channels_as_components(samples)
    return Preprocessed(drop_incomplete(zscore(samples, apply_zscore, zscore_across)), weights, explained)


def suggested_components(explained: list[float], threshold: float = 0.99) -> int:
    """Least number of components that explain the share."""
    return int(np.searchsorted(np.cumsum(explained), threshold - 1e-12) + 1)
