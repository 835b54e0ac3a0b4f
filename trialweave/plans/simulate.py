"""Simulated recordings with known events."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trialweave.functions.distributions import Distribution, Gamma
from trialweave.schema import TRIAL


@dataclass(frozen=True)
class Source:
    """One event: its waveform's frequency and size, and the stage before it (family and mean in ms, or fixed times).

    ``proportion``: in how many of the trials it occurs, each trial by its own chance; in the others it has no
    waveform and no time, and what follows runs from where it would have started."""

    name: str
    frequency: float = 10.0
    amplitude: float = 1.0
    mean_ms: float = 100.0
    distribution: Distribution = field(default_factory=Gamma)
    proportion: float = 1.0
    times_ms: tuple[float, ...] | None = None


def topography(name: str, channels: int) -> np.ndarray:
    """A fixed random topography for each name."""
    return np.random.default_rng(zlib.crc32(name.encode())).normal(0, 1, channels)


def simulate(
    spark: SparkSession,
    sources: list[Source],
    n_trials: int,
    *,
    sfreq: float = 100.0,
    channels: int = 8,
    participants: tuple[str, ...] = ("S0",),
    noise: float = 0.0,
    relations: list[int] | None = None,
    seed: int = 0,
    tail: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(samples, true times).  The last source is the response: it ends the trial and has no waveform.

    ``relations[i]``: number of the source (from 1; 0 is the stimulus) from which source i's stage
    runs; by default each follows the one before.  Noise is coloured by a short recursive filter.
    Each trial has its own seed, so the data do not depend on partitions."""
    relations = relations or list(range(len(sources)))
    maps = np.stack([topography(s.name, channels) * s.amplitude for s in sources[:-1]]) if len(sources) > 1 else np.zeros((0, channels))
    names = [f"c{i:03d}" for i in range(channels)]

    def one(participant: str, epoch: int) -> tuple[np.ndarray, list[float]]:
        rng = np.random.default_rng([seed, zlib.crc32(participant.encode()), epoch])
        at, there = [0], []
        for s, back in zip(sources, relations, strict=True):
            ms = s.times_ms[epoch % len(s.times_ms)] if s.times_ms else s.distribution.draw(rng, s.mean_ms)
            there.append(s.proportion >= 1 or rng.random() < s.proportion)
            at.append(at[back] + (max(1, round(ms * sfreq / 1000)) if there[-1] else 0))
        length = at[-1] + tail
        x = np.zeros((length, channels))
        for k, s in enumerate(sources[:-1]):
            if not there[k]:
                continue
            half = sfreq / s.frequency / 2
            n = max(1, round(half))
            wave = np.sin(np.pi * (np.arange(n) + 0.5) / n)
            for j, v in enumerate(wave):
                t = at[k + 1] - n // 2 + j
                if 0 <= t < length:
                    x[t] += v * maps[k]
        if noise:
            e = rng.normal(0, noise, (length + 20, channels))
            for t in range(3, len(e)):
                e[t] += 0.2 * e[t - 1] - 0.2 * e[t - 2] + 0.04 * e[t - 3]
            x += e[20:]
        return x, [t if k else np.nan for t, k in zip(at[1:], there, strict=True)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, e in zip(b["participant"], b["epoch"], strict=True):
                x, at = one(p, int(e))
                t, c = (i.ravel() for i in np.indices(x.shape))
                yield pd.DataFrame({"participant": p, "epoch": int(e), "sample": t.astype("int32"), "channel": np.asarray(names, object)[c], "value": x.ravel()})

    def truth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, e in zip(b["participant"], b["epoch"], strict=True):
                _, at = one(p, int(e))
                yield pd.DataFrame({"participant": p, "epoch": int(e), "event": np.arange(len(at), dtype="int32"), "time": np.asarray(at, float)})

    people = F.explode(F.array(*map(F.lit, participants)))
    trials = spark.range(n_trials).select(people.alias("participant"), F.col("id").alias("epoch"))
    samples = trials.mapInPandas(run, "participant string, epoch long, sample int, channel string, value double")
    true = trials.mapInPandas(truth, "participant string, epoch long, event int, time double")
    return samples, true.withColumn("time", F.nanvl("time", F.lit(None).cast("double")))


def trigger_table(times: DataFrame, spacing: int, start: int = 0) -> DataFrame:
    """participant, number, sample, prev, code: the triggers of a continuous recording in which a trial begins
    every ``spacing`` samples.  Code 1 is the stimulus, k + 2 event k; ``number`` counts them by sample."""
    onset = F.col("epoch") * spacing + start
    stimuli = times.select(*TRIAL).distinct().select("participant", onset.cast("long").alias("sample"), F.lit(1).alias("code"))
    events = times.where("time is not null").select("participant", (onset + F.rint("time")).cast("long").alias("sample"), (F.col("event") + 2).cast("int").alias("code"))
    w = Window.partitionBy("participant").orderBy("sample", "code")
    return stimuli.unionByName(events).select("participant", (F.row_number().over(w) - 1).alias("number"), "sample", F.lit(0).alias("prev"), "code")


def trigger_intervals(triggers: DataFrame) -> DataFrame:
    """Adds ``since``: samples since the trigger before (since sample 0 for the first)."""
    w = Window.partitionBy("participant").orderBy("sample", "code")
    return triggers.withColumn("since", F.col("sample") - F.lag("sample", 1, 0).over(w))


def true_parameters(samples: DataFrame, times: DataFrame, distribution) -> tuple[DataFrame, DataFrame]:
    """(stage scales, event magnitudes) that the true times imply; the last time is the response."""
    w = F.expr("time - coalesce(lag(time) over (partition by participant, epoch order by event), 0)")
    stages = times.withColumn("duration", w).groupBy(F.col("event").alias("stage")).agg(F.avg("duration").alias("mean"))
    scales = stages.withColumn("scale", distribution.mean_to_scale(F.col("mean")))
    last = samples.groupBy(*TRIAL).agg(F.max("sample").alias("last"))
    most = times.agg(F.max("event").alias("m"))
    inner = times.crossJoin(F.broadcast(most)).where("event < m").join(last, TRIAL).select(*TRIAL, "event", F.least("time", "last").cast("int").alias("sample"))  # one row
    values = samples.join(inner, [*TRIAL, "sample"]).groupBy("event", "channel").agg(F.avg("value").alias("value"))
    return scales, values


def demo(spark: SparkSession, n_events: int = 4, seed: int = 0, n_trials: int = 50) -> tuple[DataFrame, DataFrame]:
    """A small recording with stages of 40 to 150 ms."""
    rng = np.random.default_rng(seed)
    sources = [Source(f"event{i}", mean_ms=float(rng.uniform(40, 150))) for i in range(n_events)] + [Source("response", mean_ms=100.0)]
    return simulate(spark, sources, n_trials, noise=0.3, seed=seed)
