"""Interpretation of estimates: event times, event-locked values and windows, summaries."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trialweave.operators.stats import sign_test, t_test_greater
from trialweave.schema import TRIAL


def times_max(probs: DataFrame) -> DataFrame:
    """participant, epoch, grp, event, time: most likely sample (the first of ties)."""
    best = F.max_by("sample", F.struct("prob", -F.col("sample")))
    return probs.groupBy(*TRIAL, "grp", "event").agg(best.cast("double").alias("time"))


def times_mean(probs: DataFrame) -> DataFrame:
    """Expected sample."""
    return probs.groupBy(*TRIAL, "grp", "event").agg(F.sum(F.col("sample") * F.col("prob")).alias("time"))


def event_times(
    probs: DataFrame,
    *,
    method: str = "max",
    durations: DataFrame | None = None,
    add_rt: bool = False,
    add_stim: bool = False,
    as_duration: bool = False,
    sfreq: float | None = None,
    offset: int = 0,
) -> DataFrame:
    """Times of ``probs(participant, epoch, grp, event, sample, prob)``.

    ``add_rt`` appends the trial's end (``durations(participant, epoch, duration)`` less
    ``offset``) as the event after the last; ``add_stim`` puts event 0 at time 0 before all;
    ``as_duration`` gives the time since the previous event that is present; ``sfreq`` turns
    samples to milliseconds."""
    if method not in ("max", "mean"):
        raise ValueError("method is 'max' or 'mean'")
    out = times_max(probs) if method == "max" else times_mean(probs)
    if add_rt:
        if durations is None:
            raise ValueError("add_rt needs durations")
        last = out.groupBy(*TRIAL, "grp").agg(F.max("event").alias("last"))
        most = last.agg(F.max("last").alias("most"))
        rt = last.join(durations, TRIAL).crossJoin(F.broadcast(most)).select(*TRIAL, "grp", (F.col("most") + 1).alias("event"), (F.col("duration") - offset).cast("double").alias("time"))  # one row
        out = out.unionByName(rt)
    if add_stim:
        out = out.withColumn("event", F.col("event") + 1)
        out = out.unionByName(out.select(*TRIAL, "grp").distinct().select(*TRIAL, "grp", F.lit(0).alias("event"), F.lit(0.0).alias("time")))
    if as_duration:
        w = Window.partitionBy(*TRIAL, "grp").orderBy("event").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("time", F.col("time") - F.coalesce(F.last("time", ignorenulls=True).over(w), F.lit(0.0)))
    return out.withColumn("time", F.col("time") * 1000.0 / sfreq) if sfreq else out


def response_samples(probs: DataFrame) -> DataFrame:
    """participant, epoch, rt: a trial's length as its probabilities show it, one more than the sample at
    which the last of its events' running sums stops rising."""
    return probs.where("prob > 0").groupBy(*TRIAL).agg((F.max("sample") + 1).alias("rt"))


def group_times(times: DataFrame) -> DataFrame:
    """grp, event: mean, population deviation, standard error, trials."""
    return times.groupBy("grp", "event").agg(
        F.avg("time").alias("mean"), F.stddev_pop("time").alias("std"), (F.stddev_samp("time") / F.sqrt(F.count("time"))).alias("se"), F.count("time").alias("n")
    )


def two_stage_average(times: DataFrame, by: list[str]) -> DataFrame:
    """Mean of participants' means, and their deviation."""
    per = times.groupBy("participant", *by).agg(F.avg("time").alias("m"))
    return per.groupBy(*by).agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"), F.count("*").alias("participants"))


def event_channels(samples: DataFrame, times: DataFrame, *, template: list[float] | None = None) -> DataFrame:
    """participant, epoch, grp, event, channel, value at the event; with a template the normalised
    product with the samples from half its length before the event on."""
    at = times.select(*TRIAL, "grp", "event", F.rint("time").cast("int").alias("at")).where("at is not null")
    if template is None:
        hit = at.withColumnRenamed("at", "sample")
        return samples.join(hit, [*TRIAL, "sample"]).select(*TRIAL, "grp", "event", "channel", "value")
    total = sum(x * x for x in template)
    half = len(template) // 2
    weights = F.array(*(F.lit(float(x) / total) for x in template))
    spread = at.select(*TRIAL, "grp", "event", F.posexplode(weights).alias("j", "w"), "at").withColumn("sample", F.col("at") - half + F.col("j"))
    return samples.join(spread, [*TRIAL, "sample"]).groupBy(*TRIAL, "grp", "event", "channel").agg(F.sum(F.col("value") * F.col("w")).alias("value"))


def group_channels(values: DataFrame) -> DataFrame:
    return values.groupBy("grp", "event", "channel").agg(F.avg("value").alias("value"))


def centered_activity(
    samples: DataFrame,
    times: DataFrame,
    event: int,
    *,
    n_samples: int | None = None,
    cut_after: int = 0,
    cut_before: int = 0,
    baseline: int = 0,
    width: int = 0,
    center: bool = True,
    impute: float | None = None,
) -> DataFrame:
    """Samples around one event, numbered from it (``rel_sample``), between its neighbours; without
    ``center`` rel_sample is the sample's own number.

    Bounds, both included: from ``cut_before`` events before (half a width after it), not
    before -``baseline``; to ``cut_after`` events after (half a width before it), at most ``n_samples``.
    ``impute`` (which needs n_samples) stands where a trial's channel has no value in baseline .. n_samples.
    """
    width = 0 if event == 1 else width
    baseline = 0 if event == 0 else baseline
    per = times.where("time is not null").groupBy(*TRIAL).agg(F.map_from_entries(F.collect_list(F.struct("event", "time"))).alias("t"))
    at = F.element_at("t", F.lit(event))
    lower = F.lit(float(baseline))
    if cut_before:
        before = F.element_at("t", F.lit(event - cut_before))
        lower = F.greatest(-F.greatest(at - before - width // 2, F.lit(0.0)), F.lit(float(baseline)) if baseline else F.lit(float("-inf")))
    upper = F.lit(float(n_samples)) if n_samples is not None else F.lit(float("inf"))
    if cut_after:
        after = F.element_at("t", F.lit(event + cut_after))
        gap = after - at - width // 2
        upper = F.greatest(F.least(gap, upper), F.lit(0.0))
    bounds = per.select(*TRIAL, at.alias("event_time"), (at + lower).alias("_lo"), (at + upper).alias("_hi")).where("event_time is not null")
    whole = lambda c: F.when(F.col(c) < 0, F.ceil(c)).otherwise(F.floor(c))
    inside = (
        samples.join(bounds, TRIAL)
        .where((F.col("sample") >= whole("_lo")) & ((F.col("_hi") == float("inf")) | (F.col("sample") <= whole("_hi"))))
        .select(*TRIAL, "channel", (F.col("sample") - F.rint("event_time").cast("int")).alias("rel_sample"), "value", "event_time")
    )
    if impute is not None:
        if n_samples is None:
            raise ValueError("impute needs n_samples")
        grid = bounds.select(*TRIAL, "event_time").join(samples.select(*TRIAL, "channel").distinct(), TRIAL).withColumn("rel_sample", F.explode(F.sequence(F.lit(baseline), F.lit(n_samples))))
        inside = grid.join(inside.drop("event_time"), [*TRIAL, "channel", "rel_sample"], "left").select(*TRIAL, "channel", "rel_sample", F.coalesce("value", F.lit(float(impute))).alias("value"), "event_time")
    return inside if center else inside.withColumn("rel_sample", F.col("rel_sample") + F.rint("event_time").cast("int"))


def erp_segments(samples: DataFrame, times: DataFrame) -> DataFrame:
    """Samples of each stage: from the previous event up to just before the event; stages of two samples or more."""
    w = Window.partitionBy(*TRIAL).orderBy("event")
    stages = times.where("time is not null").withColumn("start", F.coalesce(F.lag("time").over(w), F.lit(0.0))).where("time - start > 1")
    spans = stages.select(*TRIAL, F.col("event").alias("stage"), F.rint("start").cast("int").alias("start"), F.rint("time").cast("int").alias("stop"))
    return samples.join(spans, TRIAL).where("sample >= start and sample < stop").select(*TRIAL, "stage", "channel", (F.col("sample") - F.col("start")).alias("rel_sample"), "value")


def erp_means(segments: DataFrame) -> DataFrame:
    """Mean over trials of each stage's samples, channel by channel, and how many trials reach them."""
    return segments.groupBy("stage", "channel", "rel_sample").agg(F.avg("value").alias("value"), F.count("value").alias("n"))


def grand_average(samples: DataFrame) -> DataFrame:
    return samples.groupBy("sample", "channel").agg(F.avg("value").alias("value"), F.count("value").alias("n"))


def bca_limits(mean: float, skewness: float, n: int, draws: np.ndarray, level: float) -> tuple[float, float]:
    """Bias-corrected and accelerated interval (Efron, 1987) of a mean from its bootstrap draws; the mean
    itself where the draws have no spread."""
    draws = draws[np.isfinite(draws)]
    if not len(draws) or draws.min() == draws.max():
        return mean, mean
    normal = NormalDist()
    share = ((draws < mean).sum() + (draws <= mean).sum()) / (2 * len(draws))
    bias = normal.inv_cdf(min(max(share, 0.5 / len(draws)), 1 - 0.5 / len(draws)))
    speed = skewness / (6 * n**0.5)
    at = []
    for tail in ((1 - level) / 2, (1 + level) / 2):
        z = bias + normal.inv_cdf(tail)
        at.append(normal.cdf(bias + z / (1 - speed * z)))
    low, high = np.quantile(draws, at)
    return float(low), float(high)


def bootstrap_mean(samples: DataFrame, keys: list[str], *, draws: int = 200, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Mean of ``value`` per keys with a bias-corrected and accelerated bootstrap interval.

    Resampling weights are Poisson(1), drawn from a hash of the row, so a recomputed task draws the same.
    Each batch adds up its own rows for all draws at once; only sums per key and draw are shuffled."""
    kinds = ", ".join(f"`{k}` {dict(samples.dtypes)[k]}" for k in keys)
    rows = samples.where(F.col("value").isNotNull()).select(*keys, F.col("value").cast("double").alias("_v"), F.xxhash64(*samples.columns, F.lit(seed)).alias("_h"))
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
    marks = (np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 4096):
                part = b.iloc[i : i + 4096]
                group = part.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
                order = np.argsort(group, kind="stable")
                starts = np.flatnonzero(np.append(True, np.diff(group[order]) > 0))
                x = part["_h"].to_numpy().view(np.uint64)[order][:, None] + marks
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                weight = np.searchsorted(steps, (x >> np.uint64(11)) / float(1 << 53), "right").astype(float)
                out = part.iloc[order[starts]][keys].reset_index(drop=True)
                out["s"] = list(np.add.reduceat(weight * part["_v"].to_numpy()[order][:, None], starts))
                out["w"] = list(np.add.reduceat(weight, starts))
                yield out

    sums = rows.mapInPandas(run, f"{kinds}, s array<double>, w array<double>").select(*keys, F.posexplode(F.arrays_zip("s", "w")).alias("draw", "x"))
    means = sums.groupBy(*keys, "draw").agg(F.try_divide(F.sum("x.s"), F.sum("x.w")).alias("m"))
    each = means.groupBy(*keys).agg(F.collect_list("m").alias("draws"))
    whole = samples.groupBy(*keys).agg(F.avg("value").alias("mean"), F.skewness("value").alias("skewness"), F.count("value").alias("n"))
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    both = whole.alias("l").join(each.alias("r"), on).select(*(F.col(f"l.{k}").alias(k) for k in keys), "mean", "skewness", "n", "draws")

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            limits = [bca_limits(m, 0.0 if s is None or math.isnan(s) else s, n, np.asarray(d, float), level) for m, s, n, d in zip(b["mean"], b["skewness"], b["n"], b["draws"], strict=True)]
            yield b[[*keys, "mean"]].assign(low=[x[0] for x in limits], high=[x[1] for x in limits])

    return both.mapInPandas(ends, f"{kinds}, mean double, low double, high double")


def loo_differences(loo: DataFrame) -> DataFrame:
    """Gain of each number of events over one fewer, per participant."""
    w = Window.partitionBy("participant").orderBy("n_event")
    return loo.withColumn("gain", F.col("loglik") - F.lag("loglik").over(w)).where("gain is not null").select("n_event", "participant", "gain")


def loo_tests(loo: DataFrame) -> DataFrame:
    """n_event, mean gain, participants with a gain, t and its p (greater), sign-test p."""
    d = loo_differences(loo).groupBy("n_event").agg(F.avg("gain").alias("mean"), F.stddev_samp("gain").alias("sd"), F.count("*").alias("n"), F.count_if(F.col("gain") > 0).alias("positive"), F.count_if(F.col("gain") < 0).alias("negative"))
    rows = []
    for r in d.collect():  # a row per number of events
        t = r["mean"] / (r["sd"] / r["n"] ** 0.5) if r["sd"] else None
        rows.append((r["n_event"], r["mean"], r["n"], r["positive"], t, None if t is None else t_test_greater(t, r["n"] - 1), sign_test(r["positive"], r["negative"])))
    return loo.sparkSession.createDataFrame(rows, "n_event int, mean double, n long, positive long, t double, p_t double, p_sign double")


def classify(test: DataFrame, true: DataFrame) -> DataFrame:
    """Nearest true topography of each test one: test, true (null for none), distance.

    Both are (name, channel, value), z-scored per name (population); distance is the median
    absolute difference, also to all zeros; of the tests nearest to a true one the best keeps it."""

    def scaled(df: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy("name")
        return df.select(F.col("name").alias(name), "channel", ((F.col("value") - F.avg("value").over(w)) / F.stddev_pop("value").over(w)).alias(f"v_{name}"))

    t, r = scaled(test, "test"), scaled(true, "true")
    pairs = t.join(r, "channel").groupBy("test", "true").agg(F.median(F.abs(F.col("v_test") - F.col("v_true"))).alias("distance"))
    none = t.groupBy("test").agg(F.median(F.abs("v_test")).alias("distance")).select("test", F.lit(None).cast("int").alias("true"), "distance")
    order = F.struct("distance", F.col("true").isNull(), "true")
    best = pairs.unionByName(none).groupBy("test").agg(F.min(order).alias("b")).select("test", "b.true", "b.distance")
    w = Window.partitionBy("true").orderBy("distance", "test")
    return best.withColumn("true", F.when(F.col("true").isNotNull() & (F.row_number().over(w) == 1), F.col("true")))


def snr(samples: DataFrame, times: DataFrame) -> DataFrame:
    """Per event and channel: mean power at the event over the variance of all samples of the channel."""
    at = event_channels(samples, times).groupBy("event", "channel").agg(F.avg(F.col("value") * F.col("value")).alias("power"))
    noise = samples.groupBy("channel").agg(F.var_pop("value").alias("noise"))
    return at.join(noise, "channel").select("event", "channel", (F.col("power") / F.col("noise")).alias("snr"))


def topography_timecourse(probs: DataFrame, samples: DataFrame, durations: DataFrame, *, method: str = "max", sfreq: float | None = None) -> tuple[DataFrame, DataFrame, tuple[float, float]]:
    """What a topography plot needs: group values per event and channel, mean times with the
    response, and symmetric value limits."""
    times = event_times(probs, method=method, durations=durations, add_rt=True)
    values = group_channels(event_channels(samples, event_times(probs, method=method)))
    most = values.agg(F.max(F.abs("value"))).first()[0] or 0.0
    scaled = times.withColumn("time", F.col("time") * 1000.0 / sfreq) if sfreq else times
    return values, group_times(scaled), (-most, most)


def latencies(times: DataFrame) -> DataFrame:
    """Mean stage durations and cumulative times per group."""
    w = Window.partitionBy(*TRIAL, "grp").orderBy("event").rowsBetween(Window.unboundedPreceding, -1)
    stage = times.withColumn("duration", F.col("time") - F.coalesce(F.last("time", ignorenulls=True).over(w), F.lit(0.0)))
    mean = stage.groupBy("grp", "event").agg(F.avg("duration").alias("duration"), F.stddev_pop("duration").alias("std"))
    return mean.withColumn("cumulative", F.sum("duration").over(Window.partitionBy("grp").orderBy("event")))


def condition_contrast(times: DataFrame, trials: DataFrame, condition: str) -> DataFrame:
    """Mean stage duration per condition and event."""
    w = Window.partitionBy(*TRIAL).orderBy("event").rowsBetween(Window.unboundedPreceding, -1)
    stage = times.withColumn("duration", F.col("time") - F.coalesce(F.last("time", ignorenulls=True).over(w), F.lit(0.0)))
    return stage.join(trials.select(*TRIAL, condition), TRIAL).groupBy(condition, "event").agg(F.avg("duration").alias("duration"), F.count("*").alias("n"))
