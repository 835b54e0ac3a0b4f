"""Cutting and cleaning of signals: all DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trialweave.schema import TRIAL


def pick_channels(samples: DataFrame, channels: list[str]) -> DataFrame:
    return samples.where(F.col("channel").isin(channels))


def average_reference(samples: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Less the mean over channels at the same sample."""
    w = Window.partitionBy(*(keys or [*TRIAL, "sample"]))
    return samples.withColumn("value", F.col("value") - F.avg("value").over(w))


def baseline_correct(samples: DataFrame, start: int | None = None, stop: int | None = 0) -> DataFrame:
    """Less the mean of each trial and channel over samples start .. stop (ends included)."""
    inside = F.lit(True)
    if start is not None:
        inside &= F.col("sample") >= start
    if stop is not None:
        inside &= F.col("sample") <= stop
    w = Window.partitionBy(*TRIAL, "channel")
    return samples.withColumn("value", F.col("value") - F.avg(F.when(inside, F.col("value"))).over(w))


def decimate(samples: DataFrame, factor: int) -> DataFrame:
    """Every ``factor``-th sample, numbered anew.  Frequencies above half the new rate must be gone
    before (``signal.filter_raw``), or they fold back."""
    return samples.where(F.col("sample") % factor == 0).withColumn("sample", F.floor(F.col("sample") / factor).cast(samples.schema["sample"].dataType))


def first_response(marks: DataFrame, is_stimulus: Column, is_response: Column, *, tmin: float, tmax: float, keep: list[str] | None = None) -> DataFrame:
    """First response after each stimulus of ``marks(participant, epoch, at)``: rt in units of ``at``,
    null if none comes within tmin .. tmax.

    A recording is cut into stretches of ``tmax``, which also get the responses of the stretch behind
    them; one pass over each, from its last mark to its first, carries the response met last along.
    So a long recording is the work of many tasks, and there is no join."""
    stretch = F.floor(F.col("at") / (tmax if tmax > 0 else 1.0))
    own = marks.withColumns({"_stim": is_stimulus, "_resp": F.coalesce(is_response, F.lit(False)), "_own": stretch})
    spread = own.withColumn("_in", F.explode(F.when(F.col("_resp"), F.array(F.col("_own"), F.col("_own") - 1)).otherwise(F.array("_own"))))
    w = Window.partitionBy("participant", "_in").orderBy(F.desc("at"), F.desc("epoch")).rowsBetween(Window.unboundedPreceding, -1)
    nxt = F.last(F.when(F.col("_resp"), F.col("at")), ignorenulls=True).over(w)
    out = spread.withColumn("_next", nxt).where("_stim and _in = _own")
    rt = F.col("_next") - F.col("at")
    return out.select(*TRIAL, *(keep or []), F.when((rt >= tmin) & (rt <= tmax), rt).alias("rt"))


def cut_windows(raw: DataFrame, onsets: DataFrame, lo: int, hi: int) -> DataFrame:
    """Samples onset + lo .. onset + hi of each onset (participant, epoch, onset), numbered from the onset.

    Each onset's window is spread to its samples, so the join is by equality."""
    spread = onsets.select(*TRIAL, "onset", F.explode(F.sequence(F.col("onset") + lo, F.col("onset") + hi)).alias("_at"))
    return (
        raw.join(spread, (raw["participant"] == spread["participant"]) & (raw["sample"] == spread["_at"]))
        .select(raw["participant"], "epoch", (F.col("_at") - F.col("onset")).cast("int").alias("sample"), "channel", "value")
    )


def drop_repeated(marks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Of marks at the same sample of a participant only the first by code stays."""
    w = Window.partitionBy(*(keys or ["participant"]), "sample").orderBy("code")
    return marks.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def reject_annotated(onsets: DataFrame, bad: DataFrame, lo: int, hi: int) -> DataFrame:
    """Onsets whose window onset + lo .. onset + hi meets no span of ``bad(participant, start, stop)``
    (stop included).

    Spans are merged in one pass per participant and each onset meets at most one merged span: the
    last that begins by the window's end.  So the join is by a window over both, not by a range."""
    marks = onsets.select("participant", (F.col("onset") + hi).cast("double").alias("_at"), F.lit(1).alias("_kind"), F.struct(*onsets.columns).alias("_row"), F.lit(None).cast("double").alias("_stop"))
    spans = bad.select("participant", F.col("start").cast("double").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(marks.schema["_row"].dataType).alias("_row"), F.col("stop").cast("double").alias("_stop"))
    w = Window.partitionBy("participant").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = marks.unionByName(spans).withColumn("_reach", F.max("_stop").over(w)).where("_kind = 1")
    return met.where(F.col("_reach").isNull() | (F.col("_reach") < F.col("_row.onset") + lo)).select("_row.*")


def scale_rt(trials: DataFrame, scale: float) -> DataFrame:
    return trials.withColumn("rt", F.col("rt") / scale)


def trim_rt(trials: DataFrame, sfreq: float, *, lower: float = 0.0, upper: float = float("inf")) -> DataFrame:
    """Trials whose RT is known, inside the limits and not zero samples; adds ``rt_samples`` (half to even)."""
    if lower < 0 or upper < 0:
        raise ValueError("limits of response times must not be negative")
    rt = F.col("rt")
    kept = trials.where(rt.isNotNull() & ~F.isnan(rt.cast("double")) & (rt >= lower) & (rt <= upper))
    return kept.withColumn("rt_samples", F.rint(rt * sfreq).cast("int")).where("rt_samples > 0")


def crop(samples: DataFrame, trials: DataFrame, offset: int = 0, start: int = 0) -> DataFrame:
    """Samples start .. start + rt_samples + offset of the trials, numbered from 0."""
    t = trials.select(*TRIAL, "rt_samples")
    return (
        samples.join(t, TRIAL)
        .where((F.col("sample") >= start) & (F.col("sample") < start + F.col("rt_samples") + offset))
        .withColumn("sample", (F.col("sample") - start).cast("int"))
        .drop("rt_samples")
    )


def reject(samples: DataFrame, threshold: float) -> DataFrame:
    """Trials of which every absolute value is under the threshold."""
    v = F.col("value")
    good = samples.groupBy(*TRIAL).agg(F.bool_and(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < threshold)).alias("_ok")).where("_ok")
    return samples.join(good, TRIAL, "left_semi")


def drop_empty(samples: DataFrame) -> DataFrame:
    """Samples of trials that have a value at all."""
    v = F.col("value")
    good = samples.groupBy(*TRIAL).agg(F.bool_or(v.isNotNull() & ~F.isnan(v)).alias("_any")).where("_any")
    return samples.join(good, TRIAL, "left_semi")


def align(samples: DataFrame, trials: DataFrame) -> DataFrame:
    """Only samples of the given trials."""
    return samples.join(trials.select(*TRIAL).distinct(), TRIAL, "left_semi")


def with_metadata(samples: DataFrame, trials: DataFrame) -> DataFrame:
    return samples.join(trials, TRIAL)


def select_condition(samples: DataFrame, value: str, column: str = "event", method: str = "equal") -> DataFrame:
    """Rows of a condition: equal, or matching a regular expression; null counts as empty."""
    if column not in samples.columns:
        raise ValueError(f"no column {column}")
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    if method not in ("equal", "contains"):
        raise ValueError("method is 'equal' or 'contains'")
    return samples.where(text == value if method == "equal" else text.rlike(value))


def select_participants(samples: DataFrame, participants: str | int | list) -> DataFrame:
    some = participants if isinstance(participants, list) else [participants]
    return samples.where(F.col("participant").isin(some))


def exclude_participants(samples: DataFrame, participants: str | int | list) -> DataFrame:
    some = participants if isinstance(participants, list) else [participants]
    return samples.where(~F.col("participant").isin(some))
