"""Readers of recordings.

A recording is a folder (or glob) of Parquet or CSV files with long samples; participants
are a key, never a loop over files.  Binary formats of acquisition systems are converted
beforehand; arrays in memory come in by ``from_array``.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trialweave.operators import epoching, signal

SAMPLES = "participant string, epoch long, sample int, channel string, value double"
RAW = "participant string, sample long, channel string, value double"
#: Most names of files that are broadcast to a scan.
MOST_BROADCAST = 100_000


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet, or CSV by its ending, with a fixed schema."""
    reader = spark.read.schema(schema)
    return reader.csv(path, header=True) if path.rstrip("*/").endswith(".csv") else reader.parquet(path)


def participant_names(files: list[str], names: list[str] | None = None) -> list[str]:
    """Given names, or S0, S1, ..."""
    return list(names) if names else [f"S{i}" for i in range(len(files))]


def read_participants(spark: SparkSession, files: list[str], names: list[str] | None = None, schema: str = SAMPLES) -> DataFrame:
    """One file (or folder) per participant, with its name as key: a single scan of all Parquet files
    and one of all CSV files, however many participants there are."""
    if not files:
        raise ValueError("no files")
    plain = lambda p: re.sub("^file:/+", "/", p).rstrip("/")
    named = {plain(f): n for f, n in zip(files, participant_names(files, names), strict=True)}
    if len(named) != len(files):
        raise ValueError("a file is given twice")
    table = spark.createDataFrame(list(named.items()), "_path string, _name string")
    table = F.broadcast(table) if len(named) <= MOST_BROADCAST else table
    out = None
    for csv in (False, True):
        some = [f for f in files if f.rstrip("*/").endswith(".csv") == csv]
        if some:
            reader = spark.read.schema(schema)
            one = reader.csv(some, header=True) if csv else reader.parquet(*some)
            one = one.withColumn("_file", F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/"))
            out = one if out is None else out.unionByName(one)
    columns = [c for c in out.columns if c not in ("_file", "participant")]
    found = out.join(table, F.col("_file") == F.col("_path"), "left").withColumnRenamed("_name", "_own").drop("_path")
    found = found.join(table, F.regexp_replace("_file", "/[^/]*$", "") == F.col("_path"), "left")
    return found.select(F.coalesce("_own", "_name").alias("participant"), *columns)


def read_epochs(spark: SparkSession, path: str, *, metadata: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Samples that are cut into trials already, and their trials: ``metadata(participant, epoch, rt, ...)``
    or all that have samples; ``options`` are those of ``clean_epochs``."""
    samples = read_table(spark, path, SAMPLES)
    trials = metadata if metadata is not None else samples.select("participant", "epoch").distinct().withColumn("rt", F.lit(None).cast("double"))
    return clean_epochs(samples, trials, **{"ignore_rt": metadata is None, **options})


def load_samples(spark: SparkSession, path: str) -> DataFrame:
    """Stored samples without missing values, and so without trials that have nothing else."""
    return read_table(spark, path, SAMPLES).where("value is not null and not isnan(value)")


def bids_participants(spark: SparkSession, root: str, pattern: str = "sub-*") -> DataFrame:
    """Files below ``root/sub-*`` with the participant taken from the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*").load(f"{root}/{pattern}").select("path", "length")
    return files.withColumn("participant", F.regexp_extract("path", r"/sub-([^/]+)/", 1))


def read_bids(spark: SparkSession, root: str, *, pattern: str = "sub-*", files: str = "*.parquet", schema: str = SAMPLES) -> DataFrame:
    """Samples of all files below ``root/sub-*`` in one scan, with the participant taken from the path."""
    reader = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", files)
    some = reader.csv(f"{root}/{pattern}", header=True) if files.endswith(".csv") else reader.parquet(f"{root}/{pattern}")
    return some.withColumn("participant", F.regexp_extract(F.col("_metadata.file_path"), r"/sub-([^/]+)/", 1))


def trigger_levels(spark: SparkSession, path: str) -> DataFrame:
    """code, kind, label of a task's event description (JSON ``value.Levels``)."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "value struct<Levels: map<string, string>>").alias("j"))
    rows = text.select(F.explode("j.value.Levels").alias("key", "text"))
    kind = F.when(F.col("text").contains("Stimulus"), "Stimulus").when(F.col("text").contains("Response"), "Response")
    return (
        rows.select(trigger_code("key").alias("code"), kind.alias("kind"), F.trim(F.regexp_replace("text", r"^(Stimulus|Response)\s*-\s*", "")).alias("label"))
        .where("code is not null and kind is not null")
    )


def trigger_code(key: str) -> Column:
    """Number at the end of an annotation's name; null if there is none."""
    return F.expr(f"try_cast(nullif(regexp_extract({key}, '([0-9]+)$', 1), '') as int)")


def detect_triggers(raw: DataFrame, codes: list[int] | None = None, *, block: int = 1 << 20) -> DataFrame:
    """Rising edges of a trigger channel ``raw(participant, sample, code)``: participant, sample, prev, code.

    Blocks of samples are worked on each by itself; what stood before a block comes from a table with a
    row per block."""
    own = raw.select("participant", "sample", "code", F.floor(F.col("sample") / block).alias("_block"))
    last = own.groupBy("participant", "_block").agg(F.max_by("code", "sample").alias("_last"))
    before = last.select("participant", "_block", F.lag("_last").over(Window.partitionBy("participant").orderBy("_block")).alias("_before"))
    prev = F.lag("code").over(Window.partitionBy("participant", "_block").orderBy("sample"))
    out = own.withColumn("prev", prev).join(before, ["participant", "_block"]).select("participant", "sample", F.coalesce("prev", "_before", F.lit(0)).alias("prev"), "code").where("code <> prev and code > 0")
    out = out.withColumn("code", F.when(F.col("prev") > 0, F.col("code") - F.col("prev")).otherwise(F.col("code")))
    return out.where(F.col("code").isin(codes)) if codes else out


def clean_epochs(
    samples: DataFrame,
    trials: DataFrame,
    *,
    sfreq: float,
    new_sfreq: float | None = None,
    low_pass: float | None = None,
    high_pass: float | None = None,
    channels: list[str] | None = None,
    reference: str | None = None,
    rt_col: str = "rt",
    scale: float = 1.0,
    offset_after_resp: float = 0.0,
    lower_limit_rt: float = 0.0,
    upper_limit_rt: float = float("inf"),
    reject_threshold: float | None = None,
    ignore_rt: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Cut trials to (samples, trials): pick, reference, filter, resample, then the response times' part.

    ``trials`` has ``rt_col`` in units of 1 / ``scale`` seconds.  Response times are trimmed to the limits,
    samples cropped to 0 .. response + offset and trials with too large values rejected, unless ``ignore_rt``."""
    if channels:
        samples = epoching.pick_channels(samples, channels)
    if reference == "average":
        samples = epoching.average_reference(samples)
    if low_pass is not None or high_pass is not None:
        samples = signal.filter_trials(samples, sfreq, high_pass, low_pass)
    if new_sfreq is not None and new_sfreq != sfreq:
        samples, sfreq = signal.resample_trials(samples, sfreq, new_sfreq), new_sfreq
    trials = epoching.scale_rt(trials.withColumnRenamed(rt_col, "rt"), scale)
    if ignore_rt:
        return epoching.align(samples, trials), trials
    trials = epoching.trim_rt(trials, sfreq, lower=lower_limit_rt, upper=upper_limit_rt)
    samples = epoching.crop(samples, trials, round(offset_after_resp * sfreq))
    if reject_threshold is not None:
        samples = epoching.reject(samples, reject_threshold)
        trials = trials.join(samples.select("participant", "epoch").distinct(), ["participant", "epoch"], "left_semi")
    return samples, trials


def read_raw_and_epoch(
    raw: DataFrame,
    triggers: DataFrame,
    stimuli: dict[str, int],
    responses: dict[str, int],
    *,
    sfreq: float,
    new_sfreq: float | None = None,
    low_pass: float | None = None,
    high_pass: float | None = None,
    tmin: float = -0.2,
    tmax: float = 5.0,
    offset_after_resp: float = 0.0,
    channels: list[str] | None = None,
    reference: str | None = None,
    baseline: tuple[float | None, float | None] | None = (None, 0.0),
    bad: DataFrame | None = None,
    metadata: DataFrame | None = None,
    rt_col: str = "rt",
    scale: float = 1.0,
    lower_limit_rt: float = 0.0,
    upper_limit_rt: float | None = None,
    reject_threshold: float | None = None,
    ignore_rt: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Continuous samples and triggers to (samples, trials): the whole reading chain.

    Order: pick, reference, filter, cut around stimuli, drop windows that meet a ``bad(participant, start,
    stop)`` span, baseline, decimate, trim by RT, crop to stimulus .. response + offset, reject.

    With a ``new_sfreq`` under ``sfreq`` every k-th sample is kept, k the rounded quotient, and
    frequencies from a third of the new rate on are filtered out before, whatever ``low_pass`` says.
    Of triggers at one sample the first by code counts.  ``metadata(participant, epoch, rt_col, ...)``
    gives the response times itself (epochs number the stimuli and responses of a participant from 0).
    Names of responses that do not say so get ``response/`` before them, so that no stimulus shares one.
    """
    if channels:
        raw = epoching.pick_channels(raw, channels)
    if reference == "average":
        raw = epoching.average_reference(raw, ["participant", "sample"])
    factor = max(1, round(sfreq / new_sfreq)) if new_sfreq else 1
    if factor > 1:
        low_pass = sfreq / factor / 3.1
    if low_pass is not None or high_pass is not None:
        raw = signal.filter_raw(raw, sfreq, high_pass, low_pass)
    responses = {name if "response" in name else f"response/{name}": c for name, c in responses.items()}
    code = F.create_map(*(x for name, c in {**stimuli, **responses}.items() for x in (F.lit(c), F.lit(name))))
    marks = epoching.drop_repeated(triggers.where(F.col("code").isin([*stimuli.values(), *responses.values()]))).withColumn("event_name", F.element_at(code, F.col("code")))
    marks = marks.withColumn("epoch", F.row_number().over(Window.partitionBy("participant").orderBy("sample", "code")).cast("long") - 1)
    paired = epoching.first_response(
        marks.withColumn("at", F.col("sample") / sfreq), F.col("code").isin(list(stimuli.values())), F.col("code").isin(list(responses.values())), tmin=tmin, tmax=tmax, keep=["sample", "event_name"]
    ).withColumnRenamed("sample", "onset")
    lo, hi = round(tmin * sfreq), round(tmax * sfreq)
    if bad is not None:
        paired = epoching.reject_annotated(paired, bad, lo, hi)
    cut = epoching.cut_windows(raw, paired.select("participant", "epoch", "onset"), lo, hi)
    if baseline is not None:
        cut = epoching.baseline_correct(cut, None if baseline[0] is None else round(baseline[0] * sfreq), None if baseline[1] is None else round(baseline[1] * sfreq))
    if factor > 1:
        cut, sfreq = epoching.decimate(cut, factor), sfreq / factor
    trials = paired.drop("onset")
    if metadata is not None:
        trials = epoching.with_metadata(trials.drop("rt"), metadata)
    if upper_limit_rt is None:
        upper_limit_rt = tmax - (round(offset_after_resp * sfreq) + 1) / sfreq
    return clean_epochs(
        cut, trials, sfreq=sfreq, rt_col=rt_col if metadata is not None else "rt", scale=scale if metadata is not None else 1.0, offset_after_resp=offset_after_resp,
        lower_limit_rt=lower_limit_rt, upper_limit_rt=upper_limit_rt, reject_threshold=reject_threshold, ignore_rt=ignore_rt,
    )


def time_axis(samples: DataFrame, sfreq: float, offset: int = 0) -> DataFrame:
    """Adds ``time`` in seconds; sample ``offset`` is time 0."""
    return samples.withColumn("time", (F.col("sample") - offset) / sfreq)


def from_array(spark: SparkSession, data: np.ndarray, *, participants: list[str], channels: list[str], epochs: list[int] | None = None, metadata: pd.DataFrame | None = None) -> DataFrame:
    """(participant, epoch, channel, sample) or (epoch, channel, sample) array to samples; NaN gives no row.
    ``metadata(participant, epoch, ...)`` adds its columns to the trials it has; others go."""
    data = np.asarray(data, float)
    if data.ndim == 3:
        data = data[None]
    if data.ndim != 4:
        raise ValueError("three or four dimensions are needed")
    p, e, c, s = (x.ravel() for x in np.indices(data.shape))
    names = np.asarray(epochs if epochs is not None else range(data.shape[1]))
    table = pd.DataFrame({"participant": np.asarray(participants, object)[p], "epoch": names[e].astype("int64"), "sample": s.astype("int32"), "channel": np.asarray(channels, object)[c], "value": data.ravel()})
    samples = spark.createDataFrame(table[np.isfinite(table["value"])], SAMPLES)
    return samples if metadata is None else epoching.with_metadata(samples, spark.createDataFrame(metadata))
