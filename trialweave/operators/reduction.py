"""Reduction of channels: covariances, PCA on their mean, multiset canonical correlation.

Only matrices of channels by channels (or participants' components) come to the driver;
their size does not depend on the number of trials.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.schema import TRIAL

#: Most channels a covariance may have on the driver.
MOST_CHANNELS = 4096
#: Most components of all participants together, between which covariances are taken on the driver.
MOST_COMPONENTS = 1024


def _trial_matrix(samples: np.ndarray, channels: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Channels in order, and sample x channel values (NaN where there is none)."""
    names, column = np.unique(channels, return_inverse=True)
    rows, row = np.unique(samples, return_inverse=True)
    out = np.full((len(rows), len(names)), np.nan)
    out[row, column] = values
    return names, out


def pairwise_covariance(x: np.ndarray) -> np.ndarray:
    """Covariance (n - 1) of the columns over the rows that both have; NaN for fewer than two."""
    has = ~np.isnan(x)
    x = np.where(has, x - np.nanmean(np.where(has.any(axis=0), x, 0.0), axis=0), 0.0)  # a shift leaves covariances and keeps digits
    n = has.T.astype(float) @ has
    with np.errstate(divide="ignore", invalid="ignore"):
        out = (x.T @ x - (x.T @ has) * (has.T.astype(float) @ x) / n) / (n - 1)
    return np.where(n > 1, out, np.nan)


def trial_covariance(samples: DataFrame) -> DataFrame:
    """participant, epoch, a, b, cov (n - 1) of all ordered pairs of channels with a <= b; null where
    two channels have fewer than two samples in common.

    A trial's samples are gathered once and multiplied as a matrix."""
    kinds = dict(samples.dtypes)
    trials = samples.groupBy(*TRIAL).agg(F.collect_list(F.struct("sample", "channel", "value")).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            ends, flat = x.offsets.to_numpy(), x.values
            sample, value = flat.field("sample").to_numpy(zero_copy_only=False), flat.field("value").to_numpy(zero_copy_only=False)
            channel = np.asarray(flat.field("channel").to_pylist(), object if kinds["channel"] == "string" else None)
            trial, first, second, cov = [], [], [], []
            for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                names, matrix = _trial_matrix(sample[a:b], channel[a:b], value[a:b])
                at = np.triu_indices(len(names))
                trial.append(np.full(len(at[0]), i))
                first.append(names[at[0]])
                second.append(names[at[1]])
                cov.append(pairwise_covariance(matrix)[at])
            if not trial:
                continue
            at = pa.array(np.concatenate(trial))
            v = np.concatenate(cov)
            both = [pa.array(np.concatenate(x).tolist(), flat.field("channel").type) for x in (first, second)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in TRIAL), *both, pa.array(v, mask=np.isnan(v))], [*TRIAL, "a", "b", "cov"])

    return trials.mapInArrow(run, f"participant {kinds['participant']}, epoch {kinds['epoch']}, a {kinds['channel']}, b {kinds['channel']}, cov double")


def mean_covariance(samples: DataFrame, by_participant: bool = False) -> DataFrame:
    """Covariances averaged over trials, then over participants."""
    per = trial_covariance(samples).groupBy("participant", "a", "b").agg(F.avg("cov").alias("cov"))
    return per if by_participant else per.groupBy("a", "b").agg(F.avg("cov").alias("cov"))


def _matrix(rows: list, names: list[str]) -> np.ndarray:
    place = {n: i for i, n in enumerate(names)}
    out = np.zeros((len(names), len(names)))
    for r in rows:
        i, j = place[r["a"]], place[r["b"]]
        out[i, j] = out[j, i] = r["cov"] if r["cov"] is not None else 0.0
    return out


def channel_names(samples: DataFrame) -> list[str]:
    names = sorted(r[0] for r in samples.select("channel").distinct().limit(MOST_CHANNELS + 1).collect())
    if len(names) > MOST_CHANNELS:
        raise ValueError(f"more than {MOST_CHANNELS} channels")
    return names


def pca_of(cov: np.ndarray, n_comp: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Loadings (channel x component) and explained shares: the covariance's rows are taken as
    samples, as the method asks; signs make each loading's largest entry positive."""
    _, s, vt = np.linalg.svd(cov - cov.mean(axis=0))
    load = vt.T * np.sign(vt.T[np.abs(vt.T).argmax(axis=0), np.arange(vt.shape[0])])
    share = s**2 / max(1e-300, (s**2).sum())
    k = n_comp or len(cov)
    return load[:, :k], share


def weights_frame(spark: SparkSession, names: list[str], load: np.ndarray) -> DataFrame:
    rows = [(n, str(k), float(load[i, k])) for i, n in enumerate(names) for k in range(load.shape[1])]
    return spark.createDataFrame(rows, "channel string, component string, w double")


def pca(samples: DataFrame, n_comp: int | None) -> tuple[DataFrame, list[float]]:
    names = channel_names(samples)
    load, share = pca_of(_matrix(mean_covariance(samples).collect(), names), n_comp)
    return weights_frame(samples.sparkSession, names, load), share.tolist()


def explained(spark: SparkSession, share: list[float]) -> DataFrame:
    """component, ratio, cumulative: what a scree plot shows."""
    return spark.createDataFrame([(str(k), float(x), float(sum(share[: k + 1]))) for k, x in enumerate(share)], "component string, ratio double, cumulative double")


@dataclass(frozen=True)
class MCCA:
    """Per participant: mean, first reduction over its deviations, canonical weights."""

    names: list[str]
    mu: dict
    first: dict  # channels x n_pcs, divided by sigma
    canonical: dict  # n_pcs x n_ccs
    shared_weights: bool = False

    def matrix(self, participant) -> np.ndarray:
        p = min(self.first) if self.shared_weights else participant
        return self.first[p] @ self.canonical[p]

    def weights(self, spark: SparkSession) -> DataFrame:
        """channel, component, w, participant."""
        kind = "string" if isinstance(next(iter(self.first)), str) else "long"
        rows = [(n, str(k), float(x), p) for p in sorted(self.first) for n, row in zip(self.names, self.matrix(p), strict=True) for k, x in enumerate(row)]
        return spark.createDataFrame(rows, f"channel string, component string, w double, participant {kind}")

    def transform(self, samples: DataFrame) -> DataFrame:
        w = self.weights(samples.sparkSession)
        kind = dict(w.dtypes)["participant"]
        mu = samples.sparkSession.createDataFrame([(p, n, float(m[i])) for p, m in self.mu.items() for i, n in enumerate(self.names)], f"participant {kind}, channel string, mu double")
        # Both tables are local, so Spark knows their size and broadcasts them only if they are small.
        joined = samples.join(w.join(mu, ["participant", "channel"]), ["participant", "channel"])
        return joined.groupBy(*TRIAL, "sample", "component").agg(F.sum((F.col("value") - F.col("mu")) * F.col("w")).alias("value")).withColumnRenamed("component", "channel")


def canonical_weights(cross: np.ndarray, n_sets: int, n_pcs: int, n_ccs: int, ridge: float = 0.0, penalty: np.ndarray | None = None) -> np.ndarray:
    """Top generalised eigenvectors of between-set over within-set covariance, each set's block
    divided by its norm: (sets, n_pcs, n_ccs)."""
    within = np.zeros_like(cross)
    for k in range(n_sets):
        a = slice(k * n_pcs, (k + 1) * n_pcs)
        within[a, a] = cross[a, a]
    if ridge:
        within = within + ridge * (penalty if penalty is not None else np.eye(len(within)))
    try:
        low = np.linalg.cholesky(within)
    except np.linalg.LinAlgError as e:
        raise ValueError("a participant's components are not independent; use fewer or a ridge") from e
    inner = np.linalg.solve(low, np.linalg.solve(low, (cross - within).T).T)
    _, vectors = np.linalg.eigh((inner + inner.T) / 2)
    h = np.linalg.solve(low.T, vectors[:, ::-1][:, :n_ccs]).reshape(n_sets, n_pcs, n_ccs)
    return h / np.linalg.norm(h, axis=(1, 2), keepdims=True)


def fit_mcca(samples: DataFrame, n_ccs: int, *, n_pcs: int | None = None, cov: bool = True, ridge: float = 0.0, averaged: bool = False, shared_weights: bool = False, pca_only: bool = False) -> MCCA:
    """``cov``: first reduction on each participant's mean covariance (no mean, no scaling),
    else on its samples (centred, whitened).  ``averaged``: canonical weights from trial averages.
    ``pca_only``: no canonical weights; each participant's own first components are given."""
    names = channel_names(samples)
    n_pcs = min(n_pcs or 3 * n_ccs, len(names))
    people = sorted(r[0] for r in samples.select("participant").distinct().limit(MOST_COMPONENTS // n_pcs + 1).collect())
    if len(people) < 2:
        raise ValueError("several participants are needed")
    if len(people) * n_pcs > MOST_COMPONENTS:
        raise ValueError(f"participants times components exceed {MOST_COMPONENTS}")
    if n_ccs > n_pcs:
        warnings.warn("more canonical than principal components; taking as many", stacklevel=2)
        n_ccs = n_pcs
    first, mu = {}, {}
    if cov:
        rows: dict = {p: [] for p in people}
        for r in mean_covariance(samples, by_participant=True).collect():
            rows[r["participant"]].append(r)
        for p in people:
            first[p], mu[p] = pca_of(_matrix(rows[p], names), n_pcs)[0], np.zeros(len(names))
    else:
        whole = samples.groupBy(*TRIAL, "sample").agg(F.collect_list(F.struct("channel", "value")).alias("x"))
        sides = whole.select("participant", F.explode("x").alias("l"), "x").select("participant", "l", F.explode("x").alias("r")).where("l.channel <= r.channel")
        pairs = sides.groupBy("participant", F.col("l.channel").alias("a"), F.col("r.channel").alias("b")).agg(F.covar_samp("l.value", "r.value").alias("cov"))
        means = {(r["participant"], r["channel"]): r["m"] for r in samples.groupBy("participant", "channel").agg(F.avg("value").alias("m")).collect()}
        rows = {p: [] for p in people}
        for r in pairs.collect():
            rows[r["participant"]].append(r)
        for p in people:
            values, vectors = np.linalg.eigh(_matrix(rows[p], names))
            load = vectors[:, ::-1][:, :n_pcs]
            load = load * np.sign(load[np.abs(load).argmax(axis=0), np.arange(n_pcs)])
            first[p] = load / np.sqrt(np.maximum(values[::-1][:n_pcs], 1e-300))
            mu[p] = np.array([means.get((p, n), 0.0) for n in names])
    if pca_only:
        return MCCA(names, mu, first, {p: np.eye(n_pcs) for p in people}, shared_weights)
    base = samples
    if averaged:
        base = samples.groupBy("participant", "sample", "channel").agg(F.avg("value").alias("value")).withColumn("epoch", F.lit(0).cast("long"))
    cross = _stacked_covariance(base, names, people, first, mu, n_pcs)
    penalty = None
    if ridge:
        flat = np.stack([first[p] for p in people]).reshape(len(people), -1)
        penalty = np.eye(len(cross)) * float(np.var(flat))
    w = canonical_weights(cross, len(people), n_pcs, n_ccs, ridge, penalty)
    return MCCA(names, mu, first, dict(zip(people, w, strict=True)), shared_weights)


def _stacked_covariance(samples: DataFrame, names: list[str], people: list, first: dict, mu: dict, n_pcs: int) -> np.ndarray:
    """Covariance of all participants' components over positions; shorter ones count as zeros.

    Position: the trial's rank within its participant, and the sample.  The sums of products are
    gathered per task and added, so only matrices leave the tasks."""
    size = len(people) * n_pcs
    place = {n: i for i, n in enumerate(names)}
    at = {p: k for k, p in enumerate(people)}
    ranked = samples.join(samples.select(*TRIAL).distinct().withColumn("rank", F.expr("dense_rank() over (partition by participant order by epoch)")), TRIAL)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, square, count = np.zeros(size), np.zeros((size, size)), 0
        loads = np.stack([first[p] for p in people])
        means = np.stack([mu[p] for p in people])
        held = None  # rows of the last position so far

        def close(rows: pd.DataFrame) -> None:
            """Adds up positions that are complete."""
            nonlocal total, square, count
            opens = np.append(True, (rows["rank"].to_numpy()[1:] != rows["rank"].to_numpy()[:-1]) | (rows["sample"].to_numpy()[1:] != rows["sample"].to_numpy()[:-1]))
            group = np.cumsum(opens) - 1
            for begin in range(0, int(group[-1]) + 1, 256):
                part = (group >= begin) & (group < begin + 256)
                n = int(group[part][-1]) - begin + 1
                who, what = rows["participant"][part].map(at).to_numpy(), rows["channel"][part].map(place).to_numpy()
                x, seen = np.zeros((n, len(people), len(names))), np.zeros((n, len(people)))
                x[group[part] - begin, who, what] = rows["value"][part].to_numpy()
                seen[group[part] - begin, who] = 1.0
                v = np.einsum("npc,pck->npk", (x - means) * seen[:, :, None], loads).reshape(n, size)
                total += v.sum(axis=0)
                square += v.T @ v
                count += n

        for b in batches:
            rows = b if held is None else pd.concat([held, b], ignore_index=True)
            if len(rows):
                last = (rows["rank"] == rows["rank"].iloc[-1]) & (rows["sample"] == rows["sample"].iloc[-1])
                cut = int(last.to_numpy().argmax())
                if cut:
                    close(rows.iloc[:cut])
                held = rows.iloc[cut:]
        if held is not None:
            close(held)
            v = np.concatenate([square.ravel(), total, np.full(size, float(count))])
            yield pd.DataFrame({"i": np.repeat(np.arange(size + 2), size), "j": np.tile(np.arange(size), size + 2), "v": v})

    ordered = ranked.select("rank", "sample", "participant", "channel", "value").repartition("rank", "sample").sortWithinPartitions("rank", "sample")
    rows = ordered.mapInPandas(sums, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    full = np.zeros((size + 2, size))
    for r in rows:
        full[r["i"], r["j"]] = r["v"]
    n = full[size + 1, 0]
    mean = full[size] / n
    return (full[:size] - n * np.outer(mean, mean)) / max(1, n - 1)
