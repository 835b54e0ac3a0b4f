"""Hidden semi-Markov event models fitted by expectation-maximisation.

Trials are rows of a cached DataFrame; an EM step is one job over them.  All candidates
(starting points, elimination candidates) and all groups are handled in the same pass,
parameters travel in the closure, and only sums come back, already added up by Spark.
"""

from __future__ import annotations

import itertools
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from trialweave.functions import kernels
from trialweave.functions.distributions import Distribution, Gamma
from trialweave.functions.patterns import Pattern
from trialweave.operators import preprocess, reduction
from trialweave.plans.base import Estimator
from trialweave.schema import TRIAL

#: Trials of one padded block.
BLOCK = 256
#: About the bytes of a partition of trials that are kept for many passes.
KEPT_BYTES = 32 << 20


@dataclass(frozen=True)
class TrialData:
    """``frame``: participant, epoch, duration, cc (and metadata); ``components``: their number;
    ``lengths``: the same trials without cc, where they are cheaper to have than the frame."""

    frame: DataFrame
    components: int
    pattern: Pattern
    lengths: DataFrame | None = None

    @classmethod
    def from_samples(cls, samples: DataFrame, pattern: Pattern, metadata: DataFrame | None = None, partitions: int | None = None, keep: bool = True) -> TrialData:
        """Cross-correlates preprocessed samples and gathers each trial into a row; ``keep`` holds them in
        memory for the many passes of a fit, in partitions of about ``KEPT_BYTES`` (one per core at least).
        Without it the durations come from a pass over the samples' keys, as the number of components
        always does, so that only the model itself needs the gathered trials."""
        rows = preprocess.gathered(preprocess.cross_correlate(samples, pattern.template)).withColumnRenamed("x", "cc")
        if metadata is not None:
            rows = rows.join(metadata, TRIAL, "left")
        components = len(reduction.channel_names(samples))
        if not components:
            raise ValueError("there are no trials")
        if partitions:
            rows = rows.repartition(partitions, *TRIAL)
        elif keep:  # a pass over many nearly empty partitions costs more than the work in them
            cells = samples.groupBy().agg(F.count("*")).first()[0]
            rows = rows.coalesce(max(samples.sparkSession.sparkContext.defaultParallelism, -(-cells * 8 // KEPT_BYTES)))
        if keep:
            return cls(rows.persist(), components, pattern)
        lengths = samples.groupBy(*TRIAL, "channel").agg(F.count("*").alias("n")).groupBy(*TRIAL).agg(F.max("n").cast("int").alias("duration"))
        return cls(rows, components, pattern, lengths if metadata is None else lengths.join(metadata, TRIAL, "left"))

    def _lengths(self) -> DataFrame:
        return self.frame if self.lengths is None else self.lengths

    def durations(self) -> DataFrame:
        return self._lengths().select(*TRIAL, "duration")

    def offsets(self) -> DataFrame:
        """Running first and last row numbers of the trials in (participant, epoch) order."""
        return offsets(self.durations())

    def sizes(self) -> tuple[int, int]:
        r = self._lengths().agg(F.count("*").alias("n"), F.sum("duration").alias("s")).first()
        return r["n"], r["s"]

    def max_events(self) -> int:
        """As many events as fit the 10th percentile of durations."""
        q = self._lengths().agg(F.percentile("duration", 0.1).alias("q")).first()["q"]
        return int(np.rint(q // self.pattern.location))

    def where(self, condition) -> TrialData:
        return TrialData(self.frame.where(condition), self.components, self.pattern, None if self.lengths is None else self.lengths.where(condition))


def offsets(durations: DataFrame) -> DataFrame:
    """Adds start and end: row numbers if trials stood one after another in (participant, epoch) order.

    Sums run inside participants; only one row per participant meets in a single task."""
    before = durations.groupBy("participant").agg(F.sum("duration").alias("_d")).withColumn("_before", F.expr("sum(_d) over (order by participant)") - F.col("_d")).drop("_d")
    ends = durations.join(before, "participant").withColumn("end", F.expr("sum(duration) over (partition by participant order by epoch)") + F.col("_before") - 1)
    return ends.withColumn("start", F.col("end") - F.col("duration") + 1).drop("_before")


@dataclass(frozen=True)
class Grouping:
    """Trials by products of metadata values, and which groups share events' and stages' parameters.

    In the maps equal numbers in a column are shared, -1 means the event or stage is missing."""

    modalities: tuple[dict, ...] = ({},)
    channel_map: tuple[tuple[int, ...], ...] = ()
    time_map: tuple[tuple[int, ...], ...] = ()

    @classmethod
    def make(cls, n_events: int, by: dict[str, list] | None = None, channel_map=None, time_map=None) -> Grouping:
        rows = [dict(zip(by, values, strict=True)) for values in itertools.product(*by.values())] if by else [{}]
        channel_map = tuple(map(tuple, channel_map if channel_map is not None else [[0] * n_events] * len(rows)))
        time_map = tuple(map(tuple, time_map if time_map is not None else [[0] * (n_events + 1)] * len(rows)))
        if len(channel_map) != len(rows) or len(time_map) != len(rows):
            raise ValueError("maps need a row for each group")
        for c, t in zip(channel_map, time_map, strict=True):
            if len(c) != n_events or len(t) != n_events + 1:
                raise ValueError("maps have the wrong number of events or stages")
            if sum(x >= 0 for x in c) + 1 != sum(x >= 0 for x in t):
                raise ValueError("a group needs one stage more than events")
        return cls(tuple(rows), channel_map, time_map)

    def code(self, frame: DataFrame) -> DataFrame:
        """Adds ``grp``; the last modality varies fastest.  Trials of no group go."""
        out = F.lit(None).cast("int")
        for g, values in enumerate(self.modalities):
            fits = F.lit(True)
            for column, value in values.items():
                fits = fits & (F.col(column) == F.lit(value))
            out = F.when(fits, F.lit(g)).otherwise(out)
        return frame.withColumn("grp", out).where("grp is not null")

    def __len__(self) -> int:
        return len(self.modalities)


@dataclass(frozen=True)
class Params:
    """scales (groups, stages) and magnitudes (groups, events, components); NaN where missing."""

    scales: np.ndarray
    magnitudes: np.ndarray

    def of(self, g: int) -> kernels.GroupParams:
        events = np.flatnonzero(~np.isnan(self.magnitudes[g]).any(axis=1))
        stages = np.flatnonzero(~np.isnan(self.scales[g]))
        return kernels.GroupParams(self.magnitudes[g][events], self.scales[g][stages], tuple(events.tolist()), tuple(stages.tolist()))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(group, rows of the batch, padded cc, durations) of blocks of trials of a group; trials of a length
    stand together, so there is little padding."""
    cc = batch.column("cc")
    ends = cc.offsets.to_numpy()
    inner = cc.values[ends[0] : ends[-1]] if len(ends) else cc.values
    widths = np.diff(inner.offsets.to_numpy())
    if len(widths) and (widths != widths[0]).any():
        raise ValueError("trials differ in their number of components")
    flat = inner.flatten().to_numpy(zero_copy_only=False)
    ends = ends - ends[0]
    samples = flat.reshape(len(inner), widths[0] if len(widths) else 0)
    durations = np.diff(ends).astype(np.int64)
    groups = batch.column("grp").to_numpy(zero_copy_only=False)
    for g in np.unique(groups):
        own = np.flatnonzero(groups == g)
        own = own[np.argsort(durations[own], kind="stable")]
        for i in range(0, len(own), BLOCK):
            rows = own[i : i + BLOCK]
            length = durations[rows]
            inside = np.arange(length[-1])[None, :] < length[:, None]
            out = np.zeros((*inside.shape, samples.shape[1]))
            out[inside] = samples[(ends[rows][:, None] + np.arange(length[-1])[None, :])[inside]]
            yield int(g), rows, out, length


def e_step_sums(frame: DataFrame, candidates: list[Params], distribution: Distribution, longest: dict[int, int], location: int) -> dict[tuple[int, int], dict]:
    """For every candidate and group: n, sum of log-likelihoods, magnitudes, positions, durations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pmfs = {}
        out: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for g, _, cc, durations in _blocks(batch):
                for k, params in enumerate(candidates):
                    p = params.of(g)
                    if (k, g) not in pmfs:
                        pmfs[k, g] = kernels.stage_pmfs(distribution, p.scales, longest[g], location)
                    probs, loglik = kernels.forward_backward(cc, durations, p.magnitudes, pmfs[k, g])
                    b, pos, total = kernels.m_step_sums(probs, cc, durations)
                    v = np.concatenate([[len(durations), loglik.sum(), total], pos, b.ravel()])
                    out[k, g] = out.get((k, g), 0) + v
        for (k, g), v in out.items():
            n = len(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)), pa.array(np.full(n, g, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(v)], ["k", "g", "i", "v"])

    rows = frame.select("grp", "cc").mapInArrow(run, "k int, g int, i int, v double").groupBy("k", "g", "i").agg(F.sum("v").alias("v")).collect()
    found: dict[tuple[int, int], dict[int, float]] = {}
    for r in rows:
        found.setdefault((r["k"], r["g"]), {})[r["i"]] = r["v"]
    out = {}
    for (k, g), cells in found.items():
        v = np.array([cells[i] for i in range(len(cells))])
        e = len(candidates[k].of(g).events)
        out[k, g] = {"n": v[0], "loglik": v[1], "duration": v[2], "positions": v[3 : 3 + e], "magnitudes": v[3 + e :].reshape(e, -1)}
    return out


def probabilities(frame: DataFrame, params: Params, distribution: Distribution, longest: dict[int, int], location: int) -> DataFrame:
    """A row per trial: its columns but cc, events (numbers), probs (event, sample), loglik."""
    keep = [c for c in frame.columns if c != "cc"]
    schema = StructType([frame.schema[c] for c in keep]).add("events", ArrayType(IntegerType())).add("probs", ArrayType(ArrayType(DoubleType()))).add("loglik", DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pmfs = {}
        for batch in batches:
            for g, rows, cc, durations in _blocks(batch):
                p = params.of(g)
                if g not in pmfs:
                    pmfs[g] = kernels.stage_pmfs(distribution, p.scales, longest[g], location)
                probs, loglik = kernels.forward_backward(cc, durations, p.magnitudes, pmfs[g])
                n, _, e = probs.shape
                flat = np.moveaxis(probs, 2, 1)[np.broadcast_to(np.arange(probs.shape[1]) < durations[:, None, None], (n, e, probs.shape[1]))]
                inner = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.repeat(durations, e))), pa.int32()), pa.array(flat))
                outer = pa.array(np.arange(n + 1) * e, pa.int32())
                events = pa.ListArray.from_arrays(outer, pa.array(np.tile(np.array(p.events, np.int32), n), pa.int32()))
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keep), events, pa.ListArray.from_arrays(outer, inner), pa.array(loglik, mask=~np.isfinite(loglik))], [*keep, "events", "probs", "loglik"])

    return frame.mapInArrow(run, schema)


def gains(frame: DataFrame, magnitudes: np.ndarray) -> DataFrame:
    """participant, epoch, sample, event, gain: the factor by which an event at a sample raises the likelihood."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows, cc, durations in _blocks(batch):
                gain = np.exp(kernels.log_gains(cc, magnitudes))
                trial, sample, event = (x.ravel() for x in np.indices(gain.shape))
                real = sample < durations[trial]
                trial, sample, event = trial[real], sample[real], event[real]
                at = pa.array(rows[trial])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in TRIAL), pa.array(sample, pa.int32()), pa.array(event, pa.int32()), pa.array(gain[trial, sample, event])], [*TRIAL, "sample", "event", "gain"])

    kinds = dict(frame.dtypes)
    return frame.select(*TRIAL, F.lit(0).alias("grp"), "cc").mapInArrow(run, f"participant {kinds['participant']}, epoch {kinds['epoch']}, sample int, event int, gain double")


def exploded(probs: DataFrame) -> DataFrame:
    """participant, epoch, grp, event, sample, prob."""
    by_event = probs.select(*TRIAL, "grp", F.explode(F.arrays_zip("events", "probs")).alias("e"))
    return by_event.select(*TRIAL, "grp", F.col("e.events").alias("event"), F.posexplode("e.probs").alias("sample", "prob"))


@dataclass
class EventModel(Estimator):
    """A given number of events; ``fit`` and ``transform`` over TrialData."""

    pattern: Pattern
    n_events: int
    distribution: Distribution = field(default_factory=Gamma)
    fixed_time_pars: tuple[int, ...] = ()
    fixed_channel_pars: tuple[int, ...] = ()
    tolerance: float = 1e-4
    max_iteration: int = 1000
    min_iteration: int = 1
    starting_points: int = 1
    max_scale: float | None = None
    seed: int = 0

    params: Params | None = None
    grouping: Grouping | None = None
    loglik: np.ndarray | None = None
    traces: list[np.ndarray] = field(default_factory=list)
    time_pars_dev: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.n_events != int(self.n_events) or self.n_events < 1:
            raise ValueError("n_events is a positive integer")

    # -- starting points

    def _with_gaps(self, scales: np.ndarray, magnitudes: np.ndarray, grouping: Grouping) -> Params:
        s, b = np.array(scales, float), np.array(magnitudes, float)
        for g in range(len(grouping)):
            s[g, np.array(grouping.time_map[g]) < 0] = np.nan
            b[g, np.array(grouping.channel_map[g]) < 0] = np.nan
        return Params(s, b)

    def default_start(self, data: TrialData, grouping: Grouping, mean_duration: dict[int, float]) -> Params:
        s = np.zeros((len(grouping), self.n_events + 1))
        for g in range(len(grouping)):
            stages = sum(x >= 0 for x in grouping.time_map[g])
            s[g] = self.distribution.mean_to_scale(mean_duration.get(g, 1.0) / stages)
        return self._with_gaps(s, np.zeros((len(grouping), self.n_events, data.components)), grouping)

    def random_start(self, rng: np.random.Generator, max_scale: float) -> np.ndarray:
        """Stage scales from sorted random event positions at least an event's width apart."""
        width, n = self.pattern.width_samples, self.n_events
        if width * (n + 1) >= max_scale:
            raise ValueError("max_scale has no room for the events")
        while True:
            at = np.sort(rng.integers(0, int(max_scale), n))
            gaps = np.diff(np.concatenate([[0], at, [max_scale]]))
            if (gaps >= width).all():
                return np.asarray(self.distribution.mean_to_scale(gaps.astype(float)))

    # -- fitting

    def prepare(self, data: TrialData, grouping: Grouping) -> tuple[DataFrame, dict[int, int], dict[int, float]]:
        frame = grouping.code(data.frame)
        rows = grouping.code(data._lengths()).groupBy("grp").agg(F.max("duration").alias("d"), F.avg("duration").alias("m")).collect()
        if not rows:
            raise ValueError("no trial belongs to a group")
        return frame, {r["grp"]: r["d"] for r in rows}, {r["grp"]: r["m"] for r in rows}

    def em(self, frame: DataFrame, starts: list[Params], grouping: Grouping, longest: dict[int, int]) -> list[tuple[Params, np.ndarray, list, list]]:
        """All candidates together, a job per iteration; each stops by itself."""
        now, first = list(starts), starts
        state = e_step_sums(frame, now, self.distribution, longest, self.pattern.location)
        groups = range(len(grouping))
        score = [np.array([state[k, g]["loglik"] if (k, g) in state else 0.0 for g in groups]) for k in range(len(now))]
        traces, dev = [[s] for s in score], [[p.scales.copy()] for p in now]
        before = [-np.inf] * len(now)
        live, i = list(range(len(now))), 0
        while live and i < self.max_iteration:
            still = []
            for k in live:
                total = float(score[k].sum())
                done = i >= self.min_iteration and (not np.isfinite(total) or self.tolerance > (total - before[k]) / abs(before[k]))
                if not done:
                    before[k] = total
                    still.append(k)
            live = still
            if not live:
                break
            for k in live:
                now[k] = self._m_step(now[k], first[k], {g: state[k, g] for g in groups if (k, g) in state}, grouping)
            part = e_step_sums(frame, [now[k] for k in live], self.distribution, longest, self.pattern.location)
            for j, k in enumerate(live):
                for g in groups:
                    if (j, g) in part:
                        state[k, g] = part[j, g]
                score[k] = np.array([state[k, g]["loglik"] if (k, g) in state else 0.0 for g in groups])
                traces[k].append(score[k])
                dev[k].append(now[k].scales.copy())
            i += 1
        if live and i == self.max_iteration:
            warnings.warn("EM stopped at max_iteration", stacklevel=2)
        return [(now[k], score[k], traces[k], dev[k]) for k in range(len(now))]

    def _m_step(self, params: Params, first: Params, sums: dict[int, dict], grouping: Grouping) -> Params:
        s, b = params.scales.copy(), params.magnitudes.copy()
        for g, x in sums.items():
            p = params.of(g)
            b[g, list(p.events)] = x["magnitudes"] / x["n"]
            s[g, list(p.stages)] = kernels.scales_from_positions(self.distribution, x["positions"] / x["n"], x["duration"] / x["n"])
        for k in self.fixed_channel_pars:
            b[:, k] = first.magnitudes[:, k]
        for k in self.fixed_time_pars:
            s[:, k] = first.scales[:, k]
        for table, mapping in ((b, grouping.channel_map), (s, grouping.time_map)):
            m = np.array(mapping)
            for column in range(m.shape[1]):
                for value in np.unique(m[:, column]):
                    rows = np.flatnonzero(m[:, column] == value)
                    if value >= 0 and len(rows) > 1:
                        table[rows, column] = table[rows, column].mean(axis=0)
        return Params(s, b)

    def starts(self, data: TrialData, grouping: Grouping, mean_duration: dict[int, float]) -> list[Params]:
        out = [self.default_start(data, grouping, mean_duration)]
        if self.starting_points > 1:
            if self.max_scale is None:
                raise ValueError("several starting points need max_scale")
            rng = np.random.default_rng(self.seed)
            for _ in range(self.starting_points):
                s = np.tile(self.random_start(rng, self.max_scale), (len(grouping), 1))
                out.append(self._with_gaps(s, np.zeros((len(grouping), self.n_events, data.components)), grouping))
        return out

    def fit(self, data: TrialData, *, time_pars=None, channel_pars=None, by: dict[str, list] | None = None, channel_map=None, time_map=None, candidates: list[Params] | None = None) -> EventModel:
        """``time_pars``: scales (stages) or (groups, stages); ``channel_pars`` (events, components) or with groups."""
        grouping = Grouping.make(self.n_events, by, channel_map, time_map)
        frame, longest, mean_duration = self.prepare(data, grouping)
        starts = candidates or self.starts(data, grouping, mean_duration)
        if time_pars is not None or channel_pars is not None:
            base = starts[0]
            s = np.broadcast_to(np.asarray(time_pars, float), base.scales.shape) if time_pars is not None else base.scales
            b = np.broadcast_to(np.asarray(channel_pars, float), base.magnitudes.shape) if channel_pars is not None else base.magnitudes
            starts = [self._with_gaps(s, b, grouping)]
        fits = self.em(frame, starts, grouping, longest)
        best = max(range(len(fits)), key=lambda k: (np.isfinite(fits[k][1].sum()), fits[k][1].sum() if np.isfinite(fits[k][1].sum()) else 0.0))
        self.params, self.loglik, self.traces, self.time_pars_dev = fits[best]
        if not np.isfinite(self.loglik.sum()):
            raise ValueError("no starting point has a finite likelihood")
        self.grouping = grouping
        return self

    def _fitted(self) -> Params:
        if self.params is None:
            raise ValueError("the model is not fitted")
        return self.params

    def transform(self, data: TrialData, *, location: bool = False) -> DataFrame:
        """Per trial: events, probs, loglik (see ``probabilities``); stages are not censored unless asked."""
        params = self._fitted()
        frame, longest, _ = self.prepare(data, self.grouping)
        return probabilities(frame, params, self.distribution, longest, self.pattern.location if location else 0)

    # -- results as rows

    def time_pars(self, spark) -> DataFrame:
        s = self._fitted().scales
        return spark.createDataFrame([(g, k, float(self.distribution.shape), float(s[g, k])) for g in range(s.shape[0]) for k in range(s.shape[1]) if not np.isnan(s[g, k])], "grp int, stage int, shape double, scale double")

    def channel_pars(self, spark) -> DataFrame:
        b = self._fitted().magnitudes
        return spark.createDataFrame([(g, e, c, float(b[g, e, c])) for g in range(b.shape[0]) for e in range(b.shape[1]) for c in range(b.shape[2]) if not np.isnan(b[g, e, c])], "grp int, event int, component int, value double")

    def trace(self, spark) -> DataFrame:
        self._fitted()
        return spark.createDataFrame([(i, g, float(x)) for i, t in enumerate(self.traces) for g, x in enumerate(t)], "iteration int, grp int, loglik double")

    def save(self) -> dict:
        """All that is needed to use the model again, as plain values."""
        p = self._fitted()
        return {"n_events": self.n_events, "distribution": type(self.distribution).__name__.lower(), "shape": self.distribution.shape, "pattern": vars(self.pattern), "scales": p.scales.tolist(), "magnitudes": p.magnitudes.tolist(), "modalities": list(self.grouping.modalities), "channel_map": self.grouping.channel_map, "time_map": self.grouping.time_map}

    @classmethod
    def load(cls, saved: dict) -> EventModel:
        from trialweave.functions.distributions import FAMILIES

        pattern = Pattern(**{**saved["pattern"], "template": tuple(saved["pattern"]["template"])})
        model = cls(pattern, saved["n_events"], FAMILIES[saved["distribution"]](saved["shape"]))
        model.params = Params(np.array(saved["scales"], float), np.array(saved["magnitudes"], float))
        model.grouping = Grouping(tuple(saved["modalities"]), tuple(map(tuple, saved["channel_map"])), tuple(map(tuple, saved["time_map"])))
        return model
