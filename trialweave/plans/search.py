"""Search for the number of events: by elimination from the most, or by adding one at a time."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.functions.distributions import Distribution, Gamma, Lognorm
from trialweave.functions.patterns import Pattern
from trialweave.plans.base import Estimator
from trialweave.plans.event_model import EventModel, Params, TrialData


@dataclass
class EliminativeMethod(Estimator):
    """Fits the largest model, then drops the event whose loss costs least, down to one more than ``min_events``."""

    pattern: Pattern
    distribution: Distribution = field(default_factory=Gamma)
    max_events: int | None = None
    min_events: int = 0
    base_fit: EventModel | None = None
    tolerance: float = 1e-4
    max_iteration: int = 1000
    submodels: dict[int, EventModel] = field(default_factory=dict)

    def fit(self, data: TrialData) -> EliminativeMethod:
        most = self.max_events or data.max_events()
        model = self.base_fit or EventModel(self.pattern, most, self.distribution, tolerance=self.tolerance, max_iteration=self.max_iteration).fit(data)
        most = model.n_events
        self.submodels = {most: model}
        for n in range(most - 1, self.min_events, -1):
            above = self.submodels[n + 1]
            s, b = above.params.scales[0], above.params.magnitudes[0]
            starts = []
            for k in range(n + 1):  # without event k its two stages are one
                scales = np.delete(s, k + 1)
                scales[k] = s[k] + s[k + 1]
                starts.append(Params(scales[None], np.delete(b, k, axis=0)[None]))
            self.submodels[n] = EventModel(self.pattern, n, self.distribution, tolerance=self.tolerance, max_iteration=self.max_iteration).fit(data, candidates=starts)
        return self

    def transform(self, data: TrialData) -> DataFrame:
        """All submodels' probabilities, told apart by ``n_events``."""
        out = None
        for n, model in sorted(self.submodels.items()):
            one = model.transform(data).withColumn("n_events", F.lit(n))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        if out is None:
            raise ValueError("the model is not fitted")
        return out


@dataclass
class CumulativeMethod(Estimator):
    """Adds events from the start of the trial on while the likelihood rises.

    With ``by_sample`` each sample of the trial is proposed once, also between events already found."""

    pattern: Pattern
    distribution: Distribution = field(default_factory=Gamma)
    step: int | None = None
    end: int | None = None
    by_sample: bool = False
    tolerance: float = 1e-4
    final_tolerance: float | None = None
    max_iteration: int = 1000
    model: EventModel | None = None
    accepted: list[tuple[int, float]] = field(default_factory=list)

    def fit(self, data: TrialData) -> CumulativeMethod:
        if isinstance(self.distribution, Lognorm):
            warnings.warn("scales of a lognormal do not add up; positions are approximate", stacklevel=2)
        d, width = self.distribution, self.pattern.width_samples
        step = 1 if self.by_sample else self.step or width
        mean = float(data.frame.agg(F.avg("duration")).first()[0])
        end = self.end or mean
        most = data.max_events()
        floor = float(d.mean_to_scale(1.0))
        scales = np.array([d.mean_to_scale(end)])
        b = np.zeros((0, data.components))
        best, previous, j, n = -np.inf, 0.0, 1, 1
        model = None
        base = EventModel(self.pattern, 1, d, tolerance=self.tolerance, max_iteration=self.max_iteration)
        while n <= most and (self.by_sample or float(d.scale_to_mean(scales[-1])) >= self.pattern.location):
            at = previous + j * step
            if at >= end:
                break
            edges = np.append(np.cumsum(d.scale_to_mean(scales[:-1])), end)
            k = int(np.searchsorted(edges[:-1], at))  # the stage that holds the new event is split
            edges = np.insert(edges, k, at)
            split = scales.copy()
            split[-1] = d.mean_to_scale(max(edges[-1] - edges[-2], 1.0))
            halves = [d.mean_to_scale(max(edges[k] - (edges[k - 1] if k else 0.0), 1.0)), d.mean_to_scale(max(edges[k + 1] - edges[k], 1.0))]
            split = np.maximum(np.concatenate([split[:k], halves, split[k + 1 :]]), floor)
            start = Params(split[None], np.insert(b, k, 0.0, axis=0)[None])
            trial = replace(base, n_events=n, params=None, traces=[], time_pars_dev=[])
            try:
                trial.fit(data, candidates=[start])
                gain = float(trial.loglik.sum()) - best
            except ValueError:
                gain = -np.inf
            if gain > 0:
                model, best = trial, float(trial.loglik.sum())
                scales, b = trial.params.scales[0], trial.params.magnitudes[0]
                reached = float(np.sum(d.scale_to_mean(scales[:-1])))
                self.accepted.append((n, best))
                previous, j, n = (0.0, j + 1, n + 1) if self.by_sample else (reached, 1, n + 1)
            else:
                explored = previous + j * step
                j = max(int((explored - previous + 1) // step), j + 1)
        if model is None:
            raise ValueError("no event was found")
        if self.final_tolerance is not None:
            final = replace(base, n_events=model.n_events, tolerance=self.final_tolerance, params=None, traces=[], time_pars_dev=[])
            model = final.fit(data, candidates=[model.params])
        self.model = model
        return self

    def transform(self, data: TrialData) -> DataFrame:
        if self.model is None:
            raise ValueError("the model is not fitted")
        return self.model.transform(data)
