"""Cumulative search with ``by_sample``: every sample of the trial is proposed, between found events too."""

import numpy as np

from trialweave.functions.patterns import half_sine
from trialweave.plans.event_model import EventModel, Params, TrialData
from trialweave.plans.search import CumulativeMethod


def test_proposals_go_between_found_events(spark, monkeypatch):
    pattern, seen = half_sine(100.0), []

    def fit(self, data, candidates):
        """EM as a stand-in: the first event is found at sample 40, the second at 20, no third."""
        at = np.cumsum(self.distribution.scale_to_mean(candidates[0].scales[0]))
        new = int(np.flatnonzero(~candidates[0].magnitudes[0].any(axis=1))[0])
        seen.append((self.n_events, at, new))
        found = {1: [40.0, 20.0], 2: [20.0, 20.0, 20.0]}.get(self.n_events)
        rises = found is not None and (self.n_events == 1 or 10 <= at[new] <= 30)
        self.params = Params(self.distribution.mean_to_scale(np.array(found))[None], np.ones((1, self.n_events, 2))) if found else None
        self.loglik = np.array([float(self.n_events) if rises else -9.0])
        return self

    monkeypatch.setattr(EventModel, "fit", fit)
    data = TrialData(spark.createDataFrame([(60,)] * 3, "duration int"), 2, pattern)
    model = CumulativeMethod(pattern, by_sample=True).fit(data).model
    assert model.n_events == 2
    assert [round(float(at[new])) for _, at, new in seen] == list(range(1, 60))
    assert all(abs(at[-1] - 60) < 1.5 for _, at, _ in seen)
    assert {new for n, _, new in seen if n == 3} == {0, 1, 2} and {new for n, _, new in seen if n == 2} == {0}
