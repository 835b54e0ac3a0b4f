"""Whole fits against a second reading of the method: all placements of the events are enumerated, trial by trial."""

import itertools
import math

import numpy as np
import pytest

from trialweave.functions.patterns import Pattern
from trialweave.plans import crossval
from trialweave.plans.event_model import EventModel, Grouping, Params, TrialData
from trialweave.plans.search import EliminativeMethod

LOCATION = 2
PATTERN = Pattern(100.0, 3, LOCATION, (0.5, 1.0, 0.5))


@pytest.fixture(scope="module")
def trials():
    rng = np.random.default_rng(11)
    out = {}
    for k in range(9):
        t = int(rng.integers(10, 14))
        x = rng.normal(0, 0.6, (t, 2))
        x[2 + k % 2] += (2.5, 0.5)
        x[6 + k % 3] += (-0.5, 2.0)
        out["ab"[k % 2] if k < 8 else "c", k] = x
    return out


@pytest.fixture(scope="module")
def data(spark, trials):
    rows = [(p, e, len(x), x.tolist(), e % 2) for (p, e), x in trials.items()]
    return TrialData(spark.createDataFrame(rows, "participant string, epoch long, duration int, cc array<array<double>>, condition int").repartition(3), 2, PATTERN)


def density(scale, longest, middle):
    p = [t * math.exp(-t / scale) for t in range(longest)]
    p = [x / sum(p) for x in p]
    return [1e-15] * LOCATION + p[LOCATION:] if middle else p


def expectations(trials, scales, b, longest):
    """Log-likelihood, mean magnitudes, mean positions, mean duration."""
    n = len(b)
    stages = [density(s, longest, 0 < k < n) for k, s in enumerate(scales)]
    ll, mags, at = 0.0, np.zeros((n, 2)), np.zeros(n)
    for x in trials:
        gain = np.exp(x @ b.T - (b**2).sum(axis=1) / 2)
        total, probs = 0.0, np.zeros((len(x), n))
        for where in itertools.combinations_with_replacement(range(len(x)), n):
            w = stages[0][where[0]] * stages[n][len(x) - 1 - where[-1]]
            for k, place in enumerate(where):
                w *= gain[place, k] * (stages[k][place - where[k - 1]] if k else 1.0)
            total += w
            for k, place in enumerate(where):
                probs[place, k] += w
        ll += math.log(total)
        mags += (probs / total).T @ x
        at += np.arange(len(x)) @ (probs / total)
    m = len(trials)
    return ll, mags / m, at / m, sum(map(len, trials)) / m


def plain_fit(trials, scales, b, longest, tolerance=1e-4):
    trace = []
    while True:
        ll, mags, at, mean = expectations(trials, scales, b, longest)
        trace.append(ll)
        if len(trace) > 1 and tolerance > (trace[-1] - trace[-2]) / abs(trace[-2]):
            return scales, b, trace
        b, scales = mags, np.diff(np.concatenate([[0], at, [mean - 1]])) / 2


def start(trials, n):
    mean = np.mean([len(x) for x in trials])
    return np.full(n + 1, mean / (n + 1) / 2), np.zeros((n, 2))


@pytest.mark.parametrize("n", [1, 2])
def test_fit(data, trials, n):
    some = list(trials.values())
    longest = max(map(len, some))
    scales, b, trace = plain_fit(some, *start(some, n), longest)
    model = EventModel(PATTERN, n).fit(data)
    assert [t.sum() for t in model.traces] == pytest.approx(trace, abs=1e-8) and len(trace) > 3
    assert np.allclose(model.params.scales[0], scales, atol=1e-8) and np.allclose(model.params.magnitudes[0], b, atol=1e-8)


def test_elimination(data, trials):
    some = list(trials.values())
    longest = max(map(len, some))
    want = {3: plain_fit(some, *start(some, 3), longest)}
    for n in (2, 1):
        s, b, _ = want[n + 1]
        tried = []
        for k in range(n + 1):
            less = np.concatenate([s[:k], [s[k] + s[k + 1]], s[k + 2 :]])
            tried.append(plain_fit(some, less, np.delete(b, k, axis=0), longest))
        want[n] = max(tried, key=lambda x: x[2][-1])
    found = EliminativeMethod(PATTERN, max_events=3).fit(data).submodels
    assert {n: m.loglik.sum() for n, m in found.items()} == pytest.approx({n: x[2][-1] for n, x in want.items()}, abs=1e-8)
    assert np.allclose(found[1].params.magnitudes[0], want[1][1], atol=1e-8)


def test_best_of_several_starts(data, trials):
    some = list(trials.values())
    longest = max(map(len, some))
    model = EventModel(PATTERN, 2, starting_points=3, max_scale=12.0, seed=5)
    tried = [plain_fit(some, p.scales[0], p.magnitudes[0], longest) for p in model.starts(data, Grouping.make(2), {0: np.mean([len(x) for x in some])})]
    model.fit(data)
    assert len(tried) == 4 and model.loglik.sum() == pytest.approx(max(x[2][-1] for x in tried), abs=1e-8)


def test_groups_share_what_the_maps_say(data, trials):
    """One group's missing event, shared first and last stages: M-steps averaged by hand."""
    by = {g: [x for (_, e), x in trials.items() if e % 2 == g] for g in (0, 1)}
    longest = {g: max(map(len, x)) for g, x in by.items()}
    model = EventModel(PATTERN, 2, max_iteration=3, tolerance=-1e9)
    with pytest.warns(UserWarning):
        model.fit(data, by={"condition": [0, 1]}, channel_map=[[0, 0], [0, -1]], time_map=[[0, 0, 0], [0, -1, 0]])
    s = {g: np.full(n + 1, np.mean([len(x) for x in by[g]]) / (n + 1) / 2) for g, n in ((0, 2), (1, 1))}
    b = {0: np.zeros((2, 2)), 1: np.zeros((1, 2))}
    trace = []
    for i in range(4):
        got = {g: expectations(by[g], s[g], b[g], longest[g]) for g in by}
        trace.append([got[0][0], got[1][0]])
        if i == 3:
            break
        for g in by:
            _, b[g], at, mean = got[g]
            s[g] = np.diff(np.concatenate([[0], at, [mean - 1]])) / 2
        b[0][0] = b[1][0] = (b[0][0] + b[1][0]) / 2
        s[0][0] = s[1][0] = (s[0][0] + s[1][0]) / 2
        s[0][2] = s[1][1] = (s[0][2] + s[1][1]) / 2
    assert np.allclose(np.array(model.traces), trace, atol=1e-8)
    assert np.isnan(model.params.magnitudes[1, 1]).all() and np.isnan(model.params.scales[1, 1])
    assert np.allclose(model.params.scales[0], s[0], atol=1e-8)


def test_left_out_participants(data, trials):
    """Fits without each participant, which is then scored with stages stretched to its mean duration."""
    whole = list(trials.values())
    scales, b, _ = plain_fit(whole, *start(whole, 1), max(map(len, whole)))
    want = {}
    for p in "abc":
        others, own = [x for (q, _), x in trials.items() if q != p], [x for (q, _), x in trials.items() if q == p]
        s, m, _ = plain_fit(others, scales, b, max(map(len, others)))
        ratio = np.mean([len(x) for x in own]) / np.mean([len(x) for x in others])
        want[p] = expectations(own, s * ratio, m, max(map(len, own)))[0]
    model = EventModel(PATTERN, 1)
    model.params, model.grouping = Params(scales[None], b[None]), Grouping.make(1)
    got = {r["participant"]: r["loglik"] for r in crossval.loocv(data, model).collect()}
    assert got == pytest.approx(want, abs=1e-8)
