"""Numpy kernels against enumeration of all event placements, and the waveforms and families."""

import itertools
import math

import numpy as np
import pytest

from trialweave.functions import kernels
from trialweave.functions.distributions import Gamma, Lognorm, Wald, Weibull
from trialweave.functions.patterns import arbitrary, half_sine
from trialweave.operators import stats


def test_half_sine():
    p = half_sine(100)
    assert (p.width_samples, p.location) == (5, 5)
    assert np.allclose(p.template, [0.1236068, 0.3236068, 0.4, 0.3236068, 0.1236068])
    assert (half_sine(250).width_samples, half_sine(250).location) == (12, 12)
    assert (half_sine(500).width_samples, half_sine(500).location) == (25, 25)
    assert arbitrary(100, [1, 2]).template == (1.0, 2.0)


@pytest.mark.parametrize(("d", "scale", "mean"), [(Gamma(2), 3, 6), (Gamma(4), 2, 8), (Wald(2), 3, 6), (Wald(4), 2, 8), (Weibull(2), 3, 3 * math.gamma(1.5)), (Weibull(4), 2, 2 * math.gamma(1.25))])
def test_conversions(d, scale, mean):
    assert math.isclose(d.scale_to_mean(scale), mean) and math.isclose(d.mean_to_scale(mean), scale)


def test_lognormal_conversions():
    assert math.isclose(Lognorm(1).scale_to_mean(math.log(3)), math.exp(math.log(3) + 0.5))
    assert math.isclose(Lognorm(0.5).mean_to_scale(math.exp(2)), math.exp(2 - 0.125))


@pytest.mark.parametrize("d", [Gamma(2), Lognorm(0.5), Wald(2), Weibull(2)])
def test_pmf_sums_to_one(d):
    assert math.isclose(d.pmf(7.0, 60).sum(), 1.0) and (d.pmf(7.0, 60) >= 0).all()


@pytest.mark.parametrize(("t", "e", "location"), [(6, 1, 0), (8, 2, 0), (8, 2, 3), (7, 3, 2)])
def test_forward_backward_is_enumeration(t, e, location):
    rng = np.random.default_rng(t * 10 + e)
    longest = t + 3
    cc, b = rng.normal(size=(t, 2)), rng.normal(size=(e, 2)) * 0.7
    pmfs = kernels.stage_pmfs(Gamma(2), rng.uniform(0.7, 2, e + 1), longest, location)
    gain = np.exp(cc @ b.T - (b**2).sum(axis=1) / 2)
    want, total = np.zeros((t, e)), 0.0
    for at in itertools.product(range(t), repeat=e):
        if any(x > y for x, y in zip(at, at[1:], strict=False)):
            continue
        w = pmfs[0][at[0]]
        for k in range(e):
            w *= gain[at[k], k]
        for k in range(1, e):
            w *= pmfs[k][at[k] - at[k - 1]]
        w *= pmfs[e][t - 1 - at[-1]]
        total += w
        for k in range(e):
            want[at[k], k] += w
    block = np.zeros((3, t + 4, 2))
    block[1, :t] = cc
    block[0, :2] = 1
    block[2] = rng.normal(size=(t + 4, 2))
    probs, loglik = kernels.forward_backward(block, np.array([2, t, t + 4 if t + 4 <= longest else longest]), b, pmfs)
    assert np.allclose(probs[1, :t], want / total) and math.isclose(loglik[1], math.log(total), rel_tol=1e-9)
    alone, ll = kernels.forward_backward(cc[None], np.array([t]), b, pmfs)
    assert np.allclose(alone[0], probs[1, :t]) and math.isclose(ll[0], loglik[1], rel_tol=1e-9)


def test_extreme_gains_do_not_underflow():
    cc = np.full((1, 50, 1), -400.0)
    probs, loglik = kernels.forward_backward(cc, np.array([50]), np.array([[3.0]]), kernels.stage_pmfs(Gamma(2), np.array([10.0, 10.0]), 50, 0))
    assert np.isfinite(loglik).all() and np.allclose(probs.sum(axis=1), 1)


def test_tail_probabilities():
    assert math.isclose(stats.t_test_greater(2.0, 10), 0.036694017, rel_tol=1e-6)
    assert math.isclose(stats.t_test_greater(-1.0, 5), 1 - stats.t_test_greater(1.0, 5))
    assert math.isclose(stats.incomplete_beta(2, 3, 0.4), 0.5248, rel_tol=1e-9)
    assert stats.sign_test(5, 0) == 0.0625 and stats.sign_test(0, 0) == 1.0
