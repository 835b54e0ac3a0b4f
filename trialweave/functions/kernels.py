"""Numpy kernels of the hidden semi-Markov model, for a block of trials at a time.

A block is padded to its longest trial; masks keep padding out, so the result does not
depend on how trials are put together.  Stage convolutions are one matrix product per
stage for the whole block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

CENSORED = 1e-15


@dataclass(frozen=True)
class GroupParams:
    """Present events' magnitudes (E x C), present stages' scales (E + 1), and their numbers."""

    magnitudes: np.ndarray
    scales: np.ndarray
    events: tuple[int, ...]
    stages: tuple[int, ...]


def stage_pmfs(distribution, scales: np.ndarray, length: int, location: int) -> np.ndarray:
    """Stage duration probabilities over the group's longest duration; the first ``location``
    entries of middle stages are censored, without normalising again."""
    out = np.stack([distribution.pmf(float(s), length) for s in scales])
    if location > 0 and len(out) > 2:
        out[1:-1, :location] = CENSORED
    return out


def _toeplitz(pmf: np.ndarray, t: int) -> np.ndarray:
    """K[s, u] = pmf[u - s] for u >= s."""
    padded = np.concatenate([np.zeros(t - 1), pmf[:t], np.zeros(max(0, t - len(pmf)))])
    view = np.lib.stride_tricks.sliding_window_view(padded, t)
    return view[::-1][:t]


def log_gains(cc: np.ndarray, magnitudes: np.ndarray) -> np.ndarray:
    """How much better (in logs) each event explains each sample than no event: (n, T, E)."""
    return np.einsum("ntc,ec->nte", cc, magnitudes) - (magnitudes**2).sum(axis=1) / 2


def forward_backward(cc: np.ndarray, durations: np.ndarray, magnitudes: np.ndarray, pmfs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``cc`` (n, T, C) to event probabilities (n, T, E) and log-likelihoods (n).

    Gains are scaled by their greatest value per trial and event; every path visits each
    event once, so adding the logs back is exact.
    """
    n, t, _ = cc.shape
    e = len(magnitudes)
    mask = np.arange(t)[None, :] < durations[:, None]
    log_gain = np.where(mask[:, :, None], log_gains(cc, magnitudes), -np.inf)
    top = log_gain.max(axis=1)
    gain = np.exp(log_gain - top[:, None, :])
    kernels = [_toeplitz(p, t) for p in pmfs]
    forward = np.empty((e, n, t))
    pmf0 = np.zeros(t)
    pmf0[: min(t, len(pmfs[0]))] = pmfs[0][:t]
    forward[0] = pmf0 * gain[:, :, 0]
    for k in range(1, e):
        forward[k] = (forward[k - 1] @ kernels[k]) * gain[:, :, k]
    backward = np.empty((e, n, t))
    left = durations[:, None] - 1 - np.arange(t)[None, :]
    backward[e - 1] = np.where(left >= 0, pmfs[e][np.clip(left, 0, len(pmfs[e]) - 1)], 0.0)
    for k in range(e - 2, -1, -1):
        backward[k] = (backward[k + 1] * gain[:, :, k + 1]) @ kernels[k + 1].T
    joint = np.clip(forward * backward, 0, None)
    total = joint[0].sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        loglik = np.log(total) + top.sum(axis=1)
        probs = np.where(total[None, :, None] > 0, joint / joint.sum(axis=2, keepdims=True), 0.0)
    return np.moveaxis(np.nan_to_num(probs), 0, 2), loglik


def m_step_sums(probs: np.ndarray, cc: np.ndarray, durations: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Sums over the block's trials: expected magnitudes (E x C), positions (E), durations."""
    return np.einsum("nte,ntc->ec", probs, cc), np.einsum("nte,t->e", probs, np.arange(probs.shape[1], dtype=float)), float(durations.sum())


def scales_from_positions(distribution, positions: np.ndarray, mean_duration: float) -> np.ndarray:
    """Stage scales from mean event positions; the last stage ends at the mean duration less one."""
    at = np.concatenate([positions, [mean_duration - 1.0]])
    return np.asarray(distribution.mean_to_scale(np.diff(at, prepend=0.0)))
