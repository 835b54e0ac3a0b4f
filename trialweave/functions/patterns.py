"""Expected waveforms of an event."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Pattern:
    """A template; ``location`` samples after the start of a stage cannot hold the next event."""

    sfreq: float
    width_samples: int
    location: int
    template: tuple[float, ...]

    @property
    def steps(self) -> float:
        return 1000.0 / self.sfreq


def half_sine(sfreq: float, width: float = 50.0, location: float | None = None) -> Pattern:
    """Half a sine of ``width`` ms over the sum of its squares, sampled at the middles of the steps."""
    steps = 1000.0 / sfreq
    m = round(width / steps)
    t = np.arange(m) * steps + steps / 2
    wave = np.sin(2 * math.pi * t / 1000.0 * (1000.0 / (2 * width)))
    at = int(width / steps) if location is None else int(np.rint(location / steps))
    return Pattern(sfreq, m, at, tuple((wave / (wave**2).sum()).tolist()))


def arbitrary(sfreq: float, template: np.ndarray | list[float], location: int | None = None) -> Pattern:
    """A given template, taken as it is."""
    values = tuple(float(x) for x in template)
    return Pattern(sfreq, len(values), len(values) if location is None else int(location), values)
