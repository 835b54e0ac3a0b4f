"""Stage durations: two-parameter families with a fixed shape.

Densities are without constant factors, as they are normalised over a window.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Distribution:
    shape: float

    def density(self, t: np.ndarray, scale: float) -> np.ndarray:
        raise NotImplementedError

    def scale_to_mean(self, scale):
        raise NotImplementedError

    def mean_to_scale(self, mean):
        raise NotImplementedError

    def draw(self, rng: np.random.Generator, mean: float) -> float:
        """A random duration of this mean."""
        raise NotImplementedError

    def pmf(self, scale: float, length: int) -> np.ndarray:
        """Density at 0 .. length - 1 over its sum."""
        p = np.nan_to_num(self.density(np.arange(length, dtype=float), scale), nan=0.0, posinf=0.0)
        total = p.sum()
        return p / total if total > 0 else np.zeros(length)


@dataclass(frozen=True)
class Gamma(Distribution):
    shape: float = 2.0

    def __post_init__(self) -> None:
        if self.shape < 1:
            raise ValueError("a gamma shape under 1 has no finite density at 0")

    def density(self, t, scale):
        return t ** (self.shape - 1) * np.exp(-t / scale)

    def draw(self, rng, mean):
        return rng.gamma(self.shape, self.mean_to_scale(mean))

    def scale_to_mean(self, scale):
        return scale * self.shape

    def mean_to_scale(self, mean):
        return mean / self.shape


@dataclass(frozen=True)
class Lognorm(Distribution):
    """``scale`` is the median; ``mean_to_scale`` takes and gives logarithms' natural forms and is
    not the inverse of ``scale_to_mean`` unless the scale is in logarithms."""

    shape: float = 1.0

    def density(self, t, scale):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(t > 0, np.exp(-(np.log(t / scale) ** 2) / (2 * self.shape**2)) / t, 0.0)

    def draw(self, rng, mean):
        return rng.lognormal(np.log(self.mean_to_scale(mean)), self.shape)

    def scale_to_mean(self, scale):
        return np.exp(scale + self.shape**2 / 2)

    def mean_to_scale(self, mean):
        return np.exp(np.log(mean) - self.shape**2 / 2)


@dataclass(frozen=True)
class Wald(Distribution):
    shape: float = 1.0

    def density(self, t, scale):
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            y = t / scale
            return np.where(t > 0, y**-1.5 * np.exp(-((y - self.shape) ** 2) / (2 * y * self.shape**2)), 0.0)

    def draw(self, rng, mean):
        return rng.wald(mean, self.mean_to_scale(mean))

    def scale_to_mean(self, scale):
        return scale * self.shape

    def mean_to_scale(self, mean):
        return mean / self.shape


@dataclass(frozen=True)
class Weibull(Distribution):
    shape: float = 2.0

    def __post_init__(self) -> None:
        if self.shape < 1:
            raise ValueError("a Weibull shape under 1 has no finite density at 0")

    def density(self, t, scale):
        return (t / scale) ** (self.shape - 1) * np.exp(-((t / scale) ** self.shape))

    def draw(self, rng, mean):
        return self.mean_to_scale(mean) * rng.weibull(self.shape)

    def scale_to_mean(self, scale):
        return scale * math.gamma(1 + 1 / self.shape)

    def mean_to_scale(self, mean):
        return mean / math.gamma(1 + 1 / self.shape)


FAMILIES = {"gamma": Gamma, "lognorm": Lognorm, "wald": Wald, "weibull": Weibull}
