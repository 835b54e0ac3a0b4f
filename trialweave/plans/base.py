"""What all estimators of events have in common."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame


class Estimator(ABC):
    """Something with a pattern that is fitted to trials and then gives their event probabilities."""

    @abstractmethod
    def fit(self, data, **options) -> Estimator: ...

    @abstractmethod
    def transform(self, data, **options) -> DataFrame: ...

    def fit_transform(self, data, **options) -> DataFrame:
        return self.fit(data, **options).transform(data)

    @property
    def sfreq(self) -> float:
        return self.pattern.sfreq

    @property
    def location(self) -> int:
        """Samples after an event that cannot hold the next one."""
        return self.pattern.location
