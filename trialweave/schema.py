"""Row shapes of the engine.

samples  participant, epoch, sample INT, channel STRING, value DOUBLE   (a trial is (participant, epoch))
trials   participant, epoch, any metadata columns
triggers participant, sample BIGINT, prev INT, code INT
trials_cc participant, epoch, grp INT, duration INT, cc ARRAY<ARRAY<DOUBLE>> (sample, component)

Ragged trials have no rows past their end; NaN is never stored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

TRIAL = ["participant", "epoch"]


def by_trial(samples: DataFrame) -> DataFrame:
    """The rows of a trial stand together: all that follows per trial (windows over its channels, sums
    over its samples, gathering) needs no shuffle of its own."""
    return samples.repartition(*TRIAL)


@dataclass(frozen=True)
class SignalMeta:
    """Facts about a recording that are not rows."""

    sfreq: float
    offset: int = 0
    lowpass: float | None = None
    highpass: float | None = None
    lower_limit_rt: float = 0.0
    upper_limit_rt: float = float("inf")
    reject_threshold: float | None = None

    @property
    def step_ms(self) -> float:
        return 1000.0 / self.sfreq
