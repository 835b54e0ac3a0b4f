"""Scoring of trials as they arrive, by a fitted model.

Samples of a trial are kept as state until its response marker comes (or the watermark
passes it); then the trial is cross-correlated, scored and let go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trialweave.functions import kernels
from trialweave.plans.event_model import EventModel

#: Most samples kept for one trial.
MOST_SAMPLES = 100_000
OUT = "participant string, epoch long, duration int, event int, time double, loglik double, error string"


def score_trial(x: np.ndarray, model: EventModel, longest: int) -> tuple[list[int], float]:
    """Most likely samples of the events of one trial's components (sample x component)."""
    template = np.asarray(model.pattern.template)
    half = len(template) // 2
    wide = np.pad(x, ((half, len(template)), (0, 0)))
    cc = np.stack([(wide[i : i + len(template)] * template[:, None]).sum(axis=0) for i in range(len(x))])
    p = model.params.of(0)
    pmfs = kernels.stage_pmfs(model.distribution, p.scales, max(longest, len(x)), 0)
    probs, loglik = kernels.forward_backward(cc[None], np.array([len(x)]), p.magnitudes, pmfs)
    return probs[0].argmax(axis=0).tolist(), float(loglik[0])


def score_stream(stream: DataFrame, model: EventModel, *, longest: int, delay: str = "1 minute") -> DataFrame:
    """``stream(participant string, epoch long, ts timestamp, sample int, x array<double>, response boolean)``
    to a row per trial and event.  Trials without a response are dropped when the watermark passes.
    A trial of more than ``MOST_SAMPLES`` samples gives one row with an error and no event; what
    else comes of it is ignored, and other trials are not disturbed."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        samples, values, failed = state.get if state.exists else ([], [], False)
        held = [] if failed else list(zip(samples, values, strict=True))
        ended, last = False, 0
        for b in batches:
            if not failed:
                held += [(int(s), [float(v) for v in x]) for s, x in zip(b["sample"], b["x"], strict=True)]
            ended |= bool(b["response"].any())
            last = max(last, int(b["ts"].max().timestamp() * 1000))
            if len(held) > MOST_SAMPLES:
                yield pd.DataFrame({"participant": [key[0]], "epoch": [key[1]], "duration": [len(held)], "event": [None], "time": [None], "loglik": [None], "error": [f"more than {MOST_SAMPLES} samples"]})
                held, failed = [], True
        if ended and failed:
            if state.exists:
                state.remove()
            return
        if not ended:
            state.update(([s for s, _ in held], [x for _, x in held], failed))
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 60_000)
            return
        if state.exists:
            state.remove()
        held.sort(key=lambda r: r[0])
        times, loglik = score_trial(np.array([x for _, x in held]), model, longest)
        yield pd.DataFrame({"participant": key[0], "epoch": key[1], "duration": len(held), "event": np.arange(len(times)), "time": np.asarray(times, float), "loglik": loglik, "error": None})

    return stream.withWatermark("ts", delay).groupBy("participant", "epoch").applyInPandasWithState(step, OUT, "samples array<int>, x array<array<double>>, failed boolean", "append", GroupStateTimeout.EventTimeTimeout)


def live_durations(stream: DataFrame, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Trials and mean durations per window of their response's time."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", window), "participant").agg(F.count("*").alias("trials"), F.avg("duration").alias("duration"))
