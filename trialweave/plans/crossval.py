"""Leave-one-participant-out cross-validation of event models."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.functions.patterns import Pattern
from trialweave.plans.event_model import EventModel, Params, TrialData, e_step_sums
from trialweave.plans.search import CumulativeMethod, EliminativeMethod


def split(data: TrialData, participant) -> tuple[TrialData, TrialData]:
    """(others, the one left out)."""
    return data.where(F.col("participant") != F.lit(participant)), data.where(F.col("participant") == F.lit(participant))


#: Most folds: each is a fit of its own.
MOST_FOLDS = 10_000


def participants(data: TrialData) -> list:
    found = sorted(r[0] for r in data.durations().select("participant").distinct().limit(MOST_FOLDS + 1).collect())
    if len(found) > MOST_FOLDS:
        raise ValueError(f"more than {MOST_FOLDS} participants to leave out")
    return found


def left_out_loglik(model: EventModel, data: TrialData, participant) -> float:
    """Log-likelihood of the left-out participant; stage scales are stretched by its mean duration."""
    others, own = split(data, participant)
    ratio = own.frame.agg(F.avg("duration")).first()[0] / others.frame.agg(F.avg("duration")).first()[0]
    params = Params(model.params.scales * ratio, model.params.magnitudes)
    frame, longest, _ = model.prepare(own, model.grouping)
    found = e_step_sums(frame, [params], model.distribution, longest, model.pattern.location)
    return float(sum(x["loglik"] for x in found.values()))


def refit(model: EventModel, data: TrialData) -> EventModel:
    again = EventModel(model.pattern, model.n_events, model.distribution, model.fixed_time_pars, model.fixed_channel_pars, model.tolerance, model.max_iteration)
    if len(model.grouping) == 1:
        return again.fit(data, candidates=[model.params])
    by: dict[str, list] = {}
    for row in model.grouping.modalities:
        for k, v in row.items():
            by.setdefault(k, [])
            if v not in by[k]:
                by[k].append(v)
    return again.fit(data, by=by, channel_map=model.grouping.channel_map, time_map=model.grouping.time_map, candidates=[model.params])


def loocv(data: TrialData, models: EventModel | list[EventModel] | EliminativeMethod) -> DataFrame:
    """n_event, participant, loglik of every model refitted without each participant."""
    some = list(models.submodels.values()) if isinstance(models, EliminativeMethod) else models if isinstance(models, list) else [models]
    return loocv_func(data, lambda others: [refit(m, others) for m in some])


def loocv_func(data: TrialData, estimate: Callable[[TrialData], EventModel | list[EventModel] | EliminativeMethod | CumulativeMethod]) -> DataFrame:
    """The same with any way to estimate; stacks are cut to the sizes that all folds reach."""
    rows = []
    for p in participants(data):
        found = estimate(split(data, p)[0])
        if isinstance(found, EliminativeMethod):
            found = list(found.submodels.values())
        elif isinstance(found, CumulativeMethod):
            found = [found.model]
        for m in found if isinstance(found, list) else [found]:
            rows.append((m.n_events, p, left_out_loglik(m, data, p)))
    kinds = dict(data.frame.dtypes)["participant"]
    folds = len({r[1] for r in rows})
    full = {n for n in {r[0] for r in rows} if sum(r[0] == n for r in rows) == folds}
    return data.frame.sparkSession.createDataFrame([r for r in rows if r[0] in full] or rows, f"n_event int, participant {kinds}, loglik double")


def loocv_backward(data: TrialData, method: EliminativeMethod) -> DataFrame:
    """Elimination done anew without each participant."""
    return loocv_func(data, lambda others: EliminativeMethod(method.pattern, method.distribution, method.max_events, method.min_events, None, method.tolerance, method.max_iteration).fit(others))


def loocv_fit_backward(data: TrialData, search: CumulativeMethod) -> DataFrame:
    """Adding events, then eliminating from what was found, without each participant."""

    def both(others: TrialData) -> EliminativeMethod:
        found = CumulativeMethod(search.pattern, search.distribution, search.step, search.end, search.by_sample, search.tolerance).fit(others)
        return EliminativeMethod(search.pattern, search.distribution, base_fit=found.model).fit(others)

    return loocv_func(data, both)


def fit_n(pattern: Pattern, n_events: int, **options) -> Callable[[TrialData], EventModel]:
    """For ``loocv_func``: a model of ``n_events``, with parameters to start from if given.

    >>> loocv_func(data, fit_n(half_sine(100.0), 2))
    """
    return lambda others: EventModel(pattern, n_events).fit(others, **options)


def fit_eliminated_then_grouped(pattern: Pattern, max_events: int, n_events: int, **grouping) -> Callable[[TrialData], list[EventModel]]:
    """For ``loocv_func``: eliminates from ``max_events`` events, then fits groups (``by``, ``channel_map``,
    ``time_map``) from the model of ``n_events`` that was found; both are scored.

    >>> loocv_func(data, fit_eliminated_then_grouped(half_sine(100.0), 5, 2, by={"condition": [0, 1]}, time_map=[[0, 0, 0], [0, 1, 0]]))
    """

    def both(others: TrialData) -> list[EventModel]:
        found = EliminativeMethod(pattern, max_events=max_events, min_events=n_events - 1).fit(others).submodels[n_events]
        grouped = EventModel(pattern, n_events).fit(others, time_pars=found.params.scales[0], channel_pars=found.params.magnitudes[0], **grouping)
        return [found, grouped]

    return both


def mean_and_error(loo: DataFrame) -> DataFrame:
    """Per n_event: mean log-likelihood, its standard error, participants."""
    return loo.groupBy("n_event").agg(F.avg("loglik").alias("mean"), (F.stddev_samp("loglik") / F.sqrt(F.count("*"))).alias("se"), F.count("*").alias("n"))


def best_size(loo: DataFrame) -> int:
    rows = mean_and_error(loo).collect()
    return int(rows[int(np.argmax([r["mean"] for r in rows]))]["n_event"])
