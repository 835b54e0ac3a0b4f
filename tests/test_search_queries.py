"""The registered searches do the whole job: the operators' own defaults, on the tables of sf0.01."""

import pytest

from trialweave import queries

SF = "/root/testdata/sf0.01"


def test_cumulative_query_finds_all_events(spark):
    """Steps of an event's width and EM to its tolerance find three events; 25 samples and 20 iterations found two."""
    got = sorted((r["stage"], r["scale"]) for r in queries.cumulative(spark, SF).collect())
    assert [k for k, _ in got] == [0, 1, 2, 3]
    data = queries.data1(spark, SF)
    model = queries.EventModel(queries.PATTERN, 3).fit(data, time_pars=[s for _, s in got])
    assert float(model.loglik.sum()) >= -637.6


def test_eliminative_query_starts_at_the_most_events(spark):
    """Models of 11 (all that fit the shorter durations) down to 1 event; before, of 3 to 1."""
    got = {r["n_events"]: r["loglik"] for r in queries.eliminative(spark, SF).collect()}
    assert sorted(got) == list(range(1, queries.data1(spark, SF).max_events() + 1)) == list(range(1, 12))
    assert got[3] >= -637.4  # reached from four events; a fit of three from equal stages ends at -637.55
