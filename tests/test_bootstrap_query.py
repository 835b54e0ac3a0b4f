"""The registered bootstrap draws as often as the operator does by itself."""

from trialweave import queries
from trialweave.operators import results


def test_bootstrap_query_draws_200(spark, sf):
    samples = queries.l1(spark, sf).select("sample", "channel", "epoch", "value")
    ends = lambda df: {(r["sample"], r["channel"]): (round(r["low"], 9), round(r["high"], 9)) for r in df.where("low is not null").collect()}
    got = ends(queries.bootstrap_erp(spark, sf))
    assert got == ends(results.bootstrap_mean(samples, ["sample", "channel"], draws=200))
    assert got != ends(results.bootstrap_mean(samples, ["sample", "channel"], draws=50))
