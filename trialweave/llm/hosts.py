"""URL filters: fixed rules first, then empirical-Bayes host reputation.

Labelled page outcomes (1 good, 0 bad) are counted per host, registered domain and
public suffix.  Each level's good rate is shrunk through a beta prior whose mean is its
parent's shrunk rate: suffix to the whole table, domain to suffix, host to domain.  The
prior's strength is fitted per level by moments.  A page is blocked when even the upper
bound of its host's posterior good rate lies under ``least_good``; hosts without labels
take their domain's, suffix's or the whole table's posterior.

Counting is by partial aggregates, so one host may hold any share of all rows; the
tables that are joined back have a row per host, domain or suffix, and Spark may split hot
hosts in those joins.  Counts and each level's posterior are written once and read again.

Defined results: a url that is null or has no "://" has empty host and path, takes the
verdict of the whole table's posterior, and its outcome counts for no host; equal rows get
equal verdicts; without labelled outcomes the prior is uniform and nothing is blocked by it;
no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.llm.shared import Scratch

#: (host and path, verdict) of the fixed rules.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Suffixes of two labels; all others are the last label.
DOUBLE_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.za", "com.cn", "co.in")
Z = 1.645
LEAST_GOOD = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame) -> DataFrame:
    """``pages`` with host and path."""
    after = F.when(F.locate("://", F.col("url")) > 0, F.expr("substr(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(F.coalesce(after, F.lit("")), r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.coalesce(after, F.lit("")), r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": F.translate(host, _UPPER, _LOWER), "path": path})


def with_levels(df: DataFrame) -> DataFrame:
    """``df(host)`` with domain and suffix; a port or trailing dot is not part of them."""
    bare = F.regexp_replace("host", r":[0-9]*$", "")
    two = F.substring_index(bare, ".", -2)
    suffix = F.when(two.isin(*DOUBLE_SUFFIXES), two).otherwise(F.substring_index(bare, ".", -1))
    domain = F.when(two.isin(*DOUBLE_SUFFIXES), F.substring_index(bare, ".", -3)).otherwise(two)
    return df.withColumns({"domain": domain, "suffix": suffix})


def rule_columns(rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """Longest fitting rule (null if none) and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: len(r[0])):  # later ones are longer and overrule
        h, slash, p = text.partition("/")
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(slash + p)
        name, verdict = F.when(fits, F.lit(text)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _strength(counts: DataFrame) -> Column:
    """Moment estimate of a beta prior's strength a + b from rows (n, good, prior mean m).

    Excess of the squared deviations over binomial noise gives the between-group variance.
    """
    p = F.col("good") / F.col("n")
    noise = F.sum(F.col("m") * (1 - F.col("m")))
    spread = F.sum(F.col("n") * (p - F.col("m")) * (p - F.col("m")))
    between = (spread - noise) / F.sum(F.col("n"))
    level = F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))) / F.sum("n")
    return F.least(F.lit(1000.0), F.greatest(F.lit(2.0), F.when(between > 0, level / between - 1).otherwise(F.lit(1000.0))))


def reputation(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """From ``outcomes(host, good)``: tables of host, domain, suffix and the whole, each
    with its key(s), mean and strength of the posterior."""
    scratch = Scratch(outcomes.sparkSession, "hosts")
    counted = outcomes.where("good is not null and host is not null and host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.sum("good").alias("good"))
    hosts = scratch.table(with_levels(counted), "counts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    whole = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    top = scratch.table(whole.select(((F.col("good") + 1.0) / (F.col("n") + 2.0)).alias("mean"), (F.col("n") + 2.0).alias("strength")), "whole")

    def shrunk(counts: DataFrame, parent: DataFrame, on: str | None, name: str) -> DataFrame:
        m = parent.select(*([on] if on else []), F.col("mean").alias("m"))
        joined = scratch.table(counts.join(m, on) if on else counts.crossJoin(F.broadcast(m)), f"{name}-prior")  # a single row
        k = joined.agg(F.coalesce(_strength(joined), F.lit(2.0)).alias("k"))
        posterior = joined.crossJoin(F.broadcast(k)).withColumns({"mean": (F.col("good") + F.col("k") * F.col("m")) / (F.col("n") + F.col("k")), "strength": F.col("n") + F.col("k")})  # a single row
        out = scratch.table(posterior.drop("n", "good", "m", "k"), name)
        scratch.drop(f"{name}-prior")
        return out

    s = shrunk(suffixes, top, None, "suffixes")
    d = shrunk(domains, s, "suffix", "domains").drop("suffix")
    h = shrunk(hosts.drop("suffix"), d, "domain", "hosts").drop("domain")
    scratch.drop("counts")
    return h, d, s, top


def judge(pages: DataFrame, outcomes: DataFrame, *, rules: tuple[tuple[str, str], ...] = RULES, z: float = Z, least_good: float = LEAST_GOOD) -> DataFrame:
    """``pages(page_id, url)`` with host, path, rule, good_mean, good_bound, verdict.

    ``outcomes``: (host, good) of labelled pages."""
    h, d, s, top = reputation(outcomes)
    rule, fixed = rule_columns(rules)
    rows = with_levels(with_parts(pages.select("page_id", "url"))).withColumns({"rule": rule, "fixed": fixed}).drop("url")
    # Levels are joined to the distinct hosts, and only that table to the pages.
    known = rows.select("host", "domain", "suffix").distinct()
    for table, key, name in ((h, "host", "h"), (d, "domain", "d"), (s, "suffix", "s")):
        known = known.join(table.select(key, F.col("mean").alias(f"{name}_mean"), F.col("strength").alias(f"{name}_strength")), key, "left")
    known = known.crossJoin(F.broadcast(top)).select(
        "host",
        F.coalesce("h_mean", "d_mean", "s_mean", "mean").alias("good_mean"),
        F.coalesce("h_strength", "d_strength", "s_strength", "strength").alias("strength"),
    )
    bound = F.col("good_mean") + z * F.sqrt(F.col("good_mean") * (1 - F.col("good_mean")) / (F.col("strength") + 1))
    known = known.select("host", "good_mean", F.least(F.lit(1.0), bound).alias("good_bound"))
    return rows.join(known, "host", "left").select(
        "page_id", "host", "path", "rule", "good_mean", "good_bound",
        F.coalesce("fixed", F.when(F.col("good_bound") < least_good, "block").otherwise("allow")).alias("verdict"),
    )
