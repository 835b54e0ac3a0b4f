"""Reading and signal operators against plain numpy, beyond what SQL says in the queries."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialweave.operators import epoching, preprocess, reduction, results, signal
from trialweave.sources import readers


def recording(n, channels=("x", "y"), seed=0):
    rng = np.random.default_rng(seed)
    return {c: rng.normal(size=n).cumsum() for c in channels}


def frame(spark, data, participant="p"):
    return spark.createDataFrame([(participant, i, c, float(v)) for c, x in data.items() for i, v in enumerate(x)], readers.RAW).repartition(5)


@pytest.mark.parametrize(("n", "block"), [(3, 64), (700, 64), (2_000, 500), (1_999, 1 << 15)])
def test_raw_filter_in_blocks_is_the_whole_filter(spark, n, block):
    data = recording(n)
    taps = signal.fir_taps(100.0, 2.0, 20.0)
    got = signal.filter_raw(frame(spark, data), 100.0, 2.0, 20.0, block=block).toPandas().sort_values("sample")
    assert len(got) == 2 * n
    for c, x in data.items():
        assert np.allclose(got[got["channel"] == c]["value"], signal.filtered(x, taps), atol=1e-9)


def test_lower_rate_comes_without_aliases(spark):
    """A frequency over half the new rate is gone before samples are dropped; a slow one stays."""
    t = np.arange(6_000) / 1000.0
    fast, slow = np.sin(2 * np.pi * 95 * t), np.sin(2 * np.pi * 5 * t)
    raw = frame(spark, {"fast": fast, "slow": slow})
    trig = spark.createDataFrame([("p", s, 0, c) for s, c in ((2000, 1), (2700, 5), (3500, 1), (4100, 5))], "participant string, sample long, prev int, code int")
    options = {"sfreq": 1000.0, "tmin": -0.1, "tmax": 1.5, "baseline": None}
    samples, trials = readers.read_raw_and_epoch(raw, trig, {"stim": 1}, {"resp": 5}, new_sfreq=100.0, **options)
    assert sorted(r["rt_samples"] for r in trials.collect()) == [60, 70]
    out = samples.toPandas()
    assert len(out) == 2 * 130 and set(out["sample"]) == set(range(70))
    assert out[out["channel"] == "fast"]["value"].abs().max() < 0.02
    one = out[(out["channel"] == "slow") & (out["epoch"] == 0)].sort_values("sample")
    assert np.allclose(one["value"], slow[2000:2700:10], atol=0.02)
    whole, _ = readers.read_raw_and_epoch(raw, trig, {"stim": 1}, {"resp": 5}, **options)
    assert whole.count() == 2 * 1300


def test_epochs_with_their_own_response_times(spark, tmp_path):
    data = recording(400)
    rows = [("p", e, i, c, float(v)) for e in range(3) for c, x in data.items() for i, v in enumerate(x)]
    spark.createDataFrame(rows, readers.SAMPLES).write.parquet(str(tmp_path / "e"))
    meta = spark.createDataFrame([("p", 0, 1500.0, "a"), ("p", 1, None, "b"), ("p", 7, 900.0, "c")], "participant string, epoch long, ms double, condition string")
    samples, trials = readers.read_epochs(spark, str(tmp_path / "e"), metadata=meta, rt_col="ms", scale=1000.0, sfreq=100.0, new_sfreq=50.0, channels=["x"])
    assert [(r["epoch"], r["rt_samples"], r["condition"]) for r in trials.where("epoch = 0").collect()] == [(0, 75, "a")]
    x = samples.toPandas().sort_values("sample")
    assert np.allclose(x["value"], signal.resampled(data["x"], 200)[:75], atol=1e-9)
    samples, trials = readers.read_epochs(spark, str(tmp_path / "e"), sfreq=100.0, reference="average")
    assert trials.count() == 3 and samples.count() == 2400
    assert samples.groupBy("epoch", "sample").agg(F.abs(F.sum("value")).alias("s")).agg(F.max("s")).first()[0] < 1e-9


def test_stored_samples_without_missing_values(spark, tmp_path):
    rows = [("p", 0, 0, "x", 1.0), ("p", 0, 1, "x", float("nan")), ("p", 1, 0, "x", float("nan")), ("p", 2, 0, "x", None)]
    spark.createDataFrame(rows, readers.SAMPLES).write.parquet(str(tmp_path / "s"))
    assert [tuple(r) for r in readers.load_samples(spark, str(tmp_path / "s")).collect()] == [rows[0]]


def test_participants_of_files_and_folders(spark, tmp_path):
    spark.createDataFrame([("?", 0, 0, "x", 1.0)], readers.SAMPLES).write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([("?", 0, 0, "x", 2.0)], readers.SAMPLES).write.csv(str(tmp_path / "b.csv"), header=True)
    files = [str(tmp_path / "a"), f"file://{tmp_path}/b.csv"]
    got = readers.read_participants(spark, files)
    assert sorted((r["participant"], r["value"]) for r in got.collect()) == [("S0", 1.0), ("S1", 2.0)]
    with pytest.raises(ValueError):
        readers.read_participants(spark, [])
    with pytest.raises(ValueError):
        readers.read_participants(spark, files[:1] * 2)


def test_array_with_metadata(spark):
    meta = pd.DataFrame({"participant": ["p", "p"], "epoch": [0, 2], "condition": ["a", "b"]})
    got = readers.from_array(spark, np.arange(12.0).reshape(3, 1, 4), participants=["p"], channels=["x"], metadata=meta)
    assert sorted({(r["epoch"], r["condition"]) for r in got.collect()}) == [(0, "a"), (2, "b")]


def test_annotated_spans(spark):
    rng = np.random.default_rng(2)
    spans = [(p, int(a), int(a + rng.integers(0, 30))) for p in "ab" for a in rng.integers(0, 400, 12)]
    onsets = [(p, e, int(o)) for p in "abc" for e, o in enumerate(rng.integers(0, 500, 60))]
    want = sorted(o for o in onsets if not any(p == o[0] and a <= o[2] + 7 and b >= o[2] - 3 for p, a, b in spans))
    got = epoching.reject_annotated(spark.createDataFrame(onsets, "participant string, epoch long, onset long"), spark.createDataFrame(spans, "participant string, start long, stop long"), -3, 7)
    assert got.columns == ["participant", "epoch", "onset"] and sorted(map(tuple, got.collect())) == want
    assert 0 < len(want) < len(onsets)


def test_first_response_is_one_running_pass(spark):
    rng = np.random.default_rng(3)
    marks = [("p", i, float(t), str(k)) for i, (t, k) in enumerate(zip(np.sort(rng.uniform(0, 1000, 3_000)), rng.choice(["s", "r", "o"], 3_000)))]
    df = spark.createDataFrame(marks, "participant string, epoch long, at double, kind string")
    out = epoching.first_response(df, F.col("kind") == "s", F.col("kind") == "r", tmin=0, tmax=2)
    assert "unboundedpreceding$(), -1" in out._jdf.queryExecution().executedPlan().toString()
    want = {e: next((u - t for _, _, u, k in marks[e + 1 :] if k == "r"), None) for _, e, t, kind in marks if kind == "s"}
    got = {r["epoch"]: r["rt"] for r in out.collect()}
    assert got == {e: rt if rt is not None and rt <= 2 else None for e, rt in want.items()}


def test_covariance_of_channels_with_gaps(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3, 30, 4)) + 1e6
    rows = [("p", e, s, f"c{c}", float(x[e, s, c])) for e in range(3) for s in range(30) for c in range(4) if (s + c) % 5]
    rows.append(("p", 9, 0, "c0", 1.0))
    got = {(r["epoch"], r["a"], r["b"]): r["cov"] for r in reduction.trial_covariance(spark.createDataFrame(rows, readers.SAMPLES)).collect()}
    assert len(got) == 3 * 10 + 1 and got[9, "c0", "c0"] is None
    for e in range(3):
        for a in range(4):
            for b in range(a, 4):
                both = [s for s in range(30) if (s + a) % 5 and (s + b) % 5]
                assert got[e, f"c{a}", f"c{b}"] == pytest.approx(np.cov(x[e, both, a], x[e, both, b])[0, 1], abs=1e-6)


def test_pca_of_the_mean_covariance(spark):
    """Components span what an eigendecomposition written out here spans."""
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(5, 5))
    x = {(p, e): rng.normal(size=(40 + e, 5)) @ mix for p in "ab" for e in range(3 + (p == "b"))}
    samples = spark.createDataFrame([(p, e, s, f"c{c}", float(v[s, c])) for (p, e), v in x.items() for s in range(len(v)) for c in range(5)], readers.SAMPLES)
    weights, share = reduction.pca(samples, 3)
    got = weights.toPandas().pivot(index="channel", columns="component", values="w").to_numpy()
    cov = np.mean([np.mean([np.cov(v.T) for (q, _), v in x.items() if q == p], axis=0) for p in "ab"], axis=0)
    rows = cov - cov.mean(axis=0)
    values, vectors = np.linalg.eigh(rows.T @ rows)
    order = np.argsort(values)[::-1]
    for k in range(3):
        assert abs(got[:, k] @ vectors[:, order[k]]) == pytest.approx(1.0, abs=1e-6) and got[np.abs(got[:, k]).argmax(), k] > 0
    assert np.allclose(share, values[order] / values.sum(), atol=1e-9)
    projected = preprocess.project(samples, weights).toPandas()
    one = projected[(projected["participant"] == "a") & (projected["epoch"] == 1) & (projected["channel"] == "0")].sort_values("sample")
    assert np.allclose(one["value"], x["a", 1] @ got[:, 0], atol=1e-9)


def test_left_out_tests_are_exact(spark):
    """t and its p by integrating the density, and the sign test by counting, both written out here."""
    from math import comb, gamma, pi, sqrt

    rng = np.random.default_rng(6)
    gains = rng.normal(0.3, 1.0, 9)
    loo = [(1, p, 0.0) for p in range(9)] + [(2, p, float(g)) for p, g in enumerate(gains)]
    r = results.loo_tests(spark.createDataFrame(loo, "n_event int, participant long, loglik double")).first()
    t = gains.mean() / (gains.std(ddof=1) / 3)
    u = np.linspace(t, 400, 2_000_001)
    density = gamma(4.5) / (sqrt(8 * pi) * gamma(4)) * (1 + u**2 / 8) ** -4.5
    assert r["t"] == pytest.approx(t) and r["p_t"] == pytest.approx(np.trapezoid(density, u), abs=1e-6)
    k = int(min((gains > 0).sum(), (gains < 0).sum()))
    assert r["p_sign"] == pytest.approx(min(1, 2 * sum(comb(9, i) for i in range(k + 1)) / 512))


def test_bootstrap_intervals(spark):
    """As wide as theory says for a normal sample, shifted to the long tail for a skewed one, alike after repartitioning."""
    rng = np.random.default_rng(7)
    normal, skewed = rng.normal(10, 2, 900), rng.exponential(1.0, 60) ** 2
    rows = [("n", i, float(v)) for i, v in enumerate(normal)] + [("s", i, float(v)) for i, v in enumerate(skewed)] + [("c", i, 3.0) for i in range(5)] + [("n", -1, None)]
    df = spark.createDataFrame(rows, "channel string, epoch long, value double")
    got = {r["channel"]: r for r in results.bootstrap_mean(df.repartition(3), ["channel"], draws=2_000).collect()}
    n, s = got["n"], got["s"]
    assert n["mean"] == pytest.approx(normal.mean()) and n["high"] - n["low"] == pytest.approx(2 * 1.96 * normal.std() / 30, rel=0.1)
    assert s["high"] - s["mean"] > s["mean"] - s["low"] > 0
    assert (got["c"]["low"], got["c"]["high"]) == (3.0, 3.0)
    again = {r["channel"]: r["low"] for r in results.bootstrap_mean(df.repartition(1), ["channel"], draws=2_000).collect()}
    assert again == pytest.approx({k: r["low"] for k, r in got.items()})
    assert results.bootstrap_mean(df.limit(0), ["channel"]).count() == 0
    means = np.array([rng.choice(skewed, 60).mean() for _ in range(4_000)])
    low, high = results.bca_limits(skewed.mean(), float(((skewed - skewed.mean()) ** 3).mean() / skewed.std() ** 3), 60, means, 0.95)
    assert low > np.quantile(means, 0.025) and high > np.quantile(means, 0.975)


@pytest.mark.parametrize(("length", "n"), [(40, 100), (98, 50), (250, 100), (7, 7), (1, 12)])
def test_polyphase_resampling(length, n):
    """What zeros in between, one long filter and dropping give."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=length).cumsum()
    wide = np.concatenate([x[:1], x, x[-1:]])
    common = np.gcd(n, len(wide))
    up, down = n // common, len(wide) // common
    half = 10 * max(up, down)
    t = np.arange(2 * half + 1) - half
    h = np.sinc(t / max(up, down)) * np.kaiser(2 * half + 1, 5.0)
    h *= up / h.sum()
    spread = np.zeros(len(wide) * up)
    spread[::up] = wide - np.median(wide)
    want = np.convolve(spread, h)[half::down][:n] + np.median(wide)
    assert np.allclose(signal.poly_resampled(x, n), want if up != down else wide, atol=1e-9)
    slow = np.sin(np.arange(200) / 30)
    assert np.allclose(signal.poly_resampled(slow, 101)[10:-10], np.sin(np.arange(101) * 2 / 30 - 1 / 30)[10:-10], atol=0.01)
