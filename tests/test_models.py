"""Models on simulated recordings with known events."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.functions.patterns import half_sine
from trialweave.operators import epoching, preprocess, reduction, results, signal
from trialweave.plans import crossval, event_model, simulate
from trialweave.plans.event_model import EventModel, Grouping, TrialData
from trialweave.plans.search import CumulativeMethod, EliminativeMethod
from trialweave.plans.simulate import Source
from trialweave.schema import TRIAL
from trialweave.sources import readers

PATTERN = half_sine(100.0)
SOURCES = [Source("one", times_ms=(200, 260, 230)), Source("two", times_ms=(300, 240, 280)), Source("three", times_ms=(250, 310, 240)), Source("response", times_ms=(200, 240))]


@pytest.fixture(scope="module")
def recording(spark):
    samples, times = simulate.simulate(spark, SOURCES, 12, participants=("a", "b"), channels=6, seed=3)
    return samples.persist(), times.persist()


@pytest.fixture(scope="module")
def data(recording):
    pre = preprocess.preprocess(recording[0], method="pca", n_comp=3, apply_zscore="participant")
    return TrialData.from_samples(pre.samples, PATTERN, partitions=4)


@pytest.fixture(scope="module")
def model(data):
    return EventModel(PATTERN, 3, starting_points=6, max_scale=95, seed=2).fit(data)


def test_recovers_events(recording, data, model):
    times = results.event_times(event_model.exploded(model.transform(data)))
    pair = times.join(recording[1].withColumnRenamed("time", "true"), [*TRIAL, "event"]).collect()
    assert len(pair) == 3 * 24
    assert np.median([abs(r["time"] - r["true"]) for r in pair]) <= 1.0
    assert all(a.sum() <= b.sum() + 1e-6 for a, b in zip(model.traces[1:], model.traces[2:], strict=False)) or len(model.traces) < 3


def test_probabilities_and_sign(data, model):
    p = model.transform(data)
    sums = event_model.exploded(p).groupBy(*TRIAL, "event").agg(F.sum("prob").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in sums)
    flipped = TrialData(data.frame.withColumn("cc", F.transform("cc", lambda s: F.transform(s, lambda x: -x))), 3, PATTERN)
    other = EventModel.load(model.save())
    other.params = event_model.Params(model.params.scales, -model.params.magnitudes)
    a = {tuple(r)[:2]: r["loglik"] for r in p.select(*TRIAL, "loglik").collect()}
    b = {tuple(r)[:2]: r["loglik"] for r in other.transform(flipped).select(*TRIAL, "loglik").collect()}
    assert all(abs(a[k] - b[k]) < 1e-8 for k in a)
    again = TrialData(data.frame.repartition(1), 3, PATTERN)
    c = {tuple(r)[:2]: r["loglik"] for r in model.transform(again).select(*TRIAL, "loglik").collect()}
    assert all(abs(a[k] - c[k]) < 1e-9 for k in a)


def test_groups_shared_and_missing(data):
    model = EventModel(PATTERN, 2, max_iteration=8).fit(data, by={"participant": ["a", "b"]}, channel_map=[[0, 0], [0, -1]], time_map=[[0, 0, 0], [0, -1, 1]])
    b = model.params.magnitudes
    assert np.allclose(b[0, 0], b[1, 0]) and np.isnan(b[1, 1]).all() and np.isnan(model.params.scales[1, 1])
    events = {(r["grp"], r["event"]) for r in event_model.exploded(model.transform(data)).select("grp", "event").distinct().collect()}
    assert events == {(0, 0), (0, 1), (1, 0)}
    with pytest.raises(ValueError):
        Grouping.make(2, {"participant": ["a", "b"]}, [[0, 0], [0, -1]], [[0, 0, 0], [0, 0, 0]])


def test_fixed_parameters(data):
    model = EventModel(PATTERN, 2, fixed_time_pars=(0,), fixed_channel_pars=(1,), max_iteration=4).fit(data, time_pars=[9.0, 10.0, 11.0], channel_pars=np.full((2, 3), 0.3))
    assert model.params.scales[0, 0] == 9.0 and np.allclose(model.params.magnitudes[0, 1], 0.3)


def test_searches(data):
    found = EliminativeMethod(PATTERN, max_events=4, max_iteration=40).fit(data)
    assert sorted(found.submodels) == [1, 2, 3, 4]
    scores = [float(found.submodels[n].loglik.sum()) for n in (1, 2, 3, 4)]
    assert scores[2] > scores[1] > scores[0]
    assert found.transform(data).select("n_events").distinct().count() == 4
    more = CumulativeMethod(PATTERN, step=10).fit(data)
    assert more.model.n_events >= 2 and [s for _, s in more.accepted] == sorted(s for _, s in more.accepted)


def test_leave_one_out(data, model):
    loo = crossval.loocv(data, [EventModel(PATTERN, 1, max_iteration=5).fit(data), model])
    rows = {(r["n_event"], r["participant"]): r["loglik"] for r in loo.collect()}
    assert len(rows) == 4 and crossval.best_size(loo) == 3
    assert all(r["p_t"] is None or 0 <= r["p_t"] <= 1 for r in results.loo_tests(loo).collect())


def test_estimates_to_leave_one_out(data):
    from trialweave.plans.base import Estimator

    simple = crossval.loocv_func(data, crossval.fit_n(PATTERN, 1))
    both = crossval.loocv_func(data, crossval.fit_eliminated_then_grouped(PATTERN, 2, 1))
    want = {r["participant"]: r["loglik"] for r in simple.collect()}
    assert len(want) == 2
    got = both.collect()  # an eliminated model of one event, and one fitted from it
    assert {r["participant"] for r in got} == set(want) and {r["n_event"] for r in got} == {1}
    assert len(got) == 4 and all(np.isfinite(r["loglik"]) for r in got)
    for kind in (EventModel, EliminativeMethod, CumulativeMethod):
        assert issubclass(kind, Estimator)
    model = EventModel(PATTERN, 1, max_iteration=2, tolerance=-1e9)
    with pytest.warns(UserWarning):
        assert model.fit_transform(data).count() == data.frame.count() and model.location == PATTERN.location and model.sfreq == PATTERN.sfreq


def test_bids_folders(spark, tmp_path):
    for name, value in (("01", 1.0), ("02", 2.0)):
        spark.createDataFrame([("?", 0, 0, "x", value)], readers.SAMPLES).write.parquet(str(tmp_path / f"sub-{name}/eeg/run1"))
    got = readers.read_bids(spark, str(tmp_path))
    assert sorted((r["participant"], r["value"]) for r in got.collect()) == [("01", 1.0), ("02", 2.0)]
    assert {r["participant"] for r in readers.bids_participants(spark, str(tmp_path)).collect()} == {"01", "02"}


def test_reading_chain(spark):
    rng = np.random.default_rng(0)
    raw = spark.createDataFrame([("p", s, c, float(rng.normal())) for s in range(600) for c in ("x", "y")], readers.RAW)
    trig = spark.createDataFrame([("p", 100, 0, 1), ("p", 180, 0, 5), ("p", 300, 0, 1), ("p", 420, 0, 5), ("p", 500, 0, 1)], "participant string, sample long, prev int, code int")
    samples, trials = readers.read_raw_and_epoch(raw, trig, {"stim": 1}, {"resp": 5}, sfreq=100.0, tmin=-0.1, tmax=1.5, reference="average")
    got = {r["epoch"]: r["rt_samples"] for r in trials.collect()}
    assert sorted(got.values()) == [80, 120]
    assert samples.count() == 2 * 200
    flat = samples.groupBy("participant", "epoch", "sample").agg(F.sum("value").alias("s")).collect()
    assert len(flat) == 200
    with pytest.raises(ValueError):
        epoching.trim_rt(trials, 100.0, lower=-1)
    codes = spark.createDataFrame([("p", s, c) for s, c in enumerate([0, 1, 1, 0, 5, 6, 0])], "participant string, sample long, code int")
    assert sorted((r["sample"], r["code"]) for r in readers.detect_triggers(codes).collect()) == [(1, 1), (4, 5), (5, 1)]
    cube = np.arange(12, dtype=float).reshape(1, 2, 6)
    cube[0, :, 5] = np.nan
    assert readers.from_array(spark, cube, participants=["p"], channels=["x", "y"]).count() == 10


def test_bids_levels(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"value": {"Levels": {"stim/1": "Stimulus - left", "r5": "Response - hand", "x": "Stimulus - no number"}}}')
    got = sorted(map(tuple, readers.trigger_levels(spark, str(tmp_path / "e.json")).collect()))
    assert got == [(1, "Stimulus", "left"), (5, "Response", "hand")]


def test_filters_and_resampling(spark):
    t = np.arange(400) / 100.0
    slow, fast = np.sin(2 * np.pi * 5 * t), np.sin(2 * np.pi * 40 * t)
    out = signal.filtered(slow + fast, signal.fir_taps(100.0, None, 20.0))
    assert np.abs(out - slow)[50:-50].max() < 0.05
    out = signal.filtered(slow + 3.0, signal.fir_taps(100.0, 1.0, None))
    assert abs(out[100:-100].mean()) < 0.1
    assert np.allclose(signal.resampled(slow, 200), slow[::2], atol=1e-8)
    rows = spark.createDataFrame([("p", 0, i, "x", float(v)) for i, v in enumerate(slow)], readers.SAMPLES)
    assert signal.resample_trials(rows, 100.0, 50.0).count() == 200
    assert signal.resample_to(rows, 10).count() == 10


def test_mcca(spark):
    rng = np.random.default_rng(1)
    latent = rng.normal(size=(8, 40, 2))
    rows = []
    for p in ("a", "b", "c"):
        mix = rng.normal(size=(2, 5))
        x = latent @ mix + 0.05 * rng.normal(size=(8, 40, 5))
        rows += [(p, e, s, f"c{c}", float(x[e, s, c])) for e in range(8) for s in range(40) for c in range(5)]
    samples = preprocess.center(spark.createDataFrame(rows, readers.SAMPLES))
    for options in ({"cov": True}, {"cov": False}, {"cov": True, "ridge": 0.1}, {"cov": False, "averaged": True}):
        model = reduction.fit_mcca(samples, 2, n_pcs=2, **options)
        out = model.transform(samples).toPandas().pivot(index=["epoch", "sample"], columns=["channel", "participant"], values="value")
        for k in ("0", "1"):
            r = np.corrcoef(out[k].to_numpy().T)
            assert (np.abs(r) > 0.9).all(), options
    with pytest.raises(ValueError):
        reduction.fit_mcca(samples.where("participant = 'a'"), 2)
    only = reduction.fit_mcca(samples, 2, n_pcs=3, pca_only=True)
    assert only.matrix("a").shape == (5, 3) and np.allclose(only.matrix("a"), only.first["a"])
    assert only.transform(samples).select("channel").distinct().count() == 3


def test_options():
    assert preprocess.ZScore.parse(True) is preprocess.ZScore.TRIAL and preprocess.ZScore.parse(None) is preprocess.ZScore.NONE
    assert preprocess.Method.parse(None) is preprocess.Method.NONE
    with pytest.raises(ValueError):
        preprocess.ZScore.parse("no such")
    assert preprocess.suggested_components([0.7, 0.25, 0.05], 0.95) == 2


def test_topographies_are_told_apart(spark, recording):
    samples, times = recording
    found = results.group_channels(results.event_channels(samples, times.withColumn("grp", F.lit(0)).where("event < 3"))).select(F.col("event").alias("name"), "channel", "value")
    true = spark.createDataFrame([(i, f"c{c:03d}", float(v)) for i, s in enumerate(SOURCES[:-1]) for c, v in enumerate(simulate.topography(s.name, 6))], "name int, channel string, value double")
    assert {r["test"]: r["true"] for r in results.classify(found, true).collect()} == {0: 0, 1: 1, 2: 2}
    scales, values = simulate.true_parameters(samples, times, event_model.Gamma(2))
    assert scales.count() == 4 and values.count() == 18


def test_simulated_stages_and_proportions(spark):
    from trialweave.functions.distributions import FAMILIES

    shapes = {"gamma": 2.0, "lognorm": 0.5, "wald": 1.5, "weibull": 2.0}
    sources = [simulate.Source(n, mean_ms=400.0, distribution=FAMILIES[n](k), proportion=0.5 if n == "wald" else 1.0) for n, k in shapes.items()] + [simulate.Source("response", mean_ms=50.0)]
    samples, times = simulate.simulate(spark, sources, 600, channels=2, seed=4)
    rows = times.toPandas().pivot(index="epoch", columns="event", values="time")
    assert 240 < rows[2].isna().sum() < 360 and not rows[[0, 1, 3, 4]].isna().any().any()
    whole = rows.dropna()
    stages = whole[[0, 1, 2, 3]].diff(axis=1)
    stages[0] = whole[0]
    assert np.allclose(stages.mean(), 40, rtol=0.15)  # samples of 10 ms
    assert (rows[rows[2].isna()][3] > rows[rows[2].isna()][1]).all()
    triggers = simulate.trigger_table(times, 2_000)
    assert triggers.where("code = 4").count() == len(whole) and triggers.where("code = 1").count() == 600
    assert {r["since"] for r in simulate.trigger_intervals(triggers).where("code = 1 and number > 0").collect()} != {0}


def test_streaming_scorer_reports_a_trial_that_is_too_long(spark, tmp_path, model, monkeypatch):
    from trialweave.streaming import scorer

    monkeypatch.setattr(scorer, "MOST_SAMPLES", 50)
    schema = "participant string, epoch long, ts timestamp, sample int, x array<double>, response boolean"
    each = spark.range(80).select(F.lit("p").alias("participant"), F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("epoch"), F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("id") * 10).alias("ts"), F.col("id").cast("int").alias("sample"), F.array(*(F.sin(F.col("id") / (k + 2)) for k in range(3))).alias("x"), F.lit(False).alias("response"))
    each = each.where("epoch = 0 or sample < 40").withColumn("response", (F.col("epoch") == 1) & (F.col("sample") == 39) | (F.col("sample") == 79))
    each.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = scorer.score_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), model, longest=100).writeStream.outputMode("append").format("memory").queryName("long_trials").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.sql("select * from long_trials").collect()
    assert [(r["event"], r["loglik"], r["error"]) for r in got if r["epoch"] == 0] == [(None, None, "more than 50 samples")]
    assert sorted(r["event"] for r in got if r["epoch"] == 1) == [0, 1, 2] and all(r["error"] is None for r in got if r["epoch"] == 1)


def test_streaming_scorer(spark, tmp_path, data, model, recording):
    from trialweave.streaming.scorer import OUT, score_stream

    pre = preprocess.preprocess(recording[0], method="pca", n_comp=3, apply_zscore="participant").samples
    rows = preprocess.gathered(pre).where("participant = 'a' and epoch < 3")
    each = rows.select("participant", "epoch", F.posexplode("x").alias("sample", "x"), "duration").select("participant", "epoch", F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("sample") * 10).alias("ts"), F.col("sample").cast("int"), "x", (F.col("sample") == F.col("duration") - 1).alias("response"))
    each.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(each.schema).parquet(str(tmp_path / "in"))
    longest = data.frame.agg(F.max("duration")).first()[0]
    q = score_stream(stream, model, longest=longest).writeStream.outputMode("append").format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r["epoch"], r["event"]): r["time"] for r in spark.sql("select * from scored").collect()}
    want = {(r["epoch"], r["event"]): r["time"] for r in results.event_times(event_model.exploded(model.transform(data))).where("participant = 'a' and epoch < 3").collect()}
    assert got == want and "loglik" in OUT


def test_sinks(spark, tmp_path, data, model, recording):
    from trialweave import sinks

    sinks.write_samples(recording[0], str(tmp_path / "s"))
    assert readers.read_epochs(spark, str(tmp_path / "s"), sfreq=100.0)[0].count() == recording[0].count()
    assert readers.load_samples(spark, str(tmp_path / "s")).count() == recording[0].count()
    probs = event_model.exploded(model.transform(data))
    sinks.write_event_probabilities_csv(probs, str(tmp_path / "p.csv"))
    assert spark.read.csv(str(tmp_path / "p.csv"), header=True).count() == probs.count()
    sinks.write_model(model, str(tmp_path / "m.json"), spark)
    back = sinks.read_model(str(tmp_path / "m.json"), spark)
    assert np.allclose(back.params.scales, model.params.scales) and back.pattern == model.pattern
