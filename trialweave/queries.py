"""Registered queries over the general tables, each with the same thing in SQL where SQL can say it.

Recordings: E1 is a trial per user of ``events`` (channels value and k), E2 the user events
as stimuli (view) and responses (purchase), E3 a trial per order of ``lineitem``, E4 the
``embeddings`` with labels as participants, E5 the ``conversations``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave import sinks
from trialweave.functions import kernels
from trialweave.functions.distributions import FAMILIES, Gamma
from trialweave.functions.patterns import arbitrary, half_sine
from trialweave.operators import epoching, preprocess, reduction, results, signal
from trialweave.plans import crossval, event_model, simulate
from trialweave.plans.event_model import EventModel, Grouping, Params, TrialData
from trialweave.plans.search import CumulativeMethod, EliminativeMethod
from trialweave.schema import TRIAL, by_trial
from trialweave.sources import adapters, readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

PATTERN = half_sine(100.0)
W = PATTERN.template
#: Fixed parameters of the E-step queries: two events, two components (k, value).
B = [[0.4, -0.3], [-0.2, 0.5]]
SCALES = [10.0, 8.0, 12.0]

# -- SQL of the adapters

E1 = """e1 AS (SELECT user_id % 8 AS participant, user_id AS epoch, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS sample,
  CAST(user_id % 2 AS INTEGER) AS condition, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)"""
L1 = E1 + """,
l1 AS (SELECT participant, epoch, sample, 'value' AS channel, value FROM e1 UNION ALL SELECT participant, epoch, sample, 'k' AS channel, k AS value FROM e1)"""
E3 = """e3 AS (SELECT o_custkey % 16 AS participant, l_orderkey AS epoch, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS INTEGER) AS sample,
  o_orderpriority AS condition, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""
L3 = E3 + """,
l3 AS (SELECT participant, epoch, sample, condition, unnest(['quantity', 'price', 'discount', 'tax']) AS channel, unnest([quantity, price, discount, tax]) AS value FROM e3)"""
E4 = """e4 AS (SELECT label AS participant, vec_id AS epoch, CAST(unnest(range(64)) AS INTEGER) AS channel, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"""
Z1 = L1 + """,
z1 AS (SELECT participant, epoch, sample, channel, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS value FROM l1 WINDOW w AS (PARTITION BY participant, epoch, channel))"""


def _taps(v: str = "value") -> str:
    half = len(W) // 2
    terms = []
    for j, x in enumerate(W):
        k = j - half
        terms.append(f"{x!r} * {v if k == 0 else f'coalesce(lead({v}, {k}) OVER o, 0)' if k > 0 else f'coalesce(lag({v}, {-k}) OVER o, 0)'}")
    return " + ".join(terms)


X1 = Z1 + f""",
x1 AS (SELECT participant, epoch, sample, channel, {_taps()} AS value FROM z1 WINDOW o AS (PARTITION BY participant, epoch, channel ORDER BY sample)),
cc AS (SELECT participant, epoch, sample AS t, max(value) FILTER (channel = 'k') AS c0, max(value) FILTER (channel = 'value') AS c1 FROM x1 GROUP BY ALL),
dur AS (SELECT participant, epoch, count(*) AS T FROM cc GROUP BY ALL),
dmax AS (SELECT max(T) AS D FROM dur)"""


def _estep(p: str, b: list[list], scales: list, location: int, of: str = "") -> str:
    """CTEs of one E-step: {p}g gains, {p}f0.. forward, {p}b0.. backward, {p}p probabilities, {p}ll.

    ``of``: ending of the names of the trials' tables cc, dur and dmax."""
    out, n = [], len(b)
    for e in range(n):
        out.append(f"{p}g{e} AS (SELECT participant, epoch, t, exp({b[e][0]} * c0 - {b[e][0]} * {b[e][0]} / 2 + {b[e][1]} * c1 - {b[e][1]} * {b[e][1]} / 2) AS g FROM cc{of})")
    for s in range(n + 1):
        out.append(f"{p}r{s} AS (SELECT t, t * exp(-t / ({scales[s]})) AS p FROM (SELECT unnest(range(D)) AS t FROM dmax{of}))")
        value = f"CASE WHEN t < {location} THEN 1e-15 ELSE p / (SELECT sum(p) FROM {p}r{s}) END" if 0 < s < n and location else f"p / (SELECT sum(p) FROM {p}r{s})"
        out.append(f"{p}m{s} AS (SELECT t, {value} AS p FROM {p}r{s})")
    out.append(f"{p}f0 AS (SELECT participant, epoch, t, p * g AS f FROM {p}g0 JOIN {p}m0 USING (t))")
    for e in range(1, n):
        out.append(f"{p}f{e} AS (SELECT g.participant, g.epoch, g.t, any_value(g.g) * sum(a.f * m.p) AS f FROM {p}f{e - 1} a JOIN {p}g{e} g ON g.participant = a.participant AND g.epoch = a.epoch AND g.t >= a.t JOIN {p}m{e} m ON m.t = g.t - a.t GROUP BY ALL)")
    out.append(f"{p}b{n - 1} AS (SELECT c.participant, c.epoch, c.t, m.p AS b FROM cc{of} c JOIN dur{of} d USING (participant, epoch) JOIN {p}m{n} m ON m.t = d.T - 1 - c.t)")
    for e in range(n - 2, -1, -1):
        out.append(f"{p}b{e} AS (SELECT c.participant, c.epoch, c.t, sum(n.b * g.g * m.p) AS b FROM cc{of} c JOIN {p}b{e + 1} n ON n.participant = c.participant AND n.epoch = c.epoch AND n.t >= c.t JOIN {p}g{e + 1} g ON g.participant = n.participant AND g.epoch = n.epoch AND g.t = n.t JOIN {p}m{e + 1} m ON m.t = n.t - c.t GROUP BY ALL)")
    out.append(f"{p}j AS ({' UNION ALL '.join(f'SELECT participant, epoch, {e} AS event, t, greatest(f * b, 0) AS v FROM {p}f{e} JOIN {p}b{e} USING (participant, epoch, t)' for e in range(n))})")
    out.append(f"{p}p AS (SELECT participant, epoch, event, t, v / sum(v) OVER (PARTITION BY participant, epoch, event) AS p FROM {p}j)")
    out.append(f"{p}ll AS (SELECT participant, epoch, ln(sum(v)) AS ll FROM {p}j WHERE event = 0 GROUP BY ALL)")
    return ",\n".join(out)


def _mstep(q: str, p: str, n: int, of: str = "") -> str:
    """CTEs {q}b (event, c0, c1) and {q}s (stage, scale) from the probabilities of E-step ``p``."""
    return f"""{q}b AS (SELECT event, avg(x0) AS c0, avg(x1) AS c1 FROM (SELECT participant, epoch, event, sum(p * c0) AS x0, sum(p * c1) AS x1 FROM {p}p JOIN cc{of} USING (participant, epoch, t) GROUP BY ALL) GROUP BY event),
{q}a AS (SELECT event, avg(x) AS pos FROM (SELECT participant, epoch, event, sum(p * t) AS x FROM {p}p GROUP BY ALL) GROUP BY event UNION ALL SELECT {n}, avg(T) - 1 FROM dur{of}),
{q}s AS (SELECT event AS stage, (pos - coalesce(lag(pos) OVER (ORDER BY event), 0)) / 2 AS scale FROM {q}a)"""


def _some(name: str, where: str) -> str:
    """CTEs cc{name}, dur{name} and dmax{name} of some of the trials."""
    return f"""cc{name} AS (SELECT * FROM cc WHERE {where}), dur{name} AS (SELECT * FROM dur WHERE {where}), dmax{name} AS (SELECT max(T) AS D FROM dur{name})"""


F1 = X1 + ",\n" + _estep("x", B, SCALES, PATTERN.location)
F0 = X1 + ",\n" + _estep("x", B, SCALES, 0)
T0 = F0 + """,
tm AS (SELECT participant, epoch, event, CAST(arg_min(t, struct_pack(x := -p, y := t)) AS DOUBLE) AS time FROM xp GROUP BY ALL)"""


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; ``sql`` is the oracle."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def e1(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.user_trials(spark, sf)


def l1(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.long_form(e1(spark, sf), ["value", "k"])


def l3(spark: SparkSession, sf: str, condition: bool = False) -> DataFrame:
    return adapters.long_form(adapters.order_trials(spark, sf), ["quantity", "price", "discount", "tax"], [*TRIAL, "sample", *(["condition"] if condition else [])])


def l4(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("label").alias("participant"), F.col("vec_id").alias("epoch"), F.posexplode("embedding").alias("channel", "v")).select(*TRIAL, "channel", F.col("v").cast("double").alias("value"))


def data1(spark: SparkSession, sf: str, keep: bool = False, metadata: bool = False) -> TrialData:
    meta = e1(spark, sf).select(*TRIAL, "condition").distinct() if metadata else None
    return TrialData.from_samples(preprocess.zscore(by_trial(l1(spark, sf)), "trial"), PATTERN, meta, keep=keep)


def probs1(spark: SparkSession, sf: str, location: bool = False) -> DataFrame:
    model = EventModel(PATTERN, 2)
    model.params, model.grouping = Params(np.array([SCALES]), np.array([B])), Grouping.make(2)
    return model.transform(data1(spark, sf), location=location)


def long1(spark: SparkSession, sf: str) -> DataFrame:
    return event_model.exploded(probs1(spark, sf))


SIG = "participant, epoch, sample, channel, round(value, 6) + 0.0 AS value"


def signal_rows(df: DataFrame) -> DataFrame:
    return df.select(*TRIAL, "sample", "channel", r6("value").alias("value"))


# -- sources, sinks

_TABLES = ("documents", "labels")


@query("SELECT 'S0' AS participant, doc_id FROM documents UNION ALL SELECT 'S1', doc_id FROM labels")
def participant_names(spark, sf):
    return readers.read_participants(spark, [f"{sf}/{t}.parquet" for t in _TABLES], schema="doc_id long").select("participant", "doc_id")


@query("SELECT 'documents' AS participant, doc_id FROM documents UNION ALL SELECT 'labels', doc_id FROM labels")
def read_participants(spark, sf):
    return readers.read_participants(spark, [f"{sf}/{t}.parquet" for t in _TABLES], list(_TABLES), "doc_id long").select("participant", "doc_id")


@query("SELECT c_custkey, CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS INTEGER) AS code FROM customer")
def trigger_codes(spark, sf):
    return spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", readers.trigger_code("c_name").alias("code"))


_CODES = {"view": 1, "click": 2, "signup": 3, "purchase": 4, "error": 0}
_CODE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _CODES.items()) + " END"


@query(f"""WITH c AS (SELECT user_id AS participant, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample, {_CODE_SQL} AS code FROM events),
p AS (SELECT *, coalesce(lag(code) OVER (PARTITION BY participant ORDER BY sample), 0) AS prev FROM c)
SELECT participant, sample, prev, CASE WHEN prev > 0 THEN code - prev ELSE code END AS code FROM p WHERE code <> prev AND code > 0""")
def trigger_edges(spark, sf):
    return readers.detect_triggers(_triggers(spark, sf), block=20)


def _place(spark, name: str) -> str:
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/{name}-{uuid.uuid4().hex}"


@query("SELECT p AS participant, CAST(e AS BIGINT) AS epoch, CAST(s AS INTEGER) AS sample, c AS channel, CAST(((i * 3 + e) * 2 + j) * 5 + s AS DOUBLE) AS value FROM (SELECT unnest([0, 1]) AS i, unnest(['a', 'b']) AS p), (SELECT unnest(range(3)) AS e), (SELECT unnest([0, 1]) AS j, unnest(['x', 'y']) AS c), (SELECT unnest(range(5)) AS s) WHERE ((i * 3 + e) * 2 + j) * 5 + s <> 17")
def array_samples(spark, sf):
    data = np.arange(60.0).reshape(2, 3, 2, 5)
    data[data == 17] = np.nan
    return readers.from_array(spark, data, participants=["a", "b"], channels=["x", "y"])


@query(f"WITH {L1} SELECT CAST(participant AS VARCHAR) AS participant, epoch, sample, channel, round(value, 6) + 0.0 AS value FROM l1 WHERE value > 50")
def stored_samples(spark, sf):
    """Samples stored with gaps, and loaded without them."""
    gaps = l1(spark, sf).select(F.col("participant").cast("string").alias("participant"), "epoch", F.col("sample").cast("int").alias("sample"), "channel", F.when(F.col("value") > 50, F.col("value")).alias("value"))
    path = _place(spark, "samples")
    sinks.write_samples(gaps, path)
    return signal_rows(readers.load_samples(spark, path))


@query(f"WITH {L1}, t AS (SELECT DISTINCT CAST(participant AS VARCHAR) AS participant, epoch, (epoch % 40 + 10) / 100.0 AS rt FROM l1 WHERE epoch % 3 <> 0) SELECT t.participant, t.epoch, sample, channel, round(value, 6) + 0.0 AS value FROM t JOIN l1 ON l1.epoch = t.epoch AND CAST(l1.participant AS VARCHAR) = t.participant WHERE sample < t.epoch % 40 + 10 + 3")
def stored_epochs(spark, sf):
    """Epochs stored with the estimates' writer, read with response times of their own."""
    samples = l1(spark, sf).select(F.col("participant").cast("string").alias("participant"), "epoch", F.col("sample").cast("int").alias("sample"), "channel", "value")
    path = _place(spark, "epochs")
    sinks.write_table(samples, path)
    meta = samples.select(*TRIAL).distinct().where("epoch % 3 <> 0").withColumn("ms", (F.col("epoch") % 40 + 10) * 10.0)
    return signal_rows(readers.read_epochs(spark, path, metadata=meta, rt_col="ms", scale=1000.0, sfreq=100.0, offset_after_resp=0.03)[0])


@query("SELECT conv_id AS participant, turn AS sample, role AS channel, CAST(length(text) AS DOUBLE) AS value FROM conversations")
def conversation_samples(spark, sf):
    return spark.read.parquet(f"{sf}/conversations.parquet").select(F.col("conv_id").alias("participant"), F.col("turn").alias("sample"), F.col("role").alias("channel"), F.length("text").cast("double").alias("value"))


# -- epoching

_ASOF = """mk AS (SELECT user_id AS participant, event_id AS epoch, epoch_us(ts) / 1e6 AS sec, event_type AS label FROM events),
nx AS (SELECT *, min(CASE WHEN label = 'purchase' THEN sec END) OVER (PARTITION BY participant ORDER BY sec, epoch ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM mk),
rt AS (SELECT participant, epoch, CASE WHEN n - sec BETWEEN 0 AND 604800 THEN (n - sec) / 3600 END AS rt FROM nx WHERE label = 'view')"""


def _paired(spark, sf):
    marks = adapters.triggers(spark, sf)
    return epoching.scale_rt(epoching.first_response(marks, F.col("label") == "view", F.col("label") == "purchase", tmin=0, tmax=7 * 86400), 3600)


@query(f"WITH {_ASOF} SELECT participant, epoch, round(rt, 6) + 0.0 AS rt FROM rt")
def stim_resp_asof(spark, sf):
    return _paired(spark, sf).select(*TRIAL, r6("rt").alias("rt"))


@query(f"WITH {_ASOF} SELECT participant, epoch, round(rt, 6) + 0.0 AS rt, CAST(round_even(rt, 0) AS INTEGER) AS rt_samples FROM rt WHERE rt BETWEEN 1 AND 100 AND round_even(rt, 0) > 0")
def rt_trim(spark, sf):
    return epoching.trim_rt(_paired(spark, sf), 1.0, lower=1, upper=100).select(*TRIAL, r6("rt").alias("rt"), "rt_samples")


@query(f"""WITH {L1}, raw AS (SELECT epoch AS participant, sample, channel, value FROM l1),
on_ AS (SELECT user_id AS participant, event_id AS epoch, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS onset, event_type FROM events)
SELECT o.participant, o.epoch, CAST(r.sample - onset AS INTEGER) AS sample, channel, round(value, 6) + 0.0 AS value FROM on_ o JOIN raw r ON r.participant = o.participant AND r.sample BETWEEN onset - 2 AND onset + 5 WHERE event_type = 'view'""")
def epoch_window(spark, sf):
    raw = l1(spark, sf).select(F.col("epoch").alias("participant"), "sample", "channel", "value")
    onsets = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("participant"), F.col("event_id").alias("epoch"), (F.expr("row_number() over (partition by user_id order by ts, event_id)") - 1).alias("onset"), "event_type").where("event_type = 'view'")
    return signal_rows(epoching.cut_windows(raw, onsets, -2, 5))


@query(f"WITH {L1}, t AS (SELECT DISTINCT participant, epoch, CAST(round_even((epoch % 50 + 10.5), 0) AS INTEGER) AS n FROM l1) SELECT participant, epoch, CAST(sample - 3 AS INTEGER) AS sample, channel, round(value, 6) + 0.0 AS value FROM l1 JOIN t USING (participant, epoch) WHERE sample >= 3 AND sample < 3 + n + 2")
def epoch_crop(spark, sf):
    s = l1(spark, sf)
    trials = epoching.trim_rt(s.select(*TRIAL).distinct().withColumn("rt", F.col("epoch") % 50 + 10.5), 1.0)
    return signal_rows(epoching.crop(s, trials, offset=2, start=3))


@query(f"WITH {L1}, ok AS (SELECT participant, epoch FROM l1 GROUP BY ALL HAVING bool_and(abs(value) < 280)) SELECT {SIG} FROM l1 SEMI JOIN ok USING (participant, epoch)")
def amplitude_reject(spark, sf):
    return signal_rows(epoching.reject(l1(spark, sf), 280.0))


@query(f"WITH {L1}, h AS (SELECT participant, epoch, sample, channel, CASE WHEN epoch % 3 <> 0 AND sample % 2 = 0 THEN value END AS value FROM l1), ok AS (SELECT participant, epoch FROM h GROUP BY ALL HAVING count(value) > 0) SELECT {SIG} FROM h SEMI JOIN ok USING (participant, epoch)")
def empty_trials(spark, sf):
    """Trials without a value go; gaps inside the others stay."""
    gaps = l1(spark, sf).withColumn("value", F.when((F.col("epoch") % 3 != 0) & (F.col("sample") % 2 == 0), F.col("value")))
    return signal_rows(epoching.drop_empty(gaps))


@query(f"WITH {L3} SELECT participant, epoch, sample, channel, round(value - avg(value) OVER (PARTITION BY participant, epoch, sample), 6) + 0.0 AS value FROM l3")
def rereference(spark, sf):
    return signal_rows(epoching.average_reference(l3(spark, sf)))


@query(f"WITH {L1} SELECT participant, epoch, sample, channel, round(value - avg(value) FILTER (sample <= 4) OVER (PARTITION BY participant, epoch, channel), 6) + 0.0 AS value FROM l1")
def baseline(spark, sf):
    return signal_rows(epoching.baseline_correct(l1(spark, sf), None, 4))


@query(f"WITH {L1} SELECT participant, epoch, CAST(sample // 3 AS INTEGER) AS sample, channel, round(value, 6) + 0.0 AS value FROM l1 WHERE sample % 3 = 0")
def decimate(spark, sf):
    return signal_rows(epoching.decimate(l1(spark, sf), 3))


@query(f"WITH {L3} SELECT participant, epoch, sample, channel, round(value, 6) + 0.0 AS value FROM l3 WHERE channel IN ('price', 'tax')")
def pick_channels(spark, sf):
    return signal_rows(epoching.pick_channels(l3(spark, sf), ["price", "tax"]))


@query(f"WITH {L1} SELECT {SIG} FROM l1 WHERE participant IN (1, 3)")
def participant_selection(spark, sf):
    return signal_rows(epoching.select_participants(l1(spark, sf), [1, 3]))


@query(f"WITH {L1} SELECT {SIG} FROM l1 WHERE participant <> 5")
def loo_exclude(spark, sf):
    return signal_rows(epoching.exclude_participants(l1(spark, sf), 5))


@query(f"WITH {L3} SELECT {SIG} FROM l3 WHERE condition = '1-URGENT'")
def condition_equal(spark, sf):
    return signal_rows(epoching.select_condition(l3(spark, sf, True), "1-URGENT", "condition"))


@query(f"WITH {L3} SELECT {SIG} FROM l3 WHERE regexp_matches(condition, '^[23]-|LOW')")
def condition_contains(spark, sf):
    return signal_rows(epoching.select_condition(l3(spark, sf, True), "^[23]-|LOW", "condition", "contains"))


_RAW = f"""{L1}, raw AS (SELECT epoch AS participant, sample, channel, value - avg(value) OVER (PARTITION BY epoch, sample) AS value FROM l1),
tg AS (SELECT user_id AS participant, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample, {_CODE_SQL} AS code FROM events),
mk AS (SELECT participant, sample, code, row_number() OVER (PARTITION BY participant ORDER BY sample, code) - 1 AS epoch FROM tg WHERE code IN (1, 4)),
nx AS (SELECT *, min(CASE WHEN code = 4 THEN sample END) OVER (PARTITION BY participant ORDER BY sample ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - sample AS rt FROM mk),
st AS (SELECT participant, epoch, sample AS onset, CAST(CASE WHEN rt BETWEEN -2 AND 9 THEN rt END AS DOUBLE) AS rt FROM nx WHERE code = 1)"""
_READ = _RAW + """,
ok AS (SELECT * FROM st WHERE NOT EXISTS (SELECT 1 FROM tg WHERE tg.code = 3 AND tg.participant = st.participant AND tg.sample BETWEEN st.onset - 2 AND st.onset + 9)),
ct AS (SELECT o.participant, o.epoch, r.sample - onset AS sample, channel, value, rt FROM ok o JOIN raw r ON r.participant = o.participant AND r.sample BETWEEN onset - 2 AND onset + 9),
bs AS (SELECT participant, epoch, sample, channel, rt, value - avg(value) FILTER (sample <= 0) OVER (PARTITION BY participant, epoch, channel) AS value FROM ct),
cr AS (SELECT * FROM bs WHERE rt >= 1 AND rt <= 6 AND sample >= 0 AND sample < rt + 2)"""


def _triggers(spark, sf) -> DataFrame:
    code = F.create_map(*(x for k, v in _CODES.items() for x in (F.lit(k), F.lit(v))))
    return spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("participant"), (F.expr("row_number() over (partition by user_id order by ts, event_id)") - 1).cast("long").alias("sample"), F.element_at(code, F.col("event_type")).alias("code"))


def _read(spark, sf, **options) -> tuple[DataFrame, DataFrame]:
    raw = l1(spark, sf).select(F.col("epoch").alias("participant"), "sample", "channel", "value")
    return readers.read_raw_and_epoch(raw, _triggers(spark, sf), {"view": 1}, {"response/purchase": 4}, sfreq=1.0, tmin=-2.0, tmax=9.0, reference="average", **options)


@query(f"WITH {_READ} SELECT {SIG} FROM cr SEMI JOIN (SELECT participant, epoch FROM cr GROUP BY ALL HAVING bool_and(abs(value) < 60)) USING (participant, epoch)")
def reading_chain(spark, sf):
    bad = _triggers(spark, sf).where("code = 3").select("participant", F.col("sample").alias("start"), F.col("sample").alias("stop"))
    return signal_rows(_read(spark, sf, bad=bad, offset_after_resp=2.0, lower_limit_rt=1.0, upper_limit_rt=6.0, reject_threshold=60.0)[0])


@query(f"WITH {_READ} SELECT DISTINCT participant, epoch, 'view' AS event_name, rt, CAST(rt AS INTEGER) AS rt_samples FROM cr")
def reading_trials(spark, sf):
    bad = _triggers(spark, sf).where("code = 3").select("participant", F.col("sample").alias("start"), F.col("sample").alias("stop"))
    trials = _read(spark, sf, bad=bad, offset_after_resp=2.0, lower_limit_rt=1.0, upper_limit_rt=6.0)[1]
    return trials.select(*TRIAL, "event_name", "rt", "rt_samples")


@query(f"WITH {_RAW} SELECT o.participant, o.epoch, CAST(r.sample - onset AS INTEGER) AS sample, channel, round(value, 6) + 0.0 AS value FROM st o JOIN raw r ON r.participant = o.participant AND r.sample BETWEEN onset - 2 AND onset + 9")
def reading_without_rt(spark, sf):
    return signal_rows(_read(spark, sf, baseline=None, ignore_rt=True)[0])


@query(f"WITH {_RAW}, md AS (SELECT participant, epoch, (epoch % 5 + 2) * 1000.0 AS ms FROM st WHERE epoch % 3 <> 0) SELECT participant, epoch, ms / 1000 AS rt, CAST(ms / 1000 AS INTEGER) AS rt_samples FROM md")
def reading_with_metadata(spark, sf):
    meta = _read(spark, sf, ignore_rt=True)[1].where("epoch % 3 <> 0").select(*TRIAL, ((F.col("epoch") % 5 + 2) * 1000.0).alias("ms"))
    return _read(spark, sf, metadata=meta, rt_col="ms", scale=1000.0)[1].select(*TRIAL, "rt", "rt_samples")


@query(f"WITH {L1}, b AS (SELECT user_id % 8 AS participant, CAST(event_id AS DOUBLE) AS start, CAST(event_id + 3 AS DOUBLE) AS stop FROM events WHERE event_type = 'error'), o AS (SELECT user_id % 8 AS participant, event_id AS epoch, event_id AS onset FROM events WHERE event_type = 'view') SELECT participant, epoch, onset FROM o ANTI JOIN b ON b.participant = o.participant AND b.start <= o.onset + 5 AND b.stop >= o.onset - 2")
def annotation_reject(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet").withColumn("participant", F.col("user_id") % 8)
    bad = ev.where("event_type = 'error'").select("participant", F.col("event_id").alias("start"), (F.col("event_id") + 3).alias("stop"))
    onsets = ev.where("event_type = 'view'").select("participant", F.col("event_id").alias("epoch"), F.col("event_id").alias("onset"))
    return epoching.reject_annotated(onsets, bad, -2, 5)


@query("SELECT user_id AS participant, CAST(event_id // 3 AS BIGINT) AS sample, min(length(event_type)) AS code FROM events GROUP BY ALL")
def repeated_triggers(spark, sf):
    marks = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("participant"), F.floor(F.col("event_id") / 3).alias("sample"), F.length("event_type").cast("long").alias("code"))
    return epoching.drop_repeated(marks)


@query(f"WITH {L1} SELECT participant, epoch, sample, channel, round((sample - 3) / 100.0, 6) + 0.0 AS time FROM l1")
def time_axis(spark, sf):
    return readers.time_axis(l1(spark, sf), 100.0, 3).select(*TRIAL, "sample", "channel", r6("time").alias("time"))


# -- preprocessing

@query(f"WITH {L3}, h AS (SELECT participant, epoch, sample, channel, CASE WHEN value > 0.05 THEN value END AS value FROM l3) SELECT {SIG} FROM h WHERE value IS NOT NULL")
def stack_dropna(spark, sf):
    return signal_rows(preprocess.drop_incomplete(l3(spark, sf).withColumn("value", F.when(F.col("value") > 0.05, F.col("value")))))


@query(f"WITH {L3} SELECT participant, epoch, sample, round(max(value) FILTER (channel = 'price'), 6) + 0.0 AS price, round(max(value) FILTER (channel = 'tax'), 6) + 0.0 AS tax FROM l3 GROUP BY ALL")
def unstack_pivot(spark, sf):
    return preprocess.unstacked(l3(spark, sf), ["price", "tax"]).select(*TRIAL, "sample", r6("price").alias("price"), r6("tax").alias("tax"))


# Means of values with two decimals over 2^k rows end in a 5 after few decimals: nine are past it.
@query(f"WITH {L1} SELECT participant, epoch, sample, channel, round(value - avg(value) OVER (PARTITION BY participant, epoch, channel), 9) + 0.0 AS value FROM l1")
def center(spark, sf):
    return preprocess.center(l1(spark, sf)).select(*TRIAL, "sample", "channel", (F.round("value", 9) + 0.0).alias("value"))


@query(f"WITH {L1}, s AS (SELECT participant, stddev_pop(value) AS sd FROM l1 GROUP BY ALL) SELECT participant, epoch, sample, channel, round(value / sd * (SELECT avg(sd) FROM s), 6) + 0.0 AS value FROM l1 JOIN s USING (participant)")
def standardize(spark, sf):
    return signal_rows(preprocess.standardize(l1(spark, sf)))


def _register_zscores() -> None:
    for mode, keys in (("all", []), ("participant", ["participant"]), ("trial", ["participant", "epoch"])):
        for across in (False, True):
            parts = keys if across else [*keys, "channel"]
            over = f"OVER ({'PARTITION BY ' + ', '.join(parts) if parts else ''})"
            sql = f"WITH {L1} SELECT participant, epoch, sample, channel, round((value - avg(value) {over}) / stddev_pop(value) {over}, 6) + 0.0 AS value FROM l1"

            def run(spark, sf, mode=mode, across=across):
                return signal_rows(preprocess.zscore(l1(spark, sf), mode, across))

            run.__name__ = f"zscore_{mode}{'_across' if across else ''}"
            query(sql)(run)


_register_zscores()


@query(f"WITH {L3}, h AS (SELECT participant, channel, CASE WHEN channel <> 'tax' OR participant % 5 <> 0 THEN value END AS value FROM l3) SELECT participant, channel FROM h GROUP BY ALL HAVING count(value) = 0")
def empty_channel_check(spark, sf):
    some = l3(spark, sf).withColumn("value", F.when((F.col("channel") != "tax") | (F.col("participant") % 5 != 0), F.col("value")))
    return preprocess.empty_channels(some)


@query("""WITH t AS (SELECT CAST(unnest(range(5)) AS INTEGER) AS k), s AS (SELECT k, sin(2 * pi() * (k * 10.0 + 5.0) / 1000 * 10.0) AS v FROM t)
SELECT k, round(v / (SELECT sum(v * v) FROM s), 9) + 0.0 AS w FROM s""")
def template_halfsine(spark, sf):
    return spark.createDataFrame([(i, round(w, 9) + 0.0) for i, w in enumerate(half_sine(100.0).template)], "k int, w double")


@query(f"WITH {L3} SELECT participant, epoch, sample, CAST(CAST(dense_rank() OVER (ORDER BY channel) - 1 AS INTEGER) AS VARCHAR) AS channel, round(value, 6) + 0.0 AS value FROM l3")
def no_analysis(spark, sf):
    return signal_rows(preprocess.channels_as_components(l3(spark, sf)))


_STANDARD = f"""{L1}, sd AS (SELECT participant, stddev_pop(value) AS sd FROM l1 GROUP BY ALL),
sc AS (SELECT participant, epoch, sample, channel, value / sd * (SELECT avg(sd) FROM sd) AS value FROM l1 JOIN sd USING (participant)),
ce AS (SELECT participant, epoch, sample, channel, value - avg(value) OVER (PARTITION BY participant, epoch, channel) AS value FROM sc)"""


@query(f"WITH {_STANDARD} SELECT participant, epoch, sample, CASE channel WHEN 'k' THEN '0' ELSE '1' END AS channel, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) + 0.0 AS value FROM ce WINDOW w AS (PARTITION BY participant, channel)")
def preprocess_standard(spark, sf):
    return signal_rows(preprocess.preprocess(l1(spark, sf), method=None, apply_standard=True, apply_zscore="participant").samples)


@query(f"WITH {L1} SELECT participant, epoch, sample, channel, round(0.5 * coalesce(lag(value, 1) OVER o, 0) - value + 2 * coalesce(lead(value, 1) OVER o, 0), 6) + 0.0 AS value FROM l1 WINDOW o AS (PARTITION BY participant, epoch, channel ORDER BY sample)")
def cross_correlation_arbitrary(spark, sf):
    return signal_rows(preprocess.cross_correlate(l1(spark, sf), arbitrary(100.0, [0.5, -1.0, 2.0]).template))


@query(f"""WITH {L1}, c AS (SELECT participant, epoch, a.channel AS a, b.channel AS b, covar_samp(a.value, b.value) AS cov FROM l1 a JOIN l1 b USING (participant, epoch, sample) GROUP BY ALL),
p AS (SELECT participant, a, b, avg(cov) AS cov FROM c GROUP BY ALL), m AS (SELECT a, b, avg(cov) AS cov FROM p GROUP BY ALL),
d AS (SELECT b AS channel, max(cov) FILTER (a = 'k') - max(cov) FILTER (a = 'value') AS d FROM m GROUP BY ALL),
n AS (SELECT sqrt(sum(d * d)) * sign(arg_max(d, abs(d))) AS n FROM d)
SELECT channel, '0' AS component, round(d / n, 6) + 0.0 AS w FROM d, n""")
def pca_two_channels(spark, sf):
    """Rows of a two-channel covariance, centred, span one direction: their difference."""
    return reduction.pca(preprocess.center(l1(spark, sf)), 1)[0].select("channel", "component", r6("w").alias("w"))


@query("SELECT unnest(['0', '1']) AS component, unnest([1.0, 0.0]::DOUBLE[]) AS ratio, unnest([1.0, 1.0]::DOUBLE[]) AS cumulative")
def explained_variance(spark, sf):
    """The first component of two channels explains all of a covariance whose rows are centred."""
    out = reduction.explained(spark, reduction.pca(preprocess.center(l1(spark, sf)), None)[1])
    return out.select("component", r6("ratio").alias("ratio"), r6("cumulative").alias("cumulative"))


@query(f"WITH {L1} SELECT 'u' || participant AS participant, epoch, sample, channel, round(value, 6) + 0.0 AS value FROM l1")
def bids_samples(spark, sf):
    """A folder per participant, read in one scan."""
    path = _place(spark, "bids")
    s = l1(spark, sf).select(*TRIAL, F.col("sample").cast("int").alias("sample"), "channel", "value")
    s.repartition("participant").withColumn("sub-u", F.col("participant")).write.partitionBy("sub-u").parquet(path)
    return signal_rows(readers.read_bids(spark, path, pattern="sub-u=*", schema="epoch long, sample int, channel string, value double").withColumn("participant", F.regexp_replace("participant", "=", "")))


@query(f"""WITH {L1}, c AS (SELECT participant, epoch, a.channel AS a, b.channel AS b, covar_samp(a.value, b.value) AS cov FROM l1 a JOIN l1 b USING (participant, epoch, sample) GROUP BY ALL),
p AS (SELECT participant, a, b, avg(cov) AS cov FROM c GROUP BY ALL), m AS (SELECT a, b, avg(cov) AS cov FROM p GROUP BY ALL),
d AS (SELECT b AS channel, max(cov) FILTER (a = 'k') - max(cov) FILTER (a = 'value') AS d FROM m GROUP BY ALL),
n AS (SELECT sqrt(sum(d * d)) * sign(arg_max(d, abs(d))) AS n FROM d),
ce AS (SELECT *, value - avg(value) OVER (PARTITION BY participant, epoch, channel) AS x FROM l1)
SELECT participant, epoch, sample, '0' AS channel, round(sum(x * d / n), 6) + 0.0 AS value FROM ce JOIN d USING (channel), n GROUP BY ALL""")
def pca_scores(spark, sf):
    return signal_rows(preprocess.preprocess(l1(spark, sf), method="pca", n_comp=1, apply_zscore=None).samples)


@query("SELECT * FROM (VALUES (1, 'Stimulus', 'left'), (12, 'Response', 'hand')) t(code, kind, label)")
def trigger_levels(spark, sf):
    path = _place(spark, "levels")
    text = '{"value": {"Levels": {"stim/1": "Stimulus - left", "resp12": "Response - hand", "x": "Stimulus - no number", "y3": "Pause"}}}'
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return readers.trigger_levels(spark, path)


_FIR = """h AS (SELECT k, 0.675 * CASE WHEN k = 0 THEN 1 ELSE sin(pi() * 0.675 * k) / (pi() * 0.675 * k) END * (0.54 + 0.46 * cos(2 * pi() * k / 44)) AS h FROM (SELECT unnest(range(-22, 23)) AS k)),
taps AS (SELECT k, h / (SELECT sum(h) FROM h) AS h FROM h),
len AS (SELECT participant, epoch, channel, max(sample) AS z, arg_min(value, sample) AS x0, arg_max(value, sample) AS xz FROM l1 GROUP BY ALL),
spot AS (SELECT l.participant, l.epoch, l.channel, i, k, h, i - k AS j, z, x0, xz FROM (SELECT *, unnest(range(0, z + 1)) AS i FROM len) l, taps),
fl AS (SELECT a.participant, a.epoch, CAST(a.i AS INTEGER) AS sample, a.channel, sum(h * CASE WHEN j < 0 THEN 2 * x0 - v.value WHEN j > z THEN 2 * xz - v.value ELSE v.value END) AS value
  FROM spot a JOIN l1 v ON v.participant = a.participant AND v.epoch = a.epoch AND v.channel = a.channel AND v.sample = CASE WHEN j < 0 THEN -j WHEN j > z THEN 2 * z - j ELSE j END GROUP BY ALL)"""


@query(f"WITH {L1}, {_FIR} SELECT {SIG} FROM fl")
def filter_low_pass(spark, sf):
    return signal_rows(signal.filter_trials(l1(spark, sf), 100.0, None, 30.0))


@query(f"WITH {L1}, {_FIR} SELECT epoch AS participant, sample, channel, round(value, 6) + 0.0 AS value FROM fl")
def filter_raw_low_pass(spark, sf):
    raw = l1(spark, sf).select(F.col("epoch").alias("participant"), F.col("sample").cast("long").alias("sample"), "channel", "value")
    return signal.filter_raw(raw, 100.0, None, 30.0, block=1).select("participant", F.col("sample").cast("int").alias("sample"), "channel", r6("value").alias("value"))


@query(f"""WITH {L1}, n AS (SELECT participant, epoch, channel, count(*) AS n, greatest(1, CAST(round_even(count(*) / 2.0, 0) AS BIGINT)) AS m FROM l1 GROUP BY ALL),
y AS (SELECT *, unnest(range(0, m)) AS j FROM n), k AS (SELECT *, unnest(range(0, m // 2 + 1)) AS k FROM y)
SELECT k.participant, k.epoch, CAST(j AS INTEGER) AS sample, k.channel, round(sum(value * CASE WHEN k = 0 OR (m % 2 = 0 AND 2 * k = m) THEN 1 ELSE 2 END * cos(2 * pi() * k * (j * 1.0 / m - sample * 1.0 / n))) / any_value(n), 6) + 0.0 AS value
FROM k JOIN l1 x ON x.participant = k.participant AND x.epoch = k.epoch AND x.channel = k.channel GROUP BY ALL""")
def resample(spark, sf):
    return signal_rows(signal.resample_trials(l1(spark, sf), 100.0, 50.0))


@query(f"WITH {X1} SELECT {SIG} FROM x1")
def cross_correlation(spark, sf):
    return signal_rows(preprocess.cross_correlate(preprocess.zscore(l1(spark, sf), "trial"), W))


@query(f"WITH {L1} SELECT participant, epoch, a.channel AS a, b.channel AS b, round(covar_samp(a.value, b.value), 6) + 0.0 AS cov FROM l1 a JOIN l1 b USING (participant, epoch, sample) WHERE a.channel <= b.channel GROUP BY ALL")
def trial_covariance(spark, sf):
    return reduction.trial_covariance(l1(spark, sf)).select(*TRIAL, "a", "b", r6("cov").alias("cov"))


@query(f"""WITH {L1}, c AS (SELECT participant, epoch, a.channel AS a, b.channel AS b, covar_samp(a.value, b.value) AS cov FROM l1 a JOIN l1 b USING (participant, epoch, sample) WHERE a.channel <= b.channel GROUP BY ALL),
p AS (SELECT participant, a, b, avg(cov) AS cov FROM c GROUP BY ALL) SELECT a, b, round(avg(cov), 6) + 0.0 AS cov FROM p GROUP BY ALL""")
def mean_covariance(spark, sf):
    return reduction.mean_covariance(l1(spark, sf)).select("a", "b", r6("cov").alias("cov"))


@query(f"WITH {E4}, w AS (SELECT channel, c AS component, cos(channel * (c + 1) / 10.0) AS w FROM (SELECT CAST(unnest(range(64)) AS INTEGER) AS channel), (SELECT CAST(unnest(range(3)) AS INTEGER) AS c)) SELECT participant, epoch, component, round(sum(value * w), 6) + 0.0 AS value FROM e4 JOIN w USING (channel) GROUP BY ALL")
def projection(spark, sf):
    w = spark.range(64).select(F.col("id").cast("int").alias("channel"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("component")).withColumn("w", F.cos(F.col("channel") * (F.col("component") + 1) / 10.0))
    out = preprocess.project(l4(spark, sf).withColumn("sample", F.lit(0)), w)
    return out.select(*TRIAL, F.col("channel").alias("component"), r6("value").alias("value"))


# -- model

def _register_pmfs() -> None:
    shapes = {"gamma": (2.0, 9.0), "lognorm": (0.5, 20.0), "wald": (2.0, 7.0), "weibull": (2.0, 15.0)}
    density = {
        "gamma": "t * exp(-t / 9.0)",
        "lognorm": "CASE WHEN t > 0 THEN exp(-pow(ln(t / 20.0), 2) / (2 * 0.25)) / t ELSE 0 END",
        "wald": "CASE WHEN t > 0 THEN pow(t / 7.0, -1.5) * exp(-pow(t / 7.0 - 2.0, 2) / (2 * (t / 7.0) * 4.0)) ELSE 0 END",
        "weibull": "(t / 15.0) * exp(-pow(t / 15.0, 2))",
    }
    for name, (shape, scale) in shapes.items():
        sql = f"WITH {E1}, d AS (SELECT max(n) AS n FROM (SELECT count(*) AS n FROM e1 GROUP BY epoch)), t AS (SELECT CAST(unnest(range(n)) AS INTEGER) AS t FROM d), r AS (SELECT t, {density[name]} AS v FROM t) SELECT t, round(v / sum(v) OVER (), 9) + 0.0 AS p FROM r"

        def run(spark, sf, name=name, shape=shape, scale=scale):
            longest = data1(spark, sf).durations().agg(F.max("duration")).first()[0]
            pmf = kernels.stage_pmfs(FAMILIES[name](shape), np.array([scale]), longest, 0)[0]
            return spark.createDataFrame([(t, round(float(p), 9) + 0.0) for t, p in enumerate(pmf)], "t int, p double")

        run.__name__ = f"pmf_{name}"
        query(sql)(run)


_register_pmfs()


@query(f"WITH {E1} SELECT participant, epoch, CAST(count(*) AS INTEGER) AS duration FROM e1 GROUP BY ALL")
def trial_durations(spark, sf):
    return data1(spark, sf).durations()


@query(f"WITH {E3} SELECT participant, epoch, CAST(count(*) AS INTEGER) AS duration FROM e3 GROUP BY ALL")
def trial_durations_orders(spark, sf):
    return TrialData.from_samples(l3(spark, sf), PATTERN, keep=False).durations()


@query(f"WITH {E1}, d AS (SELECT participant, epoch, count(*) AS duration FROM e1 GROUP BY ALL), c AS (SELECT *, CAST(sum(duration) OVER (ORDER BY participant, epoch) - 1 AS BIGINT) AS \"end\" FROM d) SELECT participant, epoch, duration, \"end\", \"end\" - duration + 1 AS start FROM c")
def trial_offsets(spark, sf):
    return data1(spark, sf).offsets().select(*TRIAL, F.col("duration").cast("long").alias("duration"), "end", "start")


@query(f"WITH {E1} SELECT count(DISTINCT (participant, epoch)) AS trials, count(*) AS samples FROM e1")
def dataset_size(spark, sf):
    return spark.createDataFrame([data1(spark, sf).sizes()], "trials long, samples long")


@query(f"WITH {E1}, d AS (SELECT count(*) AS n FROM e1 GROUP BY participant, epoch) SELECT CAST(floor(quantile_cont(n, 0.1) / 5) AS INTEGER) AS max_events FROM d")
def max_events(spark, sf):
    return spark.createDataFrame([(data1(spark, sf).max_events(),)], "max_events int")


@query(f"WITH {F0} SELECT participant, epoch, t AS sample, 0 AS event, round(g, 6) + 0.0 AS gain FROM xg0 UNION ALL SELECT participant, epoch, t, 1, round(g, 6) + 0.0 FROM xg1")
def gains(spark, sf):
    return event_model.gains(data1(spark, sf).frame, np.array(B)).select(*TRIAL, "sample", "event", r6("gain").alias("gain"))


@query(f'WITH {F0} SELECT participant, epoch, round(ll, 6) + 0.0 AS loglik FROM xll')
def estep_loglik(spark, sf):
    return probs1(spark, sf).select(*TRIAL, r6("loglik").alias("loglik"))


@query(f'WITH {F1} SELECT CAST(0 AS INTEGER) AS grp, round(sum(ll), 5) + 0.0 AS loglik, count(*) AS trials FROM xll')
def group_loglik_censored(spark, sf):
    return probs1(spark, sf, location=True).groupBy("grp").agg((F.round(F.sum("loglik"), 5) + 0.0).alias("loglik"), F.count("*").alias("trials"))


def _given_model(n: int) -> EventModel:
    """The fixed parameters' first ``n`` events."""
    model = EventModel(PATTERN, n)
    model.params, model.grouping = Params(np.array([[*SCALES[:n], SCALES[2]]]), np.array([B[:n]])), Grouping.make(n)
    return model


@query(f"WITH {F0},\n{_estep('o', B[:1], [SCALES[0], SCALES[2]], 0)} SELECT participant, epoch, CAST(1 AS INTEGER) AS n_events, round(ll, 6) + 0.0 AS loglik FROM oll UNION ALL SELECT participant, epoch, 2, round(ll, 6) + 0.0 FROM xll")
def stacked_submodels(spark, sf):
    found = EliminativeMethod(PATTERN, submodels={n: _given_model(n) for n in (2, 1)})
    return found.transform(data1(spark, sf)).select(*TRIAL, "n_events", r6("loglik").alias("loglik"))


@query(f"WITH {F0} SELECT participant, epoch, round(ll, 6) + 0.0 AS loglik FROM xll")
def cumulative_transform(spark, sf):
    return CumulativeMethod(PATTERN, model=_given_model(2)).transform(data1(spark, sf)).select(*TRIAL, r6("loglik").alias("loglik"))


@query(f"SELECT CAST(0 AS INTEGER) AS grp, CAST(e AS INTEGER) AS event, CAST(c AS INTEGER) AS component, CAST(v AS DOUBLE) AS value FROM (VALUES {', '.join(f'({e}, {c}, {v})' for e, row in enumerate(B) for c, v in enumerate(row))}) t(e, c, v)")
def stored_model(spark, sf):
    path = _place(spark, "model")
    sinks.write_model(_given_model(2), path, spark)
    return sinks.read_model(path, spark).channel_pars(spark)


_PROBS = f"WITH {F0} SELECT participant, epoch, CAST(event AS INTEGER) AS event, CAST(t AS INTEGER) AS sample, round(p, 6) + 0.0 AS prob FROM xp"


@query(_PROBS)
def estep_eventprobs(spark, sf):
    return long1(spark, sf).select(*TRIAL, "event", "sample", r6("prob").alias("prob"))


@query(f"WITH {F1},\n{_mstep('q', 'x', 2)} SELECT CAST(event AS INTEGER) AS event, CAST(c AS INTEGER) AS component, round(v, 6) + 0.0 AS value FROM (SELECT event, 0 AS c, c0 AS v FROM qb UNION ALL SELECT event, 1, c1 FROM qb)")
def mstep_channel(spark, sf):
    return _after_m_step(spark, sf)[0]


@query(f"WITH {F1},\n{_mstep('q', 'x', 2)} SELECT CAST(stage AS INTEGER) AS stage, round(scale, 6) + 0.0 AS scale FROM qs")
def mstep_time(spark, sf):
    return _after_m_step(spark, sf)[1]


def _one_em(spark, sf, iterations: int) -> EventModel:
    model = EventModel(PATTERN, 2, max_iteration=iterations, tolerance=-1e9)
    data = data1(spark, sf, keep=True)
    try:
        return model.fit(data, candidates=[Params(np.array([SCALES]), np.array([B]))])
    finally:
        data.frame.unpersist()


def _after_m_step(spark, sf) -> tuple[DataFrame, DataFrame]:
    model = _one_em(spark, sf, 1)
    return model.channel_pars(spark).select("event", "component", r6("value").alias("value")), model.time_pars(spark).select("stage", r6("scale").alias("scale"))


def _em_sql(iterations: int) -> str:
    parts = [X1, _estep("i0", B, SCALES, PATTERN.location)]
    for i in range(iterations):
        parts.append(_mstep(f"q{i}", f"i{i}", 2))
        b = [[f"(SELECT c{c} FROM q{i}b WHERE event = {e})" for c in range(2)] for e in range(2)]
        parts.append(_estep(f"i{i + 1}", b, [f"(SELECT scale FROM q{i}s WHERE stage = {s})" for s in range(3)], PATTERN.location))
    ends = " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS iteration, CAST(0 AS INTEGER) AS grp, round(sum(ll), 4) + 0.0 AS loglik FROM i{i}ll" for i in range(iterations + 1))
    return "WITH " + ",\n".join(parts) + " " + ends


@query(_em_sql(2))
def em_two_iterations(spark, sf):
    return _one_em(spark, sf, 2).trace(spark).select("iteration", "grp", (F.round("loglik", 4) + 0.0).alias("loglik"))


@query(_PROBS)
def event_probs_csv(spark, sf):
    """The estimates written as CSV and read again."""
    path = _place(spark, "event-probabilities") + ".csv"
    sinks.write_event_probabilities_csv(long1(spark, sf), path)
    back = spark.read.csv(path, header=True, schema="participant long, epoch long, grp int, event int, sample int, prob double")
    return back.select(*TRIAL, "event", "sample", r6("prob").alias("prob"))


@query(f"WITH {F0} SELECT participant, epoch, CAST(max(t) FILTER (p > 0) + 1 AS INTEGER) AS rt FROM xp GROUP BY ALL")
def response_samples(spark, sf):
    return results.response_samples(long1(spark, sf))


@query(f"WITH {E1} SELECT DISTINCT participant, epoch, CAST((participant // 4) * 2 + condition AS INTEGER) AS grp FROM e1")
def grouping_codes(spark, sf):
    trials = e1(spark, sf).select(*TRIAL, "condition", F.floor(F.col("participant") / 4).cast("int").alias("half")).distinct()
    return Grouping.make(1, {"half": [0, 1], "condition": [0, 1]}).code(trials).select(*TRIAL, "grp")


_FIXED = f"WITH {F1},\n{_mstep('q', 'x', 2)}"


def _fixed_em(spark, sf) -> EventModel:
    model = EventModel(PATTERN, 2, fixed_time_pars=(1,), fixed_channel_pars=(0,), max_iteration=1, tolerance=-1e9)
    data = data1(spark, sf, keep=True)
    try:
        return model.fit(data, candidates=[Params(np.array([SCALES]), np.array([B]))])
    finally:
        data.frame.unpersist()


@query(f"{_FIXED} SELECT CAST(stage AS INTEGER) AS stage, round(CASE WHEN stage = 1 THEN {SCALES[1]} ELSE scale END, 6) + 0.0 AS scale FROM qs")
def fixed_time_pars(spark, sf):
    return _fixed_em(spark, sf).time_pars(spark).select("stage", r6("scale").alias("scale"))


@query(f"{_FIXED} SELECT CAST(event AS INTEGER) AS event, CAST(c AS INTEGER) AS component, round(v, 6) + 0.0 AS value FROM (SELECT event, 0 AS c, CASE event WHEN 0 THEN {B[0][0]} ELSE c0 END AS v FROM qb UNION ALL SELECT event, 1, CASE event WHEN 0 THEN {B[0][1]} ELSE c1 END FROM qb)")
def fixed_channel_pars(spark, sf):
    return _fixed_em(spark, sf).channel_pars(spark).select("event", "component", r6("value").alias("value"))


#: Two groups by condition: the first and last stage and the first event are shared.
_GROUPS = {"by": {"condition": [0, 1]}, "channel_map": [[0, 0], [0, 1]], "time_map": [[0, 0, 0], [0, 1, 0]]}
_OF = "epoch % 2 = {}"  # the condition of E1's trials
_GROUPED = "WITH " + ",\n".join([X1, *(x for g in (0, 1) for x in (_some(f"_{g}", _OF.format(g)), _estep(f"g{g}", B, SCALES, PATTERN.location, f"_{g}"), _mstep(f"m{g}", f"g{g}", 2, f"_{g}")))])


def _grouped_em(spark, sf) -> EventModel:
    data = data1(spark, sf, keep=True, metadata=True)
    try:
        return EventModel(PATTERN, 2, max_iteration=1, tolerance=-1e9).fit(data, candidates=[Params(np.array([SCALES] * 2), np.array([B] * 2))], **_GROUPS)
    finally:
        data.frame.unpersist()


@query(f"{_GROUPED}, s AS (SELECT 0 AS grp, * FROM m0s UNION ALL SELECT 1, * FROM m1s) SELECT CAST(grp AS INTEGER) AS grp, CAST(stage AS INTEGER) AS stage, round(CASE WHEN stage = 1 THEN scale ELSE avg(scale) OVER (PARTITION BY stage) END, 6) + 0.0 AS scale FROM s")
def shared_time_pars(spark, sf):
    return _grouped_em(spark, sf).time_pars(spark).select("grp", "stage", r6("scale").alias("scale"))


@query(f"""{_GROUPED}, b AS (SELECT 0 AS grp, * FROM m0b UNION ALL SELECT 1, * FROM m1b), l AS (SELECT grp, event, 0 AS c, c0 AS v FROM b UNION ALL SELECT grp, event, 1, c1 FROM b)
SELECT CAST(grp AS INTEGER) AS grp, CAST(event AS INTEGER) AS event, CAST(c AS INTEGER) AS component, round(CASE WHEN event = 1 THEN v ELSE avg(v) OVER (PARTITION BY event, c) END, 6) + 0.0 AS value FROM l""")
def shared_channel_pars(spark, sf):
    return _grouped_em(spark, sf).channel_pars(spark).select("grp", "event", "component", r6("value").alias("value"))


@query(f"{_GROUPED} SELECT CAST(0 AS INTEGER) AS iteration, CAST(0 AS INTEGER) AS grp, round(sum(ll), 4) + 0.0 AS loglik FROM g0ll UNION ALL SELECT 0, 1, round(sum(ll), 4) + 0.0 FROM g1ll")
def grouped_loglik(spark, sf):
    return _grouped_em(spark, sf).trace(spark).where("iteration = 0").select("iteration", "grp", (F.round("loglik", 4) + 0.0).alias("loglik"))


def _left_out_sql() -> str:
    parts, ends = [X1], []
    for p in range(8):
        ratio = f"((SELECT avg(T) FROM dur_{p}) / (SELECT avg(T) FROM dur WHERE participant <> {p}))"
        parts += [_some(f"_{p}", f"participant = {p}"), _estep(f"l{p}", B, [f"({s} * {ratio})" for s in SCALES], PATTERN.location, f"_{p}")]
        ends.append(f"SELECT CAST(2 AS INTEGER) AS n_event, CAST({p} AS BIGINT) AS participant, round(sum(ll), 4) + 0.0 AS loglik FROM l{p}ll")
    return "WITH " + ",\n".join(parts) + " " + " UNION ALL ".join(ends)


@query(_left_out_sql())
def left_out(spark, sf):
    model = EventModel(PATTERN, 2)
    model.params, model.grouping = Params(np.array([SCALES]), np.array([B])), Grouping.make(2)
    data = data1(spark, sf, keep=True)
    try:
        return crossval.loocv_func(data, lambda others: model).select("n_event", "participant", (F.round("loglik", 4) + 0.0).alias("loglik"))
    finally:
        data.frame.unpersist()


# -- interpretation

@query(f"WITH {T0} SELECT participant, epoch, CAST(event AS INTEGER) AS event, time FROM tm")
def event_times_max(spark, sf):
    return results.event_times(long1(spark, sf)).select(*TRIAL, "event", "time")


@query(f"WITH {F0} SELECT participant, epoch, CAST(event AS INTEGER) AS event, round(sum(t * p) * 10, 5) + 0.0 AS time FROM xp GROUP BY ALL")
def event_times_mean(spark, sf):
    return results.event_times(long1(spark, sf), method="mean", sfreq=100.0).select(*TRIAL, "event", (F.round("time", 5) + 0.0).alias("time"))


_STAGES = T0 + """,
al AS (SELECT participant, epoch, event, time FROM tm UNION ALL SELECT participant, epoch, 2, CAST(T AS DOUBLE) FROM dur),
st AS (SELECT participant, epoch, event, time, time - coalesce(lag(time) OVER (PARTITION BY participant, epoch ORDER BY event), 0) AS d FROM al)"""


@query(f"WITH {_STAGES} SELECT participant, epoch, CAST(event AS INTEGER) AS event, d AS time FROM st")
def stage_durations(spark, sf):
    p = probs1(spark, sf)
    return results.event_times(event_model.exploded(p), durations=p.select(*TRIAL, "duration"), add_rt=True, as_duration=True).select(*TRIAL, "event", "time")


@query(f"WITH {T0}, w AS (SELECT participant, epoch, event + 1 AS event, time FROM tm UNION ALL SELECT DISTINCT participant, epoch, 0, 0.0 FROM tm) SELECT participant, epoch, CAST(event AS INTEGER) AS event, time FROM w")
def event_times_with_stimulus(spark, sf):
    return results.event_times(long1(spark, sf), add_stim=True).select(*TRIAL, "event", "time")


@query(f"WITH {T0} SELECT CAST(event AS INTEGER) AS event, round(avg(time), 6) + 0.0 AS mean, round(stddev_pop(time), 6) + 0.0 AS std, round(stddev_samp(time) / sqrt(count(*)), 6) + 0.0 AS se, count(*) AS n FROM tm GROUP BY ALL")
def times_group_mean(spark, sf):
    return results.group_times(results.event_times(long1(spark, sf))).select("event", r6("mean").alias("mean"), r6("std").alias("std"), r6("se").alias("se"), "n")


@query(f"WITH {_STAGES} SELECT CAST(event AS INTEGER) AS event, round(avg(d), 6) + 0.0 AS duration, round(stddev_pop(d), 6) + 0.0 AS std, round(sum(avg(d)) OVER (ORDER BY event), 6) + 0.0 AS cumulative FROM st GROUP BY event")
def latencies(spark, sf):
    p = probs1(spark, sf)
    out = results.latencies(results.event_times(event_model.exploded(p), durations=p.select(*TRIAL, "duration"), add_rt=True))
    return out.select("event", r6("duration").alias("duration"), r6("std").alias("std"), r6("cumulative").alias("cumulative"))


@query(f"WITH {_STAGES} SELECT CAST(epoch % 2 AS INTEGER) AS condition, CAST(event AS INTEGER) AS event, round(avg(d), 6) + 0.0 AS duration, count(*) AS n FROM st GROUP BY ALL")
def condition_contrast(spark, sf):
    p = probs1(spark, sf)
    times = results.event_times(event_model.exploded(p), durations=p.select(*TRIAL, "duration"), add_rt=True)
    trials = e1(spark, sf).select(*TRIAL, "condition").distinct()
    return results.condition_contrast(times, trials, "condition").select("condition", "event", r6("duration").alias("duration"), "n")


@query(f"WITH {T0}, m AS (SELECT participant, event, avg(time) AS m FROM tm GROUP BY ALL) SELECT CAST(event AS INTEGER) AS event, round(avg(m), 6) + 0.0 AS mean, round(stddev_pop(m), 6) + 0.0 AS std, count(*) AS participants FROM m GROUP BY event")
def two_stage_average(spark, sf):
    return results.two_stage_average(results.event_times(long1(spark, sf)), ["event"]).select("event", r6("mean").alias("mean"), r6("std").alias("std"), "participants")


# Event times that both sides can make from the table alone: the first greatest and the first least value.
_GIVEN = """given AS (SELECT participant, epoch, 0 AS event, CAST(arg_min(sample, struct_pack(x := -value, y := sample)) AS DOUBLE) AS time FROM e1 GROUP BY ALL
  UNION ALL SELECT participant, epoch, 1, CAST(arg_min(sample, struct_pack(x := value, y := sample)) AS DOUBLE) FROM e1 GROUP BY ALL),
gt AS (SELECT participant, epoch, event, CASE event WHEN 0 THEN min(time) OVER w ELSE max(time) OVER w END AS time FROM given WINDOW w AS (PARTITION BY participant, epoch))"""


def given(spark, sf) -> DataFrame:
    g = e1(spark, sf).groupBy(*TRIAL).agg(F.max_by("sample", F.struct("value", -F.col("sample"))).alias("a"), F.min_by("sample", F.struct("value", "sample")).alias("b"))
    return g.select(*TRIAL, F.lit(0).alias("grp"), F.posexplode(F.array(F.least("a", "b").cast("double"), F.greatest("a", "b").cast("double"))).alias("event", "time"))


@query(f"WITH {E1}, {_GIVEN}, s AS (SELECT event, time - coalesce(lag(time) OVER (PARTITION BY participant, epoch ORDER BY event), 0) AS d FROM gt) SELECT CAST(event AS INTEGER) AS stage, round(avg(d), 6) + 0.0 AS mean, round(avg(d) / 2, 6) + 0.0 AS scale FROM s GROUP BY event")
def true_scales(spark, sf):
    return simulate.true_parameters(l1(spark, sf), given(spark, sf), Gamma(2))[0].select("stage", r6("mean").alias("mean"), r6("scale").alias("scale"))


@query(f"WITH {L1}, {_GIVEN} SELECT CAST(event AS INTEGER) AS event, channel, round(avg(value), 6) + 0.0 AS value FROM gt JOIN l1 USING (participant, epoch) WHERE event = 0 AND sample = time GROUP BY ALL")
def true_topographies(spark, sf):
    return simulate.true_parameters(l1(spark, sf), given(spark, sf), Gamma(2))[1].select("event", "channel", r6("value").alias("value"))


_MARKS = f"""WITH {E1}, {_GIVEN}, t AS (SELECT DISTINCT participant, epoch * 200 + 50 AS sample, 1 AS code FROM gt UNION ALL SELECT participant, CAST(epoch * 200 + 50 + time AS BIGINT), event + 2 FROM gt),
m AS (SELECT participant, CAST(row_number() OVER w - 1 AS INTEGER) AS number, sample, CAST(0 AS INTEGER) AS prev, CAST(code AS INTEGER) AS code, sample - coalesce(lag(sample) OVER w, 0) AS since FROM t WINDOW w AS (PARTITION BY participant ORDER BY sample, code))"""


@query(f"{_MARKS} SELECT participant, number, sample, prev, code FROM m")
def trigger_table(spark, sf):
    return simulate.trigger_table(given(spark, sf), 200, 50)


@query(f"{_MARKS} SELECT CAST(participant AS INTEGER) AS participant, sample, prev, code FROM m")
def generating_events(spark, sf):
    """The trigger table written as CSV and read again."""
    path = _place(spark, "generating-events")
    sinks.write_generating_events(simulate.trigger_table(given(spark, sf), 200, 50), path)
    return spark.read.csv(path, header=True, schema="sample long, prev int, code int, participant int").select("participant", "sample", "prev", "code")


@query(f"{_MARKS} SELECT participant, number, since FROM m")
def trigger_intervals(spark, sf):
    return simulate.trigger_intervals(simulate.trigger_table(given(spark, sf), 200, 50)).select("participant", "number", "since")


@query(f"WITH {L1}, {_GIVEN} SELECT participant, epoch, CAST(event AS INTEGER) AS event, channel, round(value, 6) + 0.0 AS value FROM gt JOIN l1 USING (participant, epoch) WHERE sample = time")
def event_channels(spark, sf):
    return results.event_channels(l1(spark, sf), given(spark, sf)).select(*TRIAL, "event", "channel", r6("value").alias("value"))


_TW = ", ".join(repr(x / sum(y * y for y in W)) for x in W)


@query(f"WITH {L1}, {_GIVEN}, w AS (SELECT CAST(unnest(range(5)) AS INTEGER) AS j, unnest([{_TW}]) AS w) SELECT participant, epoch, CAST(event AS INTEGER) AS event, channel, round(sum(value * w), 6) + 0.0 AS value FROM gt JOIN l1 USING (participant, epoch) JOIN w ON sample = time - 2 + j GROUP BY ALL")
def event_channels_template(spark, sf):
    return results.event_channels(l1(spark, sf), given(spark, sf), template=list(W)).select(*TRIAL, "event", "channel", r6("value").alias("value"))


@query(f"WITH {L1}, {_GIVEN} SELECT CAST(event AS INTEGER) AS event, channel, round(avg(value), 6) + 0.0 AS value FROM gt JOIN l1 USING (participant, epoch) WHERE sample = time GROUP BY ALL")
def group_channels(spark, sf):
    return results.group_channels(results.event_channels(l1(spark, sf), given(spark, sf))).select("event", "channel", r6("value").alias("value"))


@query(f"""WITH {L1}, {_GIVEN}, b AS (SELECT participant, epoch, max(time) FILTER (event = 1) AS t1, max(time) FILTER (event = 0) AS t0 FROM gt GROUP BY ALL)
SELECT participant, epoch, channel, CAST(sample - t1 AS INTEGER) AS rel_sample, round(value, 6) + 0.0 AS value, t1 AS event_time FROM l1 JOIN b USING (participant, epoch) WHERE sample >= t1 + greatest(-greatest(t1 - t0, 0), -6) AND sample <= t1 + 8""")
def centered_activity(spark, sf):
    return results.centered_activity(l1(spark, sf), given(spark, sf), 1, n_samples=8, cut_before=1, baseline=-6).select(*TRIAL, "channel", "rel_sample", r6("value").alias("value"), "event_time")


@query(f"""WITH {L1}, {_GIVEN}, b AS (SELECT participant, epoch, max(time) FILTER (event = 0) AS t0, max(time) FILTER (event = 1) AS t1 FROM gt GROUP BY ALL),
g AS (SELECT DISTINCT participant, epoch, channel, t0, t1, CAST(unnest(range(0, 7)) AS INTEGER) AS rel FROM (SELECT DISTINCT participant, epoch, channel FROM l1) JOIN b USING (participant, epoch))
SELECT g.participant, g.epoch, g.channel, CAST(rel + t0 AS INTEGER) AS sample, round(coalesce(CASE WHEN rel <= greatest(least(t1 - t0, 6), 0) THEN value END, -1), 6) + 0.0 AS value
FROM g LEFT JOIN l1 ON l1.participant = g.participant AND l1.epoch = g.epoch AND l1.channel = g.channel AND l1.sample = g.rel + g.t0""")
def centered_activity_imputed(spark, sf):
    out = results.centered_activity(l1(spark, sf), given(spark, sf), 0, n_samples=6, cut_after=1, center=False, impute=-1.0)
    return out.select(*TRIAL, "channel", F.col("rel_sample").cast("int").alias("sample"), r6("value").alias("value"))


@query(f"""WITH {L1}, {_GIVEN}, s AS (SELECT participant, epoch, event, coalesce(lag(time) OVER (PARTITION BY participant, epoch ORDER BY event), 0) AS a, time AS b FROM gt)
SELECT participant, epoch, CAST(event AS INTEGER) AS stage, channel, CAST(sample - a AS INTEGER) AS rel_sample, round(value, 6) + 0.0 AS value FROM s JOIN l1 USING (participant, epoch) WHERE b - a > 1 AND sample >= a AND sample < b""")
def erp_segments(spark, sf):
    return results.erp_segments(l1(spark, sf), given(spark, sf)).select(*TRIAL, "stage", "channel", "rel_sample", r6("value").alias("value"))


@query(f"""WITH {L1}, {_GIVEN}, s AS (SELECT participant, epoch, event, coalesce(lag(time) OVER (PARTITION BY participant, epoch ORDER BY event), 0) AS a, time AS b FROM gt)
SELECT CAST(event AS INTEGER) AS stage, channel, CAST(sample - a AS INTEGER) AS rel_sample, round(avg(value), 9) + 0.0 AS value, count(*) AS n FROM s JOIN l1 USING (participant, epoch) WHERE b - a > 1 AND sample >= a AND sample < b GROUP BY ALL""")
def erp_means(spark, sf):
    return results.erp_means(results.erp_segments(l1(spark, sf), given(spark, sf))).select("stage", "channel", "rel_sample", (F.round("value", 9) + 0.0).alias("value"), "n")


@query(f"WITH {T0} SELECT CAST(event AS INTEGER) AS event, channel, round(avg(value), 6) + 0.0 AS value FROM tm JOIN l1 USING (participant, epoch) WHERE sample = time GROUP BY ALL")
def topography_values(spark, sf):
    p = probs1(spark, sf)
    return results.topography_timecourse(event_model.exploded(p), l1(spark, sf), p.select(*TRIAL, "duration"))[0].select("event", "channel", r6("value").alias("value"))


@query(f"WITH {_STAGES} SELECT CAST(event AS INTEGER) AS event, round(avg(time) * 10, 5) + 0.0 AS mean, round(stddev_pop(time) * 10, 5) + 0.0 AS std, count(*) AS n FROM st GROUP BY ALL")
def topography_times(spark, sf):
    p = probs1(spark, sf)
    times = results.topography_timecourse(event_model.exploded(p), l1(spark, sf), p.select(*TRIAL, "duration"), sfreq=100.0)[1]
    return times.select("event", (F.round("mean", 5) + 0.0).alias("mean"), (F.round("std", 5) + 0.0).alias("std"), "n")


@query(f"WITH {L1} SELECT sample, channel, round(avg(value), 9) + 0.0 AS value, count(*) AS n FROM l1 GROUP BY ALL")
def grand_average(spark, sf):
    return results.grand_average(l1(spark, sf)).select("sample", "channel", (F.round("value", 9) + 0.0).alias("value"), "n")


@query(f"WITH {L1}, {_GIVEN}, p AS (SELECT event, channel, avg(value * value) AS power FROM gt JOIN l1 USING (participant, epoch) WHERE sample = time GROUP BY ALL), n AS (SELECT channel, var_pop(value) AS noise FROM l1 GROUP BY ALL) SELECT CAST(event AS INTEGER) AS event, channel, round(power / noise, 6) + 0.0 AS snr FROM p JOIN n USING (channel)")
def snr(spark, sf):
    return results.snr(l1(spark, sf), given(spark, sf)).select("event", "channel", r6("snr").alias("snr"))


@query(f"WITH {E3}, k AS (SELECT participant, epoch FROM e3 GROUP BY ALL HAVING count(*) >= 4) SELECT participant, epoch, sample, round(price, 6) + 0.0 AS price FROM e3 SEMI JOIN k USING (participant, epoch)")
def common_trials(spark, sf):
    s = adapters.order_trials(spark, sf)
    return epoching.align(s, s.groupBy(*TRIAL).count().where("count >= 4")).select(*TRIAL, "sample", r6("price").alias("price"))


@query(f"WITH {E3} SELECT participant, epoch, sample, condition, o_orderstatus AS status, round(price, 6) + 0.0 AS price FROM e3 JOIN orders ON o_orderkey = epoch")
def metadata_merge(spark, sf):
    meta = spark.read.parquet(f"{sf}/orders.parquet").select((F.col("o_custkey") % 16).cast("long").alias("participant"), F.col("o_orderkey").alias("epoch"), F.col("o_orderstatus").alias("status"))
    return epoching.with_metadata(adapters.order_trials(spark, sf), meta).select(*TRIAL, "sample", "condition", "status", r6("price").alias("price"))


@query(f"""WITH {E1}, loo AS (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS n_event, participant, sum(value) AS s, sum(k) AS q FROM e1 GROUP BY participant),
l AS (SELECT n_event, participant, s * sqrt(n_event) - q * n_event / 3 AS ll FROM loo), d AS (SELECT n_event, participant, ll - lag(ll) OVER (PARTITION BY participant ORDER BY n_event) AS gain FROM l)
SELECT n_event, participant, round(gain, 4) + 0.0 AS gain FROM d WHERE gain IS NOT NULL""")
def loo_diffs(spark, sf):
    return results.loo_differences(_loo_table(spark, sf)).select("n_event", "participant", (F.round("gain", 4) + 0.0).alias("gain"))


def _loo_table(spark, sf) -> DataFrame:
    base = e1(spark, sf).groupBy("participant").agg(F.sum("value").alias("s"), F.sum("k").alias("q"))
    return base.select(F.explode(F.sequence(F.lit(1), F.lit(5))).alias("n_event"), "participant", "s", "q").select("n_event", "participant", (F.col("s") * F.sqrt("n_event") - F.col("q") * F.col("n_event") / 3).alias("loglik"))


@query(f"""WITH {E1}, loo AS (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS n_event, participant, sum(value) AS s, sum(k) AS q FROM e1 GROUP BY participant),
l AS (SELECT n_event, participant, s * sqrt(n_event) - q * n_event / 3 AS ll FROM loo), d AS (SELECT n_event, participant, ll - lag(ll) OVER (PARTITION BY participant ORDER BY n_event) AS gain FROM l)
SELECT n_event, round(avg(gain), 4) + 0.0 AS mean, count(*) AS n, count(*) FILTER (gain > 0) AS positive, round(avg(gain) / (stddev_samp(gain) / sqrt(count(*))), 6) + 0.0 AS t FROM d WHERE gain IS NOT NULL GROUP BY ALL""")
def loo_t(spark, sf):
    return results.loo_tests(_loo_table(spark, sf)).select("n_event", (F.round("mean", 4) + 0.0).alias("mean"), "n", "positive", r6("t").alias("t"))


@query()
def loo_tests(spark, sf):
    return results.loo_tests(_loo_table(spark, sf))


@query(f"""WITH {E4}, te AS (SELECT epoch AS test, channel, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS v FROM e4 WINDOW w AS (PARTITION BY epoch)),
m AS (SELECT participant, channel, avg(value) AS value FROM e4 GROUP BY ALL), tr AS (SELECT participant AS "true", channel, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS v FROM m WINDOW w AS (PARTITION BY participant)),
d AS (SELECT test, "true", median(abs(te.v - tr.v)) AS distance FROM te JOIN tr USING (channel) GROUP BY ALL UNION ALL SELECT test, NULL, median(abs(v)) FROM te GROUP BY ALL),
b AS (SELECT test, "true", distance FROM d QUALIFY row_number() OVER (PARTITION BY test ORDER BY distance, "true" IS NULL, "true") = 1)
SELECT test, CASE WHEN "true" IS NOT NULL AND row_number() OVER (PARTITION BY "true" ORDER BY distance, test) = 1 THEN "true" ELSE -1 END AS "true", round(distance, 6) + 0.0 AS distance FROM b""")
def classify_topographies(spark, sf):
    v = l4(spark, sf)
    test = v.select(F.col("epoch").alias("name"), "channel", "value")
    true = v.groupBy(F.col("participant").alias("name"), "channel").agg(F.avg("value").alias("value"))
    return results.classify(test, true).select("test", F.coalesce("true", F.lit(-1)).alias("true"), r6("distance").alias("distance"))


# -- without SQL: iterative, random or signal-processing operators (tested against plain versions)

@query()
def fit_events(spark, sf):
    return _fit(spark, sf)[0]


def _fit(spark, sf) -> tuple[DataFrame, EventModel]:
    data = data1(spark, sf, keep=True)
    try:
        model = EventModel(PATTERN, 2).fit(data)
    finally:
        data.frame.unpersist()
    return model.trace(spark), model


@query()
def transform_events(spark, sf):
    model = _fit(spark, sf)[1]
    return event_model.exploded(model.transform(data1(spark, sf)))


@query()
def fit_grouped(spark, sf):
    data = data1(spark, sf, keep=True, metadata=True)
    try:
        model = EventModel(PATTERN, 2).fit(data, by={"condition": [0, 1]}, channel_map=[[0, 0], [0, 1]], time_map=[[0, 0, 0], [0, 1, 0]])
    finally:
        data.frame.unpersist()
    return model.time_pars(spark)


@query()
def fit_multistart(spark, sf):
    data = data1(spark, sf, keep=True)
    try:
        return EventModel(PATTERN, 2, starting_points=4, max_scale=45).fit(data).channel_pars(spark)
    finally:
        data.frame.unpersist()


@query()
def eliminative(spark, sf):
    data = data1(spark, sf, keep=True)
    try:
        found = EliminativeMethod(PATTERN).fit(data)
        return spark.createDataFrame([(n, float(m.loglik.sum())) for n, m in found.submodels.items()], "n_events int, loglik double")
    finally:
        data.frame.unpersist()


@query()
def cumulative(spark, sf):
    data = data1(spark, sf, keep=True)
    try:
        found = CumulativeMethod(PATTERN).fit(data)
        return found.model.time_pars(spark)
    finally:
        data.frame.unpersist()


@query()
def loocv(spark, sf):
    data = data1(spark, sf, keep=True)
    try:
        models = [EventModel(PATTERN, n).fit(data) for n in (1, 2)]
        return crossval.loocv(data, models)
    finally:
        data.frame.unpersist()


@query()
def pca(spark, sf):
    weights, _ = reduction.pca(preprocess.center(l3(spark, sf)), 3)
    return weights


@query()
def mcca(spark, sf):
    samples = preprocess.center(l3(spark, sf))
    return reduction.fit_mcca(samples, 2, n_pcs=3).transform(samples)


@query()
def filter_band(spark, sf):
    return signal.filter_trials(l1(spark, sf), 100.0, 1.0, 30.0)


@query()
def bootstrap_erp(spark, sf):
    return results.bootstrap_mean(l1(spark, sf).select("sample", "channel", "epoch", "value"), ["sample", "channel"])


@query()
def simulate_trials(spark, sf):
    return simulate.demo(spark, n_events=3, seed=1)[0]


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Trials of users, z-scored and matched with the template; two events; their times."""
    data = data1(spark, sf, keep=True)
    model = EventModel(PATTERN, 2).fit(data)
    probs = model.transform(data)
    return results.event_times(event_model.exploded(probs), durations=probs.select(*TRIAL, "duration"), add_rt=True, sfreq=100.0)
