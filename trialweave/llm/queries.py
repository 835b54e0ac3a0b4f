"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.llm import decontaminate, fertility, hosts, langid, linededup, ngramjoin, packing, quality, toxicity
from trialweave.llm.sharding import ShardStore
from trialweave.llm.shared import shared_folder
from trialweave.llm.text import crc_mod

#: Files of public tokenizers; operators take paths as parameters.
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 low quality, 1 good but toxic, 2 good.  Trained on rows with crc32(doc_id) mod 3 other than 1."""
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    ratings = labels.where(~F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))).select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2).alias("grade"))
    model = quality.fit_on(docs, ratings, 3)
    out = quality.grade(docs, model)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "expected_grade", "tail_probability", "selected")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = toxicity.fit_on(docs, labels.where(~F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))))
    out = toxicity.score(docs, model)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_hits")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_components(_read(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return decontaminate.verdicts(found).drop("text_key")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight arrivals, compacted until no tier has a run to merge; the live shard of every document."""
    store = ShardStore(spark, f"{shared_folder(spark)}/trialweave-shards-{uuid.uuid4().hex}")
    docs = _read(spark, sf_dir, "documents")
    store.append_each(docs, F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(8)), F.lit(0)).cast("int"))
    store.settle()
    store.vacuum()
    return store.load().select("doc_id", "n_chars", F.col("_shard").alias("shard"), F.col("_rows").alias("shard_rows"), F.col("_generation").alias("generation"), F.col("_version").alias("version"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality_rules(_read(spark, sf_dir, "documents"), PIECES)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of a labelled page: ``labels.quality`` of the same number."""
    pages, labels = _read(spark, sf_dir, "pages").select("page_id", "url"), _read(spark, sf_dir, "labels")
    outcomes = hosts.with_parts(pages).join(labels.select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good")), "page_id").select("host", "good")
    return hosts.judge(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), WORD_BPE)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.fit_on(docs.where(~F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))))
    out = langid.identify(docs, model)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality, op2_toxicity, op3_ngram_jaccard, op4_decontaminate, op5_line_dedup, op6_sharding, op7_quality_rules, op8_url_filter, op9_pack, op10_language, pipeline)
}

_ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_DOUBLE = ", ".join(f"'{s}'" for s in hosts.DOUBLE_SUFFIXES)


def _shrink(name: str, counts: str, parent: str, on: str) -> str:
    """CTEs of one level: moments of the prior, then posterior mean and strength."""
    return f"""
{name}_in AS (SELECT c.*, p.mean AS m FROM {counts} c JOIN {parent} p ON {on}),
{name}_k AS (SELECT coalesce(least(1000.0, greatest(2.0, CASE WHEN (sum(n * (good / n - m) * (good / n - m)) - sum(m * (1 - m))) / sum(n) > 0
  THEN (sum(n * m * (1 - m)) / sum(n)) / ((sum(n * (good / n - m) * (good / n - m)) - sum(m * (1 - m))) / sum(n)) - 1 ELSE 1000.0 END)), 2.0) AS k FROM {name}_in),
{name} AS (SELECT i.*, (good + k * m) / (n + k) AS mean, n + k AS strength FROM {name}_in i, {name}_k)"""


ORACLE: dict[str, str] = {
    # All pairs that share a shingle are counted, and components found by walking the links.
    "op3_ngram_jaccard": f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ABC}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(4, len(w)) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT b, root FROM reach JOIN ways ON a = doc_id)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reach ON reach.doc_id = d.doc_id GROUP BY d.doc_id""",
    # Every window of every document is looked up among the items' windows of its size.
    "op4_decontaminate": f"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ABC}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
items AS (SELECT item_id, w, least(13, len(w)) AS size FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_ABC}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
asked AS (SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM items)),
given AS (SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS g FROM (SELECT doc_id, w, size, unnest(range(1, greatest(1, len(w) - size + 2))) AS i FROM words, (SELECT DISTINCT size FROM asked))),
hits AS (SELECT doc_id, i, size, item_id FROM given JOIN asked USING (size, g)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op8_url_filter": f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS after FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(coalesce(after, ''), '^([^/?#]*)', 1), {_ABC}) AS host, regexp_extract(coalesce(after, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
bare AS (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS b FROM parts),
pieces AS (SELECT *, string_split(b, '.') AS l FROM bare),
two AS (SELECT *, array_to_string(l[-2:], '.') AS t FROM pieces),
lev AS (SELECT page_id, host, path, CASE WHEN t IN ({_DOUBLE}) THEN t ELSE l[-1] END AS suffix, CASE WHEN t IN ({_DOUBLE}) THEN array_to_string(l[-3:], '.') ELSE t END AS domain FROM two),
o AS (SELECT v.host, v.domain, v.suffix, l.quality AS good FROM lev v JOIN labels l ON l.doc_id = v.page_id WHERE l.quality IS NOT NULL AND v.host <> ''),
hc AS (SELECT host, domain, suffix, CAST(count(*) AS DOUBLE) AS n, CAST(sum(good) AS DOUBLE) AS good FROM o GROUP BY ALL),
dc AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM hc GROUP BY ALL),
sc AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM dc GROUP BY ALL),
top AS (SELECT (coalesce(sum(good), 0) + 1.0) / (coalesce(sum(n), 0) + 2.0) AS mean, coalesce(sum(n), 0) + 2.0 AS strength FROM sc),
{_shrink("s", "sc", "top", "true")},
{_shrink("d", "dc", "s", "c.suffix = p.suffix")},
{_shrink("h", "hc", "d", "c.domain = p.domain")},
known AS (SELECT v.*, coalesce(h.mean, d.mean, s.mean, top.mean) AS gm, coalesce(h.strength, d.strength, s.strength, top.strength) AS gs
  FROM lev v LEFT JOIN h ON h.host = v.host LEFT JOIN d ON d.domain = v.domain LEFT JOIN s ON s.suffix = v.suffix CROSS JOIN top),
fit AS (SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM known)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN least(1.0, gm + {hosts.Z} * sqrt(gm * (1 - gm) / (gs + 1))) < {hosts.LEAST_GOOD} THEN 'block' ELSE 'allow' END AS verdict
FROM fit""",
}
