"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and
reread as the next one's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.llm import queries
from trialweave.llm.decontaminate import remove_contaminated
from trialweave.llm.fertility import quality_rules
from trialweave.llm.linededup import dedup_lines
from trialweave.llm.ngramjoin import first_of_each
from trialweave.llm.packing import pack_documents
from trialweave.llm.shared import Scratch
from trialweave.llm.text import hidden, shown


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    own, inner = hidden(docs, "doc_id", "text")
    return shown(quality_rules(own, queries.PIECES, carry=tuple(inner)).where("kept"), inner, docs.columns)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages; documents with no word left go."""
    own, inner = hidden(docs, "doc_id", "text", "n_chars")
    out = dedup_lines(own).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^ \t\n\r\x0B\f]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return shown(out, inner, docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8): the first by id
    (without an id: last) and text.  Rows that share an id but not a text are documents of their
    own; of rows with the same id and text one stays, unless they have no words."""
    return first_of_each(docs, n=5, num=80, den=100)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 ids."""
    return pack_documents(docs, queries.WORD_BPE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", rules_stage),
    ("line_dedup", lines_stage),
    ("ngram_jaccard_join", near_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: Tokenising and hashing cannot be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch, last = Scratch(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if last:
            scratch.drop(last)
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
