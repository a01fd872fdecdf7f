"""Quality rules, near-dedup, substring dedup, source mixing, packing: the stages of a training corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. Every stage sees all that the one before kept,
and its decisions take effect: rejected documents go, one of each near-duplicate
group stays, repeated passages are cut out of the texts, documents come as often
as the mix takes them, and the last stage returns the packed pieces.

``docs`` may be any table: files, or the unstored result of joins, unions and generators, whose
rows are then written first. A stage deletes its working tables before it returns; its result reads
``docs`` and what the stage decided (places of rows, numbers of copies, rates of hosts, or the cut texts),
and can be read again whatever runs later. :func:`run` deletes each stored result once the next one is stored.

Edge cases: a null text fails the quality rules; a null source is a host and a
source of its own; a null doc_id is linked with nothing, loses no words, and its
rows are mixed and packed one by one; rows that share a doc_id are judged each by
its own text, of a near-duplicate group one row stays; very long texts are taken
whole; an empty table gives an empty result; further columns, whatever their names,
stay with their rows up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import mixing, neardup, packing, quality, substring
from veilspark.llm.workspace import drop_written, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.deduplicated(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("minhash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("source mixing", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: Pivotal rounding and BPE ids are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            drop_written(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
