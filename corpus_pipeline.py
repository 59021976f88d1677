"""Corpus pipeline: quality, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor
kept, and returns the columns of ``documents`` (the last: packed pieces).
Labels come from ``labels`` and the benchmark from ``benchmark`` in sf_dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relaysync.llm.common import read, staged
from relaysync.llm.decontamination import find_contamination
from relaysync.llm.line_dedup import dedup_lines
from relaysync.llm.order_minhash import drop_near_duplicates
from relaysync.llm.packing import pack
from relaysync.llm.quality import fit, keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return keep_good(docs, fit(docs, read(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that stand earlier in the corpus."""
    return dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class; a text without words left is a class by itself."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    found = find_contamination(docs, read(spark, sf_dir, "benchmark"))
    return found.filter("not contaminated").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in bins of permitted lengths."""
    return pack(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate),
          ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage-{name}")
    return docs
