"""From raw documents to a training mix, one operator after the other, each on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import decontaminate, lines, mixing, near_dup, toxicity
from holdfast.llm.common import remainder, stored, table

TOXIC = 0.3  # least score of a rejected document
MIN_SITES, SHORT_SITES = 5, 10  # sources on which a line counts as boilerplate, and a short one

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold. Learns from the labels that the toxicity query may learn from."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2))
    return toxicity.score_toxicity(docs, model).where(F.col("toxicity") < TOXIC).select(*docs.columns)


def boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that are found across sites; each such line stays in one place."""
    return lines.dedup_lines(docs, MIN_SITES, short_sites=SHORT_SITES).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_dup.one_of_each(docs).select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, re-parameterised ones included."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, with their number of copies."""
    return mixing.mixed_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic_documents),
    ("line_dedup", boilerplate_lines),
    ("near_dup", near_copies),
    ("decontamination", benchmark_leaks),
    ("mixing", source_mix),
]

#: A fitted classifier comes first, which SQL cannot express; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
