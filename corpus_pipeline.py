"""A training corpus from ``documents``: five stages, each stored before the next reads it.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.
Nulls, repeated rows, empty tables and extra columns are treated as the operators' docstrings say; what a stage
does with them is said in its own docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import decontaminate as benchmark_phrases
from palisade.llm import language, line_dedup, mixing, near_dedup
from palisade.llm.common import ready, stored

#: Near copies share so many of 100 word shingles.
NEAR_PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; what has no letters, or null text, goes."""
    ready(spark)
    model = language.fit(docs, ~language.held_out())
    known = language.with_language(docs.withColumnsRenamed({"lang_pred": "__lang_pred", "score": "__score"}), model).where(F.col("lang_pred") != language.UNKNOWN)
    return known.drop("lang_pred", "score").withColumnsRenamed({"__lang_pred": "lang_pred", "__score": "score"})


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier one has, or has but for 2 edits; documents of which no line is left go."""
    ready(spark)
    return line_dedup.deduplicated(docs, bound=2, fold_short=True)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (``NEAR_PERCENT``); of repeated rows one."""
    return near_dedup.deduplicated(docs, NEAR_PERCENT, near_dedup.least_equal_for(NEAR_PERCENT))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that were nothing else go."""
    return benchmark_phrases.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), drop_emptied=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the target of its source asks, numbered by ``copy``."""
    ready(spark)
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: Linear classifiers and signatures can't be said in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
