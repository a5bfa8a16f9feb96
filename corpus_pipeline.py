"""A training corpus in five stages: language, quality, near copies, repeated passages, packing."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from veilframe.llm import jaccard, langid, lines, packing, rules
from veilframe.llm.common import MADE, drop_staged, small_batches, staged, table
from veilframe.llm.queries import word_vocabulary


#: Staged tables of the stages that ran in this session.
_OWN: list[str] = []


def _stage(work):
    """A stage starts when its predecessor's result is written: tables that only earlier stages needed can go."""

    @functools.wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        _OWN[:] = drop_staged(spark, _OWN, docs)
        before = len(MADE)
        try:
            return work(spark, docs, sf_dir)
        finally:
            _OWN.extend(MADE[before:])

    return run


@_stage
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language of the corpus."""
    return langid.filter_known(docs)


@_stage
def fit_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return rules.accepted(docs)


@_stage
def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id."""
    return jaccard.one_of_each(docs)


@_stage
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines and sentences that an earlier document has."""
    return lines.deduplicated(docs)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences, with their ids."""
    return packing.pieces(docs, word_vocabulary())


STAGES = [("language", known_language), ("quality", fit_quality), ("near_copies", without_copies), ("repeats", without_repeats), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_staged(spark, before)
        before = MADE[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its pieces without the ids themselves, whose checksums stay."""
    return run(spark, sf_dir).drop("ids")


#: Stages 7, 9, 10 and 3 can't be put in SQL; tests hold them against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": pipeline}
ORACLES: dict[str, str] = {}
