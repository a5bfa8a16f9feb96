"""The operators of this subpackage over the test tables, with production parameters."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import bpe, jaccard, jpeg, langid, licenses, lines, oracles, packing, rules, sharding, sites
from veilframe.llm.common import small_batches, table


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source is its host, the language section of that source its path."""
    path = F.concat_ws("/", "source", "lang")
    return sites.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), path, sites.SiteParams(hold_out=True))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


def op3_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(table(spark, sf_dir, "documents"), word_vocabulary(), with_ids=False)


def op4_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.digests(table(spark, sf_dir, "documents"))


def op5_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), word_vocabulary())


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_components(table(spark, sf_dir, "documents"))


def op10_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with their repeats taken out; removed has the stretches as start:length:kept_doc:kept_start."""
    parts = F.transform("removed", lambda x: F.concat_ws(":", *[x[k].cast("string") for k in ("start", "length", "kept_doc", "kept_start")]))
    return lines.dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", F.array_join(parts, " ").alias("removed"))


def _bounded(query):
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


OPERATORS = (
    op1_quality_classifier, op2_quality_rules, op3_curve_packing, op4_jpeg_media, op5_ring_sharding, op6_bpe,
    op7_language_id, op8_license_scan, op9_ngram_jaccard_join, op10_unit_dedup,
)
QUERIES = {f.__name__: _bounded(f) for f in OPERATORS}
ORACLES = oracles.ORACLES
