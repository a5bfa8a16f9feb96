"""Counters, summaries and the audit table, as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.schema import AUDIT

BUCKETS = ["detected", "clean", "prescreen_skipped", "not_examined", "no_image"]


def series_accounting(slices: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of each series from bucket, decision (nullable) and failed, with the two invariants and the verdict."""
    count = lambda test: F.count_if(test)
    d = slices.groupBy(*keys).agg(
        F.count("*").alias("n_in"), count(~F.col("failed") & ~F.coalesce(F.col("decision") == "DROPPED", F.lit(False))).alias("kept"),
        count(F.col("decision") == "REDACTED").alias("redacted"), count(F.col("decision") == "DROPPED").alias("dropped"), count(F.col("decision") == "UNMASKED").alias("unmasked"), count("failed").alias("errors"),
        *[count(F.col("bucket") == b).alias(f"n_{b}") for b in BUCKETS],
    )
    total = sum((F.col(f"n_{b}") for b in BUCKETS), F.lit(0))
    return d.withColumn("balanced", (total == F.col("n_in")) & (F.col("n_detected") == F.col("redacted") + F.col("dropped") + F.col("unmasked"))).withColumn("empty_result", F.col("kept") == 0)


def confidence_summary(hits: DataFrame, keys: list[str], conf: str) -> DataFrame:
    """Least, tenth percentile, median and greatest of known confidences, and how many are unknown."""
    c = F.col(conf)
    return hits.groupBy(*keys).agg(F.count(c).alias("known"), F.count_if(c.isNull()).alias("unknown"), F.min(c).alias("least"), F.percentile(c, 0.1).alias("p10"), F.percentile(c, 0.5).alias("median"), F.max(c).alias("most"))


def audit_rows(slices: DataFrame, timestamp: Column) -> DataFrame:
    """The audit table: one row for each redacted or dropped slice, all columns in order.

    It holds original identities and belongs beside the mapping, never beside released data.
    """
    d = slices.filter(F.col("decision").isin("REDACTED", "DROPPED")).withColumn("timestamp", timestamp)
    d = d.withColumn("reason", F.when(F.col("decision") == "REDACTED", "redacted_text").otherwise("detected_text"))
    return d.select(*[F.col(c) for c in AUDIT])


def error_rows(slices: DataFrame, accounting: DataFrame, never_drop: bool) -> DataFrame:
    """file, error: failed slices, and series of which nothing is left."""
    reason = "all_slices_failed_to_process" if never_drop else "all_slices_removed_due_to_detected_text"
    one = slices.filter("failed").select(F.col("source_filename").alias("file"), F.col("error"))
    return one.unionByName(accounting.filter("empty_result").select(F.col("series_folder").alias("file"), F.lit(reason).alias("error")))
