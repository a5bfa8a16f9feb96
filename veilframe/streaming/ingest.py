"""Incremental runs: new header rows are de-identified as their files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.config import Policy
from veilframe.functions import identity


def file_stream(spark: SparkSession, root: str) -> DataFrame:
    """New files below a folder, as a stream."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(root)


def swept_stream(elements: DataFrame, policy: Policy) -> DataFrame:
    """The stateless part on a stream of element rows: dates swept and UIDs replaced; keyed hashes need no state."""
    patient, vr, tag = F.col("patient"), F.col("vr"), F.col("tag")
    value = F.when(vr.isin("DA", "DT", "TM"), F.transform("value", lambda v: identity.swept(vr, v, policy)))
    value = value.when((vr == "UI") & tag.isin("00080018", "0020000D", "0020000E", "00081155"), F.transform("value", lambda v: identity.remapped(v, patient, policy)))
    return elements.withColumn("value", value.otherwise(F.col("value")))


def windowed_actions(actions: DataFrame, time: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts of actions by event-time window, with late rows up to ``late``."""
    d = actions.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "action").agg(F.count("*").alias("n"))
    return d.select(F.col("w.start").alias("window_start"), "action", "n")


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Everything that is there now, exactly once, then stop."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
