"""The table of pseudonyms: original_folder_name -> new_folder_name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.text import strip

COLUMNS = ["original_folder_name", "new_folder_name"]
#: Column of a raw mapping that orders its rows, where it has one.
ORDER = "_mapping_order"


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """CSV by Spark, Excel by pandas on the driver (a table of one row per patient)."""
    ext = path.rsplit(".", 1)[-1].lower()
    if ext == "csv":
        # rows in the order of files, then of their lines
        place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row"))
        raw = spark.read.option("header", True).csv(path).withColumn(ORDER, place)
    elif ext in ("xlsx", "xls"):
        import pandas as pd

        raw = spark.createDataFrame(pd.read_excel(path, dtype=str).astype(object).where(lambda d: d.notna(), None))
    else:
        raise ValueError(f"unsupported mapping file: {path}")
    return clean_mapping(raw)


def clean_mapping(raw: DataFrame) -> DataFrame:
    """Both columns as stripped text; rows without a key or a new name are left out."""
    missing = [c for c in COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"the mapping has no column {', '.join(missing)}")
    d = raw.select(*[strip(F.col(c).cast("string")).alias(c) for c in COLUMNS], (F.col(ORDER) if ORDER in raw.columns else F.monotonically_increasing_id()).alias("position"))
    return last_wins(d.filter("original_folder_name <> '' AND new_folder_name <> ''"), "original_folder_name", "position").drop("position")


def last_wins(rows: DataFrame, key: str, position: str) -> DataFrame:
    """The row of the greatest position of each key: a grouped maximum, so hot keys are reduced before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    top = rows.groupBy(key).agg(F.max_by(F.struct(*rest), position).alias("r"))
    return top.select(key, "r.*").select(*rows.columns)


def shared_names(mapping: DataFrame) -> DataFrame:
    """New names that more than one patient would get: must be empty before a release."""
    return mapping.groupBy("new_folder_name").agg(F.count("*").alias("n")).filter("n > 1")


def pseudonymised(files: DataFrame, mapping: DataFrame) -> DataFrame:
    """Files of mapped patients, with new_id; patients on either side alone are left out."""
    return files.join(mapping.select(F.col("original_folder_name").alias("patient_old"), F.col("new_folder_name").alias("new_id")), "patient_old")


def unmapped(files: DataFrame, mapping: DataFrame) -> DataFrame:
    return files.select("patient_old").distinct().join(mapping, F.col("patient_old") == F.col("original_folder_name"), "left_anti")


