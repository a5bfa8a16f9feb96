"""Order of slices, output names and folder names: windows within a series or a parent folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(slices: DataFrame, series: list[str], order: list[str]) -> DataFrame:
    """``position`` (from 1) and ``n`` of each slice in its series; slices that fail later keep their position."""
    w = Window.partitionBy(*series)
    return slices.withColumn("position", F.row_number().over(w.orderBy(*order))).withColumn("n", F.count("*").over(w))


def output_name(new_id: Column, position: Column) -> Column:
    return F.format_string("%s_%05d.dcm", new_id, position)


def middle(slices: DataFrame) -> DataFrame:
    """The middle slice of each numbered series, the later of two."""
    return slices.filter(F.col("position") == F.floor(F.col("n") / 2) + 1)


def folder_ranks(folders: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``place`` of each folder name among those of its parent, from 1."""
    return folders.withColumn("place", F.dense_rank().over(Window.partitionBy(*parent).orderBy(name)))


def renamed_folders(dirs: DataFrame, dealt: bool = False) -> DataFrame:
    """new_id, patient_old, rel_dir, new_dir: on every level, a name becomes new_id and its place in the original parent folder.

    ``dirs`` has new_id, patient_old, rel_dir.  All prefixes of the paths are ranked at once, however deep they are.
    Folders are dealt by patient once, or come so (``dealt``): ranks and groups on longer keys are made where they lie.
    """
    keys = ["new_id", "patient_old", "rel_dir"]
    d = dirs.select(*keys)
    d = (d if dealt else d.repartition("patient_old")).distinct()
    parts = F.when((F.col("rel_dir") != "") & F.col("patient_old").isNotNull(), F.split("rel_dir", "/"))
    steps = d.withColumn("parts", parts).select(*keys, "parts", F.posexplode_outer("parts").alias("level", "name"))
    steps = steps.select(*keys, "level", F.array_join(F.slice("parts", 1, F.col("level")), "/").alias("parent"), "name")
    # equal names share a place, so the paths needn't be made distinct and joined again
    ranked = folder_ranks(steps, ["patient_old", "level", "parent"], "name")
    made = F.when(F.col("level").isNotNull(), F.struct("level", F.concat("new_id", F.lit("_"), F.col("place").cast("string")).alias("made")))
    new = ranked.groupBy(*keys).agg(F.sort_array(F.collect_list(made)).alias("steps"))
    return new.select(*keys, F.array_join(F.transform("steps", lambda x: x["made"]), "/").alias("new_dir"))
