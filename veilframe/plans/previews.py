"""Pictures for review and a second look at masked slices.  All of it belongs to the restricted side."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.config import Policy
from veilframe.functions import text
from veilframe.operators import detect, kernels, ordering

FOLDERS = {"detected": "detected_text", "clean": "no_text_detected", "prescreen_skipped": "not_examined_prescreen_skipped", "not_examined": "not_examined_detection_off"}


def picture_name() -> Column:
    """Safe name from the new id, the series and the file's stem."""
    return F.concat(text.file_name(F.concat_ws("_", "new_id", "series_folder", text.stem(F.col("source_filename")))), F.lit(".png"))


def examined_slices(slices: DataFrame, shots: DataFrame) -> DataFrame:
    """path, content: each slice as the detector saw it, in its bucket's folder, with the masked rectangles outlined."""
    d = slices.join(shots.select("instance_id", "gray"), "instance_id").filter("gray IS NOT NULL").withColumn("folder", F.element_at(F.create_map(*[F.lit(x) for kv in FOLDERS.items() for x in kv]), F.col("bucket"))).filter("folder IS NOT NULL")
    d = d.select(F.concat_ws("/", "folder", picture_name()).alias("path"), "gray", "rows", "cols", "rects")

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                gray = np.frombuffer(r["gray"], np.uint8).reshape(r["rows"], r["cols"])
                out.append(kernels.png(kernels.outlined(gray, [(q["x0"], q["y0"], q["x1"], q["y1"]) for q in r["rects"] or []])))
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(out, pa.binary())], ["path", "content"])

    return d.mapInArrow(run, "path string, content binary")


def masked_hu(images: DataFrame, slices: DataFrame) -> DataFrame:
    """Masked pixels with the facts of their slices."""
    facts = slices.select("instance_id", "rows", "cols", "slope", "intercept", "new_id", "rel_dir", "series_folder", "source_filename", "position", "burned")
    return images.select("instance_id", "pixels").join(facts, "instance_id")


def middle_slices(images: DataFrame, slices: DataFrame, centre: float = -100.0, width: float = 350.0) -> DataFrame:
    """path, content: the middle slice of each finished series in a display window."""
    d = ordering.numbered(masked_hu(images, slices).drop("position").join(slices.select("instance_id", "position"), "instance_id").withColumnRenamed("position", "place"), ["new_id", "rel_dir"], ["place"])
    d = ordering.middle(d).select(F.concat(text.file_name(F.concat_ws("_", "new_id", "rel_dir")), F.lit(".png")).alias("path"), "pixels", "rows", "cols", "slope", "intercept")

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                hu = np.frombuffer(r["pixels"], "<i2").reshape(r["rows"], r["cols"]) * (r["slope"] or 1.0) + r["intercept"]
                out.append(kernels.png((((hu - (centre - width / 2)) / width).clip(0, 1) * 255).astype(np.uint8)))
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(out, pa.binary())], ["path", "content"])

    return d.mapInArrow(run, "path string, content binary")


def second_pass(images: DataFrame, slices: DataFrame, factory: Callable[[], detect.Engine], policy: Policy) -> DataFrame:
    """instance_id, hit_text of redacted slices in which the detector still reads text."""
    redacted = slices.filter("decision = 'REDACTED'").select("instance_id")
    d = masked_hu(images.join(redacted, "instance_id", "left_semi"), slices)

    def run(batches):
        for b in batches:
            gray = [kernels.to_gray8(np.frombuffer(r["pixels"], "<i2").reshape(r["rows"], r["cols"]), r["slope"] or 1.0, r["intercept"]).tobytes() for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("instance_id"), pa.array(gray, pa.binary()), b.column("rows"), b.column("cols"), b.column("burned")], ["instance_id", "gray", "rows", "cols", "burned"])

    shots = d.select("instance_id", "pixels", "rows", "cols", "slope", "intercept", "burned").mapInArrow(run, "instance_id string, gray binary, rows int, cols int, burned boolean")
    seen = detect.examined(shots, factory, policy).join(slices.select("instance_id", "rows", "cols"), "instance_id")
    kept = detect.kept_hits(F.col("hits"), F.col("blank"), F.col("rows"), F.col("cols"), policy)
    return seen.withColumn("kept", kept).filter(F.size("kept") > 0).select("instance_id", text.joined_hits(F.transform("kept", lambda h: h.text)).alias("hit_text"))
