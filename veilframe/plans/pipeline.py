"""The whole run: scan, cohort, pseudonyms, header rewriting, detection, rasters, files and reports.

Executors' Python parses files and works on rasters; everything between is DataFrame expressions.  Headers are parsed
without pixels first, so that the cohort predicate and the mapping decide before any raster is decoded.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.batches import bounded, pieces
from veilframe.config import TEST_KEY, Policy
from veilframe.functions import cohort, geometry, raster, text
from veilframe.operators import detect, elements, kernels, ordering, qc, reports
from veilframe.sinks import dicom as sink
from veilframe.sources import dicom, mapping


@dataclass(frozen=True)
class Result:
    """Tables of a run.  ``restricted`` ones (audit, qc, errors) name original identities or values."""

    files: DataFrame
    images: DataFrame
    shots: DataFrame
    audit: DataFrame
    qc: DataFrame
    errors: DataFrame
    accounting: DataFrame
    actions: DataFrame
    changed_dates: DataFrame
    confidences: DataFrame
    slices: DataFrame


def cohort_of(rows: DataFrame, policy: Policy) -> DataFrame:
    """Parsed files of the cohort: row-local, on their own elements."""
    joined = lambda tag: F.coalesce(F.array_join(dicom.root_values(tag), " "), F.lit(""))
    descriptions = F.flatten(F.filter(F.array(*[dicom.root_values(t) for t in ("00081030", "0008103E", "00180015", "00181160")]), lambda v: v.isNotNull()))
    return rows.filter(cohort.in_cohort(joined("00080060"), joined("00080008"), descriptions, joined("00080016"), policy))


def rasters(rows: DataFrame, policy: Policy) -> DataFrame:
    """instance_id, hu binary (int16), gray binary of accepted files, or an error."""

    def run(batches):
        for b in pieces(batches, "pixels"):
            hu, gray, bad = [], [], []
            for r in b.to_pylist():
                try:
                    if r["pixels"] is None:
                        raise ValueError(r["error"] or "no pixel data")
                    kind = ("i" if r["signed"] else "u") + str(r["bits"] // 8)
                    n = r["rows"] * r["cols"]
                    raw = np.frombuffer(r["pixels"], "<" + kind)[:n].reshape(r["rows"], r["cols"])
                    hu.append(kernels.to_hu(raw, r["slope"], r["intercept"]).tobytes())
                    gray.append(kernels.to_gray8(raw, r["slope"] or 1.0, r["intercept"], (r["photometric"] or "").upper() == "MONOCHROME1").tobytes())
                    bad.append(None)
                except (ValueError, TypeError) as e:
                    hu.append(None)
                    gray.append(None)
                    bad.append(str(e)[:300])
            yield pa.RecordBatch.from_arrays([b.column("instance_id"), pa.array(hu, pa.binary()), pa.array(gray, pa.binary()), pa.array(bad, pa.string())], ["instance_id", "hu", "gray", "raster_error"])

    d = rows.select("instance_id", "pixels", "error", "bits", "signed", "rows", "cols", "slope", "intercept", "photometric")
    return d.mapInArrow(run, "instance_id string, hu binary, gray binary, raster_error string")


def masked(slices: DataFrame, policy: Policy) -> DataFrame:
    """instance_id, pixels: surface removed, rectangles filled, back to stored values."""

    def run(batches):
        for b in pieces(batches, "hu"):
            out = []
            for r in b.to_pylist():
                hu = np.frombuffer(r["hu"], np.int16).reshape(r["rows"], r["cols"])
                made, _ = kernels.without_surface(hu, r["kernel"], policy)
                rects = [(q["x0"], q["y0"], q["x1"], q["y1"]) for q in r["rects"]]
                if rects and not policy.exact and r["gray"] is not None:
                    gray = np.frombuffer(r["gray"], np.uint8).reshape(hu.shape)
                    seeds = [(q["x0"], q["y0"], q["x1"], q["y1"]) for q in r["seed_rects"]]
                    rects = kernels.swept_rects(seeds, gray, hu.shape, policy) + [q for q in rects if q not in seeds]
                out.append(kernels.to_stored(kernels.redacted(made, rects, policy), r["slope"], r["intercept"]).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("instance_id"), pa.array(out, pa.binary())], ["instance_id", "pixels"])

    return slices.select("instance_id", "hu", "gray", "rows", "cols", "rects", "seed_rects", "kernel", "slope", "intercept").mapInArrow(run, "instance_id string, pixels binary")


def written_pixels() -> list[tuple[str, str]]:
    """Elements that describe the stored 16-bit pixels."""
    return [("00280100", "16"), ("00280101", "16"), ("00280102", "15"), ("00280103", "1")]


def run(spark: SparkSession, policy: Policy, input_root: str, mapping_table: DataFrame, factory: Callable[[], detect.Engine] = detect.LineEngine, force: bool = False, work: str | None = None) -> Result:
    """All tables of a run over the files below ``input_root``.

    With ``work``, a folder that all executors share, parsed headers, rewritten elements and the decisions about slices
    are written there once and read again, so that publishing parses headers once and decodes pixels twice (to examine
    them, to mask them) however many tables follow.  Without it, nothing is written and each table starts anew.
    """

    if policy.uid_key in ("", TEST_KEY):
        raise ValueError("the policy needs a uid_key of its own: who knows the key can recompute the new UIDs")

    def kept(df: DataFrame, name: str) -> DataFrame:
        if work is None:
            return df
        df.write.mode("overwrite").parquet(f"{work}/{name}")
        return spark.read.schema(df.schema).parquet(f"{work}/{name}")

    bounded(spark)
    found = dicom.files(spark, input_root)
    heads = kept(dicom.parsed(mapping.pseudonymised(found, mapping_table).drop("new_id"), with_pixels=False), "headers")
    accepted = cohort_of(heads, policy)
    accepted = mapping.pseudonymised(accepted, mapping_table).withColumn("patient", F.col("patient_old"))
    number = F.get(dicom.root_values("00200013"), F.lit(0))
    accepted = accepted.withColumn("instance_number", text.instance_number(F.coalesce(number, F.lit("")), number.isNull()))
    accepted = ordering.numbered(accepted, ["patient_old", "rel_dir"], ["instance_number", "filename"])
    rewritten, marked = elements.rewrite(dicom.elements(accepted), policy)
    pixel_values = F.element_at(F.create_map(*[F.lit(x) for kv in written_pixels() for x in kv]), F.col("tag"))
    rewritten = rewritten.withColumn("value", F.when((F.col("depth") == 0) & (F.col("scope") == "dataset") & pixel_values.isNotNull(), F.array(pixel_values)).otherwise(F.col("value")))
    rewritten = kept(rewritten, "elements")
    # rasters: the predicate is row-local, so contents of accepted files go from the scan to the decoder without a shuffle
    chosen = cohort_of(dicom.parsed(mapping.pseudonymised(found, mapping_table).drop("new_id"), with_pixels=False, with_content=True), policy)
    shots = rasters(dicom.parsed(chosen), policy)
    facts = accepted.select(
        "instance_id", "patient", "patient_old", "new_id", "rel_dir", "filename", "instance_number", "position", "rows", "cols", "slope", "intercept",
        text.burned_in(F.get(dicom.root_values("00280301"), F.lit(0))).alias("burned"),
        *[F.get(dicom.root_values(t), F.lit(0)).alias(n) for n, t in (("series_instance_uid", "0020000E"), ("study_instance_uid", "0020000D"), ("sop_instance_uid", "00080018"))],
        raster.kernel_size(F.col("spacing_row"), F.concat(F.lit(policy.uid_key), "instance_id"), policy.kernel_mm).alias("kernel"),
    )
    slices = facts.join(shots, "instance_id").withColumn("want", geometry.wanted(F.col("burned"), F.lit(force), policy) & F.col("raster_error").isNull())
    # two branches: the engine sees wanted slices only
    seen = detect.examined(slices.filter("want"), factory, policy)
    slices = slices.join(seen, "instance_id", "left")
    slices = detect.decided(slices, policy).withColumn("failed", F.col("raster_error").isNotNull() | F.col("held")).withColumn("error", F.coalesce("raster_error", F.when(F.col("held"), F.col("detect_status"))))
    dirs = ordering.renamed_folders(accepted.select("new_id", "patient_old", "rel_dir"))
    slices = slices.join(dirs, ["new_id", "patient_old", "rel_dir"])
    out_path = F.concat_ws("/", "new_id", F.when(F.col("new_dir") != "", F.col("new_dir")), ordering.output_name(F.col("new_id"), F.col("position")))
    slices = slices.withColumn("out_path", out_path).withColumn("series_folder", F.element_at(F.split(F.concat_ws("/", "patient_old", F.when(F.col("rel_dir") != "", F.col("rel_dir"))), "/"), -1))
    slices = slices.withColumn("source_dir", F.concat_ws("/", "patient_old", "rel_dir")).withColumn("source_filename", F.col("filename"))
    slices = kept(slices.drop("hu", "gray"), "slices")
    good = slices.filter(~F.col("failed") & ~F.coalesce(F.col("decision") == "DROPPED", F.lit(False)))
    images = masked(good.join(shots.drop("raster_error"), "instance_id"), policy).join(good.select("instance_id", "out_path"), "instance_id")
    produced = qc.produced_instances(rewritten.join(good.select("instance_id"), "instance_id", "left_semi"))
    heads_out = accepted.select("instance_id", F.when(F.lit(policy.zero_preamble) & F.col("preamble").isNotNull(), F.lit(b"\x00" * 128)).otherwise(F.col("preamble")).alias("preamble"))
    findings = qc.findings(rewritten, heads_out, produced, policy).join(slices.select("instance_id", F.col("new_id").alias("patient_new_id"), "series_folder", "source_filename"), "instance_id")
    accounting = reports.series_accounting(slices, ["new_id", "rel_dir", "series_folder"])
    audit = reports.audit_rows(slices.withColumnsRenamed({"new_id": "patient_new_id", "patient_old": "patient_old_id", "burned": "burned_in_annotation"}), F.current_timestamp())
    return Result(
        files=sink.as_files(rewritten, images), images=images, shots=shots, audit=audit, qc=findings.select(F.current_timestamp().alias("timestamp"), "patient_new_id", "series_folder", "source_filename", "finding", "tag", "name", "detail"),
        errors=reports.error_rows(slices, accounting, policy.never_drop).unionByName(dicom.errors(heads)), accounting=accounting, actions=elements.action_counts(marked), changed_dates=elements.changed_dates(marked),
        confidences=reports.confidence_summary(slices.filter("has_text"), ["new_id"], "hit_conf"), slices=slices,
    )


def publish(result: Result, files_root: str, tables_root: str) -> None:
    """Files for release to one folder, restricted tables to another; tables are appended."""
    sink.publish(result.files, files_root)
    for name in ("audit", "qc", "errors", "accounting", "actions"):
        getattr(result, name).write.mode("append").parquet(f"{tables_root}/{name}")
