"""Schemas of the tables that operators exchange."""

from __future__ import annotations

ELEMENTS = (
    "instance_id string, scope string, depth int, item_path string, ancestor_tags array<string>, "
    "ancestor_items array<string>, grp int, elem int, tag string, vr string, value array<string>"
)
INSTANCES = (
    "instance_id string, patient_old string, rel_dir string, filename string, preamble binary, transfer_syntax string, "
    "rows int, cols int, slope double, intercept double, photometric string, spacing_row double, iop array<double>, pixels binary"
)
POINTS = "array<struct<x: double, y: double>>"
HITS = f"array<struct<points: {POINTS}, text: string, conf: double>>"
RECTS = "array<struct<x0: int, y0: int, x1: int, y1: int>>"
ERRORS = "file string, error string"
#: Columns of the mapping table.
MAPPING = "original_folder_name string, new_folder_name string"
#: Columns of the audit and quality-control tables, in order.
AUDIT = [
    "timestamp", "patient_old_id", "patient_new_id", "series_folder", "source_dir", "source_filename", "instance_number",
    "series_instance_uid", "study_instance_uid", "sop_instance_uid", "burned_in_annotation", "decision", "reason",
    "hit_text", "hit_conf", "hit_bbox", "n_redacted_regions", "boxless_hits", "forced_keep",
]
QC = ["timestamp", "patient_new_id", "series_folder", "source_filename", "finding", "tag", "name", "detail"]
