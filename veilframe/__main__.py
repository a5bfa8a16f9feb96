"""Command line: de-identify a folder of patients."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from veilframe.config import Policy
from veilframe.plans import pipeline, previews
from veilframe.session import ship
from veilframe.sinks.dicom import publish
from veilframe.sources.mapping import read_mapping, shared_names


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="veilframe", description=__doc__)
    p.add_argument("input", help="folder with one sub-folder per patient")
    p.add_argument("mapping", help="CSV or Excel table with original_folder_name, new_folder_name")
    p.add_argument("release", help="folder for cleaned files, shared by all executors")
    p.add_argument("restricted", help="folder for audit, QC and error tables")
    p.add_argument("--date", required=True, help="anonymisation date, YYYYMMDD")
    p.add_argument("--uid-key", required=True, help="secret of this release")
    p.add_argument("--examine-all", action="store_true", help="look for text in every slice, not only in flagged ones")
    p.add_argument("--allow-angio-perfusion", action="store_true")
    p.add_argument("--hardened", action="store_true")
    p.add_argument("--fail-closed", action="store_true")
    p.add_argument("--previews", action="store_true", help="also write pictures for review to the restricted folder")
    a = p.parse_args(argv)
    spark = ship(SparkSession.builder.appName("veilframe").getOrCreate())
    policy = Policy(date=a.date, uid_key=a.uid_key, hardened=a.hardened, fail_closed=a.fail_closed, allow_angio_perfusion=a.allow_angio_perfusion)
    table = read_mapping(spark, a.mapping)
    if twice := shared_names(table).limit(5).collect():
        p.error(f"new names for more than one patient: {', '.join(r['new_folder_name'] for r in twice)}")
    result = pipeline.run(spark, policy, a.input, table, force=a.examine_all, work=f"{a.restricted}/work")
    pipeline.publish(result, a.release, a.restricted)
    if a.previews:
        publish(previews.examined_slices(result.slices, result.shots), f"{a.restricted}/previews")
        publish(previews.middle_slices(result.images, result.slices), f"{a.restricted}/renders")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
