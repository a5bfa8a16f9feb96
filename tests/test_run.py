"""Whole runs over folders of files."""

from __future__ import annotations

import os
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from dicom_files import head_slice, phantom
from veilframe.config import Policy
from veilframe.functions import identity
from veilframe.operators import detect
from veilframe.__main__ import main
from veilframe.plans import pipeline, previews
from veilframe.sources import mapping
from veilframe.sources.dicom import parse
from veilframe.streaming import ingest


class Broken:
    def read_batch(self, images):
        raise RuntimeError("no model")


def broken():
    return Broken()


@pytest.fixture(scope="module")
def cohort(tmp_path_factory):
    root = tmp_path_factory.mktemp("cohort")
    files = {
        "A/s1/x.dcm": head_slice("1.2.3.1", "2", phantom()), "A/s1/y.dcm": head_slice("1.2.3.2", None, phantom(text=True), burned="YES"), "A/s1/z.dcm": head_slice("1.2.3.3", "x", phantom()),
        "A/s1/cut.dcm": head_slice("1.2.3.5", "3", phantom(), pixels=b""), "A/s1/notes.txt": b"not an image", "A/s2/deep/one.dcm": head_slice("1.2.3.4", "1", phantom(), study="head ANGIO"),
        "A/s2/cta.dcm": head_slice("1.2.3.6", "1", phantom(), study="head cta"), "A/s2/chest.dcm": head_slice("1.2.3.7", "1", phantom(), study="chest").replace(b"HEAD", b"BODY"), "B/one.dcm": head_slice("1.2.3.8", "1", phantom()), "C/one.dcm": head_slice("1.2.3.9", "1", phantom()),
    }
    for name, data in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    ids = root.parent / "ids.csv"
    ids.write_text("original_folder_name,new_folder_name,note\nA,P0,first\n A ,P1 ,last wins\nC,P3,\nD,P4,no folder\n,P5,\n")
    return str(root), str(ids)


def test_whole_run(spark, cohort, tmp_path):
    root, ids = cohort
    policy = Policy(uid_key="secret")
    table = mapping.read_mapping(spark, ids)
    assert {tuple(r) for r in table.collect()} == {("A", "P1"), ("C", "P3"), ("D", "P4")}
    r = pipeline.run(spark, policy, root, table, work=str(tmp_path / "work"))
    files = {x.path: bytes(x.content) for x in r.files.collect()}
    # order: no number counts as 1, then 2, 3 (failed, keeps its place), and what is no number comes last
    assert sorted(files) == ["P1/P1_1/P1_00001.dcm", "P1/P1_1/P1_00002.dcm", "P1/P1_1/P1_00004.dcm", "P1/P1_2/P1_1/P1_00001.dcm", "P3/P3_00001.dcm"]
    p = parse(files["P1/P1_1/P1_00001.dcm"])
    root_values = {e[6]: e[8] for e in p["elements"] if e[0] == "dataset" and e[1] == 0}
    assert root_values["00100010"] == ["Anonymous^Anonymous"] and root_values["00100020"] == ["P1"] and root_values["00080020"] == ["20000101"] and root_values["00101010"] == ["089Y"]
    assert root_values["00080080"] == [] and "00091001" not in root_values and root_values["00081140"] == ["1"] and p["preamble"] == b"\x00" * 128
    uid = root_values["00080018"][0]
    assert uid.startswith("2.25.1") and {e[8][0] for e in p["elements"] if e[6] == "00020003"} == {uid}
    # a reference to a slice has that slice's new UID
    other = parse(files["P1/P1_1/P1_00002.dcm"])
    assert next(e[8] for e in p["elements"] if e[6] == "00081155") == next(e[8] for e in other["elements"] if e[6] == "00080018")
    blob = b"".join(files.values())
    assert not any(s in blob for s in (b"Doe", b"MRN1", b"Old Hospital", b"1.2.3.1", b"19300101", b"SITE"))
    # the face is gone up to the bone, strokes are filled, the inside is untouched
    hu = np.frombuffer(p["pixels"], "<i2").reshape(64, 64).astype(int) - 1024
    src = phantom(text=True) - 1024
    assert (hu[4:12, 4:30] == -1000).all()
    y, x = np.mgrid[:64, :64]
    inside = np.hypot(y - 32, x - 32) < 18
    assert (hu[inside] == src[inside]).all()
    assert (np.frombuffer(other["pixels"], "<i2").reshape(64, 64)[32, 7:9] == 24).all()
    audit = r.audit.collect()
    assert [(a.source_filename, a.decision, a.patient_old_id, a.patient_new_id, a.instance_number, a.sop_instance_uid) for a in audit] == [("y.dcm", "REDACTED", "A", "P1", 1, "1.2.3.2")] and audit[0].n_redacted_regions >= 1
    assert r.audit.columns == pipeline.reports.AUDIT
    # all slices refer to one of patient A's: patient C's output doesn't hold it
    assert [(x.patient_new_id, x.source_filename, x.finding) for x in r.qc.collect()] == [("P3", "one.dcm", "unresolved_reference")]
    errors = {x.file: x.error for x in r.errors.collect()}
    assert "cut.dcm" in errors and "A/s1/notes.txt" in errors
    account = {x.rel_dir + "|" + x.new_id: x for x in r.accounting.collect()}
    s1 = account["s1|P1"]
    assert (s1.n_in, s1.kept, s1.redacted, s1.errors, s1.n_not_examined) == (4, 3, 1, 1, 3) and s1.balanced and not s1.empty_result
    out = tmp_path / "out"
    pipeline.publish(r, str(out / "release"), str(out / "tables"))
    found = sorted(os.path.relpath(os.path.join(d, f), out / "release") for d, _, fs in os.walk(out / "release") for f in fs)
    assert found == sorted(files)
    assert spark.read.parquet(str(out / "tables/audit")).count() == 1


def test_hardened_run_excludes_angio(spark, cohort):
    root, ids = cohort
    r = pipeline.run(spark, Policy(uid_key="secret", hardened=True), root, mapping.read_mapping(spark, ids))
    assert "P1/P1_2/P1_1/P1_00001.dcm" not in {x.path for x in r.files.select("path").collect()}


def test_failing_detector_is_seen_and_can_hold_slices(spark, cohort):
    root, ids = cohort
    table = mapping.read_mapping(spark, ids)
    r = pipeline.run(spark, Policy(uid_key="s"), root, table, broken).slices.select("source_filename", "detect_status", "failed").collect()
    assert {x.detect_status for x in r if x.source_filename == "y.dcm"} == {"failed: RuntimeError"} and not any(x.failed for x in r if x.source_filename == "y.dcm")
    r = pipeline.run(spark, Policy(uid_key="s", fail_closed=True), root, table, broken)
    assert "y.dcm" in {x.file for x in r.errors.collect()}


def test_mapping_needs_its_columns(spark):
    with pytest.raises(ValueError):
        mapping.clean_mapping(spark.createDataFrame([("a",)], "other string"))
    with pytest.raises(ValueError):
        mapping.read_mapping(spark, "ids.txt")
    with pytest.raises(ValueError):
        Policy(date="today")


def test_last_row_wins_in_the_order_of_files(spark, tmp_path):
    """Also where the later file is read in an earlier partition: larger files go first there."""
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.csv").write_text("original_folder_name,new_folder_name\n" + "".join(f"X{i},Y{i}\n" for i in range(500)) + "A,P1\n")
    (tmp_path / "m/b.csv").write_text("original_folder_name,new_folder_name\nA,P2\nA,P3\n")
    files = sorted(p.as_uri() for p in (tmp_path / "m").iterdir())
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row"))
    raw = spark.read.option("header", True).csv(list(reversed(files))).withColumn(mapping.ORDER, place)
    assert mapping.clean_mapping(raw).filter("original_folder_name = 'A'").first().new_folder_name == "P3"


def test_a_run_needs_a_key_of_its_own(spark, cohort):
    root, ids = cohort
    with pytest.raises(ValueError):
        pipeline.run(spark, Policy(), root, mapping.read_mapping(spark, ids))


def test_references_to_what_is_not_published_are_found(spark, tmp_path):
    """One reference to a published slice, one to a slice of nobody: only the second is a finding."""
    (tmp_path / "in/A/s").mkdir(parents=True)
    (tmp_path / "in/A/s/x.dcm").write_bytes(head_slice("1.2.3.1", "1", phantom()))
    (tmp_path / "in/A/s/y.dcm").write_bytes(head_slice("1.2.3.2", "2", phantom()).replace(b"1.2.3.1\x00", b"1.2.3.7\x00"))
    table = spark.createDataFrame([("A", "P1")], "original_folder_name string, new_folder_name string")
    r = pipeline.run(spark, Policy(uid_key="secret"), str(tmp_path / "in"), table)
    found = [(x.source_filename, x.finding, x.tag) for x in r.qc.collect()]
    assert found == [("y.dcm", "unresolved_reference", "(0008,1155)")]


def test_names_in_deep_folders_are_not_published(spark, tmp_path):
    deep = tmp_path / "in/A/study/series/sub/deep/JOHN_DOE_19500101"
    deep.mkdir(parents=True)
    (deep / "x.dcm").write_bytes(head_slice("1.2.3.1", "1", phantom()))
    table = spark.createDataFrame([("A", "P1")], "original_folder_name string, new_folder_name string")
    r = pipeline.run(spark, Policy(uid_key="secret"), str(tmp_path / "in"), table)
    assert [x.path for x in r.files.select("path").collect()] == ["P1" + "/P1_1" * 5 + "/P1_00001.dcm"]


def test_streams(spark, tmp_path):
    rows = [("p", "DA", "00080020", ["20200101"]), ("p", "UI", "00080018", ["1.2.3"]), ("p", "LO", "00080080", ["x"])]
    spark.createDataFrame(rows, "patient string, vr string, tag string, value array<string>").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("patient string, vr string, tag string, value array<string>").parquet(str(tmp_path / "in"))
    policy = Policy(uid_key="s")
    for _ in range(2):  # the second time there is nothing new
        ingest.run_available(ingest.swept_stream(stream, policy), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {r.tag: r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = spark.range(1).select(identity.remapped(F.lit("1.2.3"), F.lit("p"), policy)).first()[0]
    assert got == {"00080020": ["20000101"], "00080018": [want], "00080080": ["x"]}
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 09:00:00", "b")], "t string, action string").select(F.col("t").cast("timestamp").alias("t"), "action")
    events.write.parquet(str(tmp_path / "ev"))
    w = ingest.windowed_actions(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")), "t")
    q = w.writeStream.format("memory").queryName("seen_actions").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.action, r.n) for r in spark.sql("SELECT * FROM seen_actions").collect()] == [("a", 2)]
    assert ingest.file_stream(spark, str(tmp_path)).isStreaming and partial and detect.LineEngine


def test_previews_and_second_pass(spark, cohort):
    root, ids = cohort
    policy = Policy(uid_key="secret")
    r = pipeline.run(spark, policy, root, mapping.read_mapping(spark, ids))
    pictures = {x.path: bytes(x.content) for x in previews.examined_slices(r.slices, r.shots).collect()}
    assert "detected_text/P1_s1_y.png" in pictures and "not_examined_detection_off/P1_s1_x.png" in pictures
    assert all(v[:8] == b"\x89PNG\r\n\x1a\n" for v in pictures.values())
    assert sorted(x.path for x in previews.middle_slices(r.images, r.slices).collect()) == ["P1_s1.png", "P1_s2_deep.png", "P3.png"]
    assert previews.second_pass(r.images, r.slices, detect.LineEngine, policy).count() == 0
    unmasked = r.shots.filter("instance_id LIKE '%y.dcm'").select("instance_id", F.col("hu").alias("pixels"))
    again = previews.second_pass(unmasked, r.slices.withColumn("slope", F.lit(1.0)).withColumn("intercept", F.lit(0.0)), detect.LineEngine, policy)
    assert again.count() == 1


def test_command_line(spark, cohort, tmp_path):
    root, ids = cohort
    assert main([root, ids, str(tmp_path / "out"), str(tmp_path / "tables"), "--date", "20010203", "--uid-key", "k", "--examine-all", "--previews"]) == 0
    assert (tmp_path / "out/P1/P1_1/P1_00001.dcm").exists() and (tmp_path / "tables/previews/detected_text/P1_s1_y.png").exists()
    assert b"20010203" in (tmp_path / "out/P3/P3_00001.dcm").read_bytes()
    bad = tmp_path / "bad.csv"
    bad.write_text("original_folder_name,new_folder_name\nA,P1\nC,P1\n")
    with pytest.raises(SystemExit):
        main([root, str(bad), str(tmp_path / "o2"), str(tmp_path / "t2"), "--date", "20010203", "--uid-key", "k"])
