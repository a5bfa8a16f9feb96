"""What decides how queries grow with their tables: partitions before explosions, shuffles, pieces."""

from __future__ import annotations

import pyarrow as pa

from veilframe.batches import pieces
from veilframe.config import Policy
from veilframe.operators import ordering, qc
from veilframe.plans import catalog, element_queries

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_headers_are_dealt_before_they_explode(spark):
    """F2 to F5, F7 to F9, F11: a file of one row group was exploded and labelled in one task."""
    assert element_queries.header_rows(spark, SF).rdd.getNumPartitions() >= 4
    for name in ("element_rewrite", "upsert_declarations", "changed_dates", "drop_tags", "blank_descriptors"):
        shown = plan(catalog.QUERIES[name](spark, SF))
        assert "hashpartitioning(k#" in shown and "hashpartitioning(instance_id" not in shown and "SortMergeJoin" not in shown, shown


def test_findings_meet_by_instance(spark):
    """known ids, declarations and preambles of odd instances, one of them without elements."""
    row = "instance_id string, patient string, new_id string, scope string, depth int, item_path string, ancestor_tags array<string>, ancestor_items array<string>, tag string, vr string, value array<string>, grp int, elem int"
    at = lambda i, tag, value: (i, "p", "n", "dataset", 0, "", [], [], tag, "LO", value, int(tag[:4], 16), int(tag[4:], 16))
    rows = [at("a", "00100020", [" ID7 "]), at("a", "00100010", ["id7"]), at("a", "00120062", ["no"]), at("a", "00120064", ["5"]), at("b", "00100010", ["id7"]), at("b", "00120062", ["yes"]), at("c", "00102180", ["x"]), at("d", "00100020", [None]), at("d", "00100010", ["id8"])]
    e = spark.createDataFrame(rows, row)
    instances = spark.createDataFrame([("a", bytearray(b"\x00\x80\xff\x00\x01")), ("b", None), ("d", bytearray(4)), ("e", bytearray())], "instance_id string, preamble binary")
    found = {(r.instance_id, r.finding, r.tag, r.detail) for r in qc.findings(e, instances, qc.produced_instances(e), Policy()).collect()}
    assert {x for x in found if x[1] not in ("missing_declaration",)} == {("a", "preamble_not_zeroed", "", "3 non-zero byte(s)"), ("b", "value_not_removed", "(0010,0010)", "id7"), ("d", "value_not_removed", "(0010,0010)", "id8"), ("c", "tag_not_removed", "(0010,2180)", "x")}
    gone = sorted((i, t[6:10]) for i, f, t, _ in found if f == "missing_declaration")
    assert gone == sorted([("a", "0062"), ("a", "0303"), ("b", "0064"), ("b", "0303"), *[(i, n) for i in "de" for n in ("0062", "0064", "0303")]])


def test_folders_are_shuffled_once(spark):
    """ranks, places and paths were dealt out anew at every step."""
    shown = plan(catalog.QUERIES["subdir_rank_deep"](spark, SF))
    assert shown.count("Exchange") == 1 and "Join" not in shown, shown
    rows = [("n", "p", "b/x"), ("n", "p", "b/x"), ("n", "p", "a"), ("n", "p", ""), ("n", "p", None), (None, "p", "a"), ("n", None, "a"), ("m", "p", "c")]
    got = {(r.new_id, r.patient_old, r.rel_dir, r.new_dir) for r in ordering.renamed_folders(spark.createDataFrame(rows, "new_id string, patient_old string, rel_dir string")).collect()}
    assert got == {("n", "p", "b/x", "n_2/n_1"), ("n", "p", "a", "n_1"), ("n", "p", "", ""), ("n", "p", None, ""), (None, "p", "a", ""), ("n", None, "a", ""), ("m", "p", "c", "m_3")}


def test_small_slices_come_in_few_at_a_time(spark):
    """small values filled a piece by thousands, and their objects the worker's memory."""
    b = pa.RecordBatch.from_pydict({"gray": [b"x"] * 1000})
    assert [p.num_rows for p in pieces(iter([b]), "gray", rows=256)] == [256, 256, 256, 232]
    assert plan(catalog.QUERIES["detect_stub"](spark, SF)).count("MapInArrow") == 2
