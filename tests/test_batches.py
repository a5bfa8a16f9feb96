from __future__ import annotations

import pyarrow as pa

from veilframe.batches import pieces


def test_pieces_are_bounded_and_whole():
    values = [b"x" * n for n in (3, 0, 9, 1, 1, 30, 2)] + [None]
    b = pa.RecordBatch.from_arrays([pa.array(values, pa.binary()), pa.array(range(8))], ["v", "i"])
    got = list(pieces(iter([b, b.slice(0, 0), b.slice(2, 3)]), "v", 10))
    assert [x for p in got for x in p.column("v").to_pylist()] == values + values[2:5]
    assert all(p.num_rows == 1 or sum(len(x or b"") for x in p.column("v").to_pylist()) <= 10 for p in got)


def test_contents_of_accepted_files_are_not_shuffled(spark, tmp_path):
    from dicom_files import head_slice, phantom
    from veilframe.config import Policy
    from veilframe.plans import pipeline

    (tmp_path / "in/A/s").mkdir(parents=True)
    (tmp_path / "in/A/s/x.dcm").write_bytes(head_slice("1.2.3.1", "1", phantom()))
    table = spark.createDataFrame([("A", "P1")], "original_folder_name string, new_folder_name string")
    plan = pipeline.run(spark, Policy(uid_key="secret"), str(tmp_path / "in"), table).shots._jdf.queryExecution().executedPlan().toString()
    kept = [x for x in plan.split("\n") if "Exchange" in x and "content" in x]
    assert not [x for x in kept if "hashpartitioning(instance_id" in x]
