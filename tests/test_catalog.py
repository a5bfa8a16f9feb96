"""Every named query against its SQL, and the entry points."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from compare import differences
from veilframe.plans import catalog

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, name):
    assert differences(catalog.QUERIES[name](spark, SF), SF, catalog.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows_and_stability(spark, name):
    a, b = (sorted(map(repr, catalog.QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert a and a == b


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_training_data_queries(tmp_path):
    """The rest of the library imports and answers with those folders taken out."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "tests"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})
    assert said.stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.ORACLES))], said.stderr


def test_plans_have_no_python_where_none_is_needed(spark):
    python = {"largest_component", "geodesic_fill", "surface_removal", "text_components", "rect_merge", "detect_stub"}
    for name, q in catalog.QUERIES.items():
        plan = q(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert ("InArrow" in plan or "Python" in plan) == (name in python), name
        assert "CartesianProduct" not in plan, name


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.QUERIES["mapping_inner_join"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan and "PushedFilters: [IsNotNull(c_custkey)]" in plan, plan
