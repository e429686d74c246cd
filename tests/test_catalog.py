"""Every registered query against its SQL twin on the driver's smallest tables."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry_point
from metframe.catalog import all_queries
from tests.oracle import mismatch

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_matches_sql(spark, name):
    query = all_queries()[name]
    assert query.sql is not None
    assert mismatch(query.run(spark, SF_DIR), query.sql, SF_DIR) is None


def test_entry_point(spark):
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert entry_point.entry(spark).columns[:2] == ["id", "entry_date"]


def test_queries_without_the_subpackage(tmp_path):
    """A copy without the subpackage and its tests, with or without the pipeline's file, has all queries of the catalog."""
    root = Path(entry_point.__file__).parent
    shutil.copytree(root / "metframe", tmp_path / "metframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copy(root / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert run.stdout.split() == [str(len(all_queries()))] * 2, run.stderr
